"""Random inputs against small models in plain Python; each property is one Spark job over many cases."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from shelfmark import fixed_values as V
from shelfmark.functions import objects as O
from shelfmark.functions import text as X
from shelfmark.operators import changes as C
from shelfmark.operators import listing as R
from shelfmark.operators.ranking import position_within
from shelfmark.streaming import changefeed as G

ALPHABET = list("abAB09-./+eE&<>\"'?_ ") + list(V.JS_SPACE_CHARS) + ["é", "ሀ", "🍕", "\u0085"]


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return ["".join(rng.choices(ALPHABET, k=rng.randint(0, 14))) for _ in range(3000)]


def js_trim(text):
    return text.strip(V.JS_SPACE_CHARS)


def slug(text):
    return re.sub(r"[^a-z0-9]+", "-", js_trim(text.lower())).strip("-")


def number(text):
    found = re.match(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", text.lstrip(V.JS_SPACE_CHARS))
    return float(found.group()) if found else 0.0


def extension(text):
    return re.sub(r"[^a-z0-9]", "", (text.split(".")[-1] or "jpg").lower())


def test_text_rules(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    found = rows.select("i", X.trim_text("v").alias("trim"), X.slugify("v").alias("slug"), X.parse_float("v").alias("number"),
                        X.html_escape("v").alias("escaped"), O.object_ext("v").alias("ext"),
                        O.object_key_from_url("v", "a").alias("key")).orderBy("i").collect()
    for row, text in zip(found, texts):
        assert row.trim == js_trim(text)
        assert row.slug == slug(text)
        assert row.number == pytest.approx(number(text)) and (row.number == 0 or abs(row.number) > 0)
        assert row.escaped == html.escape(text, quote=True).replace("&#x27;", "&#39;")
        assert row.ext == extension(text)
        assert row.key == (text.split("/a/", 1)[1].split("?")[0] if "/a/" in text else None)


def test_search_and_filters(spark, texts):
    items = spark.createDataFrame([(i, t, None if i % 3 else t[::-1]) for i, t in enumerate(texts)], "id int, name string, description string")
    for query in ("a", ".", "%", "_", " ", "é", "aB"):
        found = {r.id for r in R.text_search(items, query).collect()}
        wanted = {i for i, t in enumerate(texts)
                  if query.lower() in t.lower() or (i % 3 == 0 and query.lower() in t[::-1].lower())}
        assert found == wanted


@pytest.mark.parametrize("seed", [1, 2])
def test_positions(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.choice([None, 1, 1, 1, 1, 2, 3]), rng.randint(0, 4), rng.choice("aab")) for i in range(4000)]
    df = spark.createDataFrame(rows, "id int, g int, o int, n string")
    order = [F.col("o"), F.col("n"), F.col("id")]
    found = {r.id: r.pos for r in position_within(df, ["g"], order).collect()}
    groups = {}
    for i, g, o, n in rows:
        groups.setdefault(g, []).append((o, n, i))
    assert found == {i: p for members in groups.values() for p, (_, _, i) in enumerate(sorted(members), 1)}


@pytest.mark.parametrize("seed", [1, 2])
def test_patches_in_order(spark, seed):
    rng = random.Random(seed)
    stored = {k: {"a": f"a{k}", "b": k} for k in range(40)}
    patches = [(rng.randint(0, 59) if rng.random() < .6 else 7, rng.choice([None, "x", "y"]), rng.choice([None, 1, 2]), s,
                rng.sample(["a", "b"], rng.randint(0, 2))) for s in range(400)]
    target = spark.createDataFrame([(k, v["a"], v["b"]) for k, v in stored.items()], "id int, a string, b int")
    batch = spark.createDataFrame(rng.sample(patches, len(patches)), "id int, a string, b int, seq int, patch_cols array<string>")
    for k, a, b, _, names in patches:
        if k in stored:
            stored[k].update({n: {"a": a, "b": b}[n] for n in names})
    found = C.update_patch(target, batch, "id", ["a", "b"], "seq", "patch_cols").collect()
    assert {r.id: (r.a, r.b) for r in found} == {k: (v["a"], v["b"]) for k, v in stored.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_replay(spark, tmp_path, seed):
    rng = random.Random(seed)
    log = [(rng.randint(0, 30) if rng.random() < .6 else 3, t // 3, t, rng.choice(["insert", "update", "delete"]), t * 10) for t in range(600)]
    state = {}
    for key, _, _, op, value in log:
        state.pop(key, None)
        if op != "delete":
            state[key] = value
    mixed = rng.sample(log, len(log))
    schema = "k int, ts int, seq int, op string, value int"
    for n in range(3):
        G.write_delta(spark.createDataFrame(mixed[n * 200:(n + 1) * 200], schema), n, str(tmp_path), "k", ["ts", "seq"])
    G.compact(spark, str(tmp_path), "k", ["ts", "seq"])
    assert {r.k: r.value for r in G.current_state(spark, str(tmp_path), "k", ["ts", "seq"]).collect()} == state
    assert {r.k: r.value for r in G.state_as_of(spark.createDataFrame(mixed, schema), "k", ["ts", "seq"]).collect()} == state
