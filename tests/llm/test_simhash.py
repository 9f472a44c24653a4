"""Fingerprints and classes against brute force."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from shelfmark.llm import simhash
from shelfmark.llm.components import connected_components
from shelfmark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain_fingerprint(text, size=4):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_classes(prints):
    """{node: root} of numbers at most 4 bits apart, by comparing all pairs."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p
    order = sorted(prints)
    for i, a in enumerate(order):
        for b in order[:i]:
            if (a ^ b).bit_count() <= 4:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {p: find(p) for p in prints}


def expected(rows):
    prints = {}
    for doc_id, text in rows:
        prints.setdefault(plain_fingerprint(text), []).append(doc_id)
    classes = plain_classes(set(prints))
    least = {}
    for p, ids in prints.items():
        ids = [i for i in ids if i is not None]
        least[classes[p]] = min([*ids, *([least[classes[p]]] if least.get(classes[p]) is not None else [])], default=None)
    return sorted(((i, f"{p:016x}", least[classes[p]]) for p, ids in prints.items() for i in ids), key=str)


def found(frame):
    rows = frame.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0"), "component_id").collect()
    return sorted((tuple(r) for r in rows), key=str)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()]
    result = QUERIES["op2_simhash_near_dedup"](spark, FOLDER)
    assert result.columns[:3] == ["doc_id", "fingerprint", "component_id"]
    assert sorted((tuple(r) for r in result.collect()), key=str) == expected(rows)


def test_odd_rows(spark):
    long = " ".join(f"w{i % 977}" for i in range(60_000))
    rows = [(3, None), (1, ""), (2, " \t\n"), (None, "a b c d e"), (7, "A b C d e"), (7, "a b c d e"), (9, "one two"),
            (10, "One\x0btwo"), (11, "one two"), (12, long), (13, long), (5, "ÀB")]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fp string, key int")
    assert found(simhash.near_duplicates(docs)) == expected(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_pieces_of_long_texts_give_one_fingerprint(monkeypatch):
    text = " ".join(str(i * i % 1013) for i in range(4000)).encode()
    whole = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "CHUNK", 50)
    assert simhash.fingerprint(text) == whole
    assert whole & (1 << 64) - 1 == plain_fingerprint(text.decode())


@pytest.mark.parametrize("dense", [128, 2])
def test_links_connect_as_all_pairs_do(spark, monkeypatch, dense):
    """Also where buckets are dense: random flips around a few centres."""
    monkeypatch.setattr(simhash, "DENSE", dense)
    rng = random.Random(dense)
    centres = [rng.getrandbits(64) for _ in range(6)]
    prints = {0, (1 << 64) - 1, *centres}
    for _ in range(300):
        p = rng.choice(centres)
        for bit in rng.sample(range(64), rng.randint(1, 6)):
            p ^= 1 << bit
        prints.add(p)
    signed = {p - (1 << 64) if p >> 63 else p for p in prints}
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    rows = edges.collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= (4 if dense > 2 else 64) for r in rows)
    parent = {p: p for p in signed}

    def find(p):
        while parent[p] != p:
            p = parent[p]
        return p
    for r in rows:
        x, y = find(r.a), find(r.b)
        parent[max(x, y)] = min(x, y)
    classes = plain_classes(prints)
    ours = {}
    for p in signed:
        ours.setdefault(find(p), set()).add(p & (1 << 64) - 1)
    wanted = {}
    for p, r in classes.items():
        wanted.setdefault(r, set()).add(p)
    assert sorted(map(sorted, ours.values())) == sorted(map(sorted, wanted.values()))


def test_components_of_paths_stars_and_loops(spark):
    path = [(i, i + 1) for i in range(1, 60)]
    star = [(1000, 1000 + i) for i in range(1, 80)]
    edges = spark.createDataFrame([*path, *star, (500, 500), (7, 8), (8, 7)], "a long, b long")
    roots = {r.node: r.root for r in connected_components(edges).collect()}
    assert roots == {**{i: 1 for i in range(1, 61)}, **{1000 + i: 1000 for i in range(80)}}
    assert connected_components(edges.limit(0)).count() == 0
