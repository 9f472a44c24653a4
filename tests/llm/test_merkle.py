"""Merkle manifest against trees hashed one by one."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import merkle
from shelfmark.llm.queries import QUERIES


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row):
    return h(*(field(v) for v in row))


def levels_of(leaves):
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i:i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def path_of(levels, i):
    path = []
    for level in levels[:-1]:
        first = i - i % 3
        run = level[first:first + 3]
        path.append((run[:i - first], run[i - first + 1:]))
        i //= 3
    return path


def fold(leaf, path):
    for left, right in path:
        leaf = h(*left, leaf, *right)
    return leaf


def plain(rows):
    """Rows (doc_id, source, lang, n_chars, text) -> result rows of the query."""
    trees = {}
    for r in rows:
        trees.setdefault(r[1], []).append(r)
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    built = {}
    for s in order:
        trees[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        built[s] = levels_of([leaf_of(r) for r in trees[s]])
    top = levels_of([built[s][-1][0] for s in order])
    out = []
    for n, s in enumerate(order):
        for i, r in enumerate(trees[s]):
            path = path_of(built[s], i) + path_of(top, n)
            seen = r
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[4] is not None:
                seen = (*r[:4], r[4].replace("\n", ""))
            root = fold(leaf_of(seen), path)
            out.append((r[0], leaf_of(r), built[s][-1][0], top[-1][0], h(*(x for left, right in path for x in left + right)), root, root == top[-1][0]))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree int, place string, path string, item int, digest string"


def saved(spark, rows, folder):
    docs = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3], 1, "x", "y", 2, "z") for r in rows], SCHEMA)
    docs.repartition(5).write.parquet(f"{folder}/documents.parquet")
    return str(folder)


def test_odd_rows(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", "Z", "é", "", None]), "en", i, f"text {i}\nand more" if i % 3 else f"text {i}") for i in range(300)]
    rows += [(7, "only", None, None, None), (None, "a", "en", 3, "no id\n"), (None, "a", "en", 3, "no id\n"), (None, None, None, None, None),
             (5, "a", "en", 3, "twice\n"), (5, "a", "en", 3, "twice\n"), (5, "a", "en", 4, "other"), (-4, "b", "en", 0, ""),
             (10**15, "a", "1:x", 9, "é\n" * 100_000)]
    folder = saved(spark, rows, tmp_path)
    assert result(QUERIES["op11_merkle_manifest"](spark, folder)) == plain(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 729, 730, 2190])
def test_one_tree_of_each_size(spark, tmp_path, n):
    rows = [(i, "s", None, i, f"{i}\n" * (i % 2)) for i in range(n)]
    assert result(QUERIES["op11_merkle_manifest"](spark, saved(spark, rows, tmp_path))) == plain(rows)


def test_no_rows(spark, tmp_path):
    found = QUERIES["op11_merkle_manifest"](spark, saved(spark, [], tmp_path))
    assert found.count() == 0
    assert found.columns[:7] == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def completed(n):
    """(level, digest) in the order in which appended leaves complete nodes, ragged ones at the end."""
    levels = levels_of([h(str(i)) for i in range(n)])
    log = []

    def walk(level, i):
        if level:
            for j in range(3 * i, min(3 * i + 3, len(levels[level - 1]))):
                walk(level - 1, j)
        log.append((level, levels[level][i]))
    walk(len(levels) - 1, 0)
    return log


def test_log_is_in_completion_order(spark):
    sizes = {"a": 1, "b": 2, "c": 5, "d": 27, "e": 28, "f": 729, "g": 731, "h": 3000}
    docs = spark.createDataFrame([(t, i) for t, n in sizes.items() for i in range(n)], "t string, i int").repartition(4)
    made = merkle.build(docs, F.sha2(F.col("i").cast("string"), 256), F.col("t"), [F.col("i")], [F.col("i")])
    logs = {}
    for r in merkle.log_rows(made).collect():
        logs.setdefault(r.tree, []).append((r.position, r.level, r.digest))
    assert set(logs) == set(sizes)
    for t, n in sizes.items():
        assert sorted(logs[t]) == [(at, level, d) for at, (level, d) in enumerate(completed(n))], t


def test_more_than_two_tiers(spark, monkeypatch):
    monkeypatch.setattr(merkle, "STEPS", 2)
    monkeypatch.setattr(merkle, "WIDTH", 9)
    docs = spark.range(800).select(F.col("id").alias("i"))
    made = merkle.build(docs, F.sha2(F.col("i").cast("string"), 256), F.lit("t"), [F.col("i")], [F.col("i")])
    assert len(made.sections) == 4
    levels = levels_of([h(str(i)) for i in range(800)])
    tops = merkle.roots(made).select("tree", F.array().cast(merkle.PATH).alias("path"), F.struct("root").alias("top"))
    for r in merkle.proofs(made, tops).collect():
        assert r.place == r.i and r.leaf == levels[0][r.i]
        assert [(s.others[:s.place], s.others[s.place:]) for s in r.path] == path_of(levels, r.i)
    log = sorted((r.position, r.level, r.digest) for r in merkle.log_rows(made).collect())
    assert log == [(at, level, d) for at, (level, d) in enumerate(completed(800))]
