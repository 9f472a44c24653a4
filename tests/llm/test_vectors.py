"""Vector searches against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import spann, vafile
from shelfmark.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.01"


def plain(rows, step, k, dot):
    """[(query_id, rank, vec_id, score)] over usable (id, vector) rows."""
    out = []
    rows = sorted(set(rows))
    for q, a in rows:
        if q % step == 0:
            scored = sorted((-dot(a, b), i) for i, b in rows if i != q and len(a) == len(b))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def integer_dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def double_dot(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def finite(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v)


@pytest.fixture(scope="module")
def odd(spark):
    """Copies, ties, repeated rows, unusable vectors and ids, clashing columns."""
    rng = np.random.default_rng(3)
    base = [rng.normal(size=6).round(2).tolist() for _ in range(40)]
    rows = [(i, base[i % 40] if i % 3 else base[0]) for i in range(300)]
    rows += rows[:10] + [(900, None), (902, []), (905, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (910, [math.nan] * 6), (915, [math.inf] * 6),
                         (920, [0.0] * 6), (None, base[1]), (-40, base[2]), (10**12, base[3])]
    return spark.createDataFrame([(*r, 0, "x", [1]) for r in rows], "vec_id long, embedding array<float>, vid int, rank string, ids array<int>"), rows


def as_float(rows):
    return [(i, tuple(float(np.float32(x)) for x in v)) for i, v in rows if i is not None and finite(v)]


def test_exact_search_of_odd_rows(spark, odd):
    df, rows = odd
    whole = F.transform("embedding", lambda x: F.floor(x.cast("double") * 256))
    good = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    found = vafile.search(df, F.col("id") % 50 == 0, 5, vector=F.when(good, whole))
    scaled = [(i, tuple(math.floor(256 * x) for x in v)) for i, v in as_float(rows)]
    assert sorted(tuple(r) for r in found.collect()) == plain(scaled, 50, 5, integer_dot)
    assert vafile.search(df.limit(0), F.col("id") % 50 == 0, 5, vector=whole).count() == 0


def test_exact_search_in_many_blocks(spark, monkeypatch):
    """Vectors of two lengths, several blocks of cells and of queries."""
    for name, size in (("BLOCK", 16), ("BLOCKS", 2), ("QUERIES", 8), ("STEP", 3)):
        monkeypatch.setattr(vafile, name, size)
    rng = np.random.default_rng(5)
    rows = [(i, tuple(int(x) for x in rng.integers(-300, 300, size=8 if i % 5 else 3))) for i in range(260)]
    df = spark.createDataFrame([(i, list(v)) for i, v in rows], "vec_id long, embedding array<long>")
    found = vafile.search(df, F.col("id") % 10 == 0, 4)
    assert sorted(tuple(r) for r in found.collect()) == plain(rows, 10, 4, integer_dot)


def test_fewer_rows_than_asked(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0]), (20, [2.0, 1.0]), (3, [1.0, 1.0])], "vec_id long, embedding array<float>")
    rows = [(0, (1.0, 2.0)), (20, (2.0, 1.0)), (3, (1.0, 1.0))]
    assert sorted(tuple(r) for r in spann.search(df, F.col("id") % 20 == 0, 20).collect()) == plain(rows, 20, 20, double_dot)


def test_approximate_search_of_odd_rows(spark, odd):
    """One list at this size, so the search is exact."""
    df, rows = odd
    found = spann.search(df, F.col("id") % 20 == 0, 20)
    assert sorted(tuple(r) for r in found.collect()) == plain([r for r in as_float(rows) if any(r[1])], 20, 20, double_dot)
    assert spann.search(df.limit(0), F.col("id") % 20 == 0, 20).count() == 0
    with pytest.raises(ValueError, match="components"):
        spann.search(spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<float>"), F.col("id") == 0, 1)


@pytest.mark.parametrize("folder", [FOLDER, "/root/testdata/sf0.1"])
def test_recall_of_query(spark, folder):
    rows = [(r.vec_id, np.array(r.embedding, dtype=np.float64)) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    ids, matrix = np.array([i for i, _ in rows]), np.stack([v for _, v in rows])
    found = {}
    for r in QUERIES["op3_ann_posting_lists"](spark, folder).collect():
        found.setdefault(r.query_id, {})[r.vec_id] = r.score
    asked = np.nonzero(ids % 20 == 0)[0]
    assert set(found) == set(ids[asked].tolist())
    hit = 0
    for q in asked:
        scores = matrix @ matrix[q]
        scores[q] = -np.inf
        best = set(ids[np.argsort(-scores, kind="stable")[:20]].tolist())
        ours = found[ids[q]]
        assert len(ours) == 20
        place = {i: n for n, i in enumerate(ids.tolist())}
        assert all(abs(scores[place[i]] - s) < 1e-9 for i, s in ours.items())
        hit += len(best & set(ours))
    assert hit >= 0.9 * 20 * len(asked)


def test_walk_finds_the_nearest_centroids(monkeypatch):
    monkeypatch.setattr(spann, "PER_LIST", 10)
    sample = np.random.default_rng(1).normal(size=(2000, 12))
    graph = spann.Graph(sample, 128)
    hit = total = 0
    for point in sample[::40]:
        distances = np.sqrt(((graph.centroids - point) ** 2).sum(1))
        wanted = set(np.nonzero(distances <= 1.1 * distances.min())[0].tolist())
        hit += len(wanted & {c for _, c in graph.near(point, 1.1, 32)})
        total += len(wanted)
    assert hit >= 0.95 * total


def test_lists_are_balanced():
    parts = spann._split(np.random.default_rng(2).normal(size=(1000, 8)), np.arange(1000), 16, np.random.default_rng(0))
    assert sorted(np.concatenate(parts).tolist()) == list(range(1000))
    assert max(map(len, parts)) - min(map(len, parts)) <= 4


def test_graph_reads_enough_rows():
    """Lists go on beyond the ratio until they hold as many rows as asked for, or all are read."""
    rng = np.random.default_rng(2)
    sample = np.column_stack([rng.normal(size=(400, 5)), np.zeros(400)])
    graph = spann.Graph(sample, 20)
    point = np.append(rng.normal(size=5), 0.0)
    graph.sizes[:] = 7
    assert len(graph.read_by(point, 30)) >= 5
    assert sorted(graph.read_by(point, 140)) == list(range(20)) == sorted(graph.read_by(point, 10_000))
    graph.sizes[:] = 0
    graph.sizes[3] = 50
    assert 3 in graph.read_by(point, 50)


def test_fitted_ratio_reaches_the_nearest():
    """Queries that read up to the fitted ratio find about the share of their neighbours it was fitted for."""
    rng = np.random.default_rng(6)
    raw = rng.normal(size=(3000, 8))
    raw /= np.sqrt((raw ** 2).sum(1, keepdims=True))
    sample = np.column_stack([raw, np.zeros(3000)])
    graph = spann.Graph(sample, 30)
    graph.fit_ratio(sample, 1.0, 20)
    graph.sizes[:] = 100
    homes, found, read = [set(graph.homes(x)) for x in sample], [], []
    for q in range(1000, 1100):
        scores = raw @ raw[q]
        scores[q] = -np.inf
        lists = set(graph.read_by(sample[q], 1))
        read.append(len(lists))
        found += [bool(homes[j] & lists) for j in np.argsort(-scores)[:20]]
    assert np.mean(found) >= 0.9
    assert np.mean(read) < 15
    graph.fit_ratio(sample[:1], 1.0, 20)                   # no neighbours: the ratio stays
