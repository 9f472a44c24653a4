"""Mixing: targets by a plain walk, draws, odd rows."""

import pytest
from pyspark.sql import functions as F

from shelfmark.llm import mixing


def plain_targets(sizes, weights, most):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        level = (total - sum(most * sizes[s] for s in capped)) / sum(weight[s] for s in free) if free else 0
        above = {s for s in free if most * sizes[s] < level * weight[s]}
        if not above:
            return {s: most * sizes[s] if s in capped else level * weight[s] for s in order}
        capped |= above


@pytest.mark.parametrize("sizes", [
    {"a": 10, "b": 1, "c": 1000, None: 50, "": 3, "Z": 7, "é": 500}, {"a": 1, "b": 1, "c": 10**9}, {"only": 5}, {None: 9},
    {"a": 0, "b": 0}, {"a": 0, "b": 8}, {f"s{i}": 2**i for i in range(40)}, {f"s{i}": 1 for i in range(25)}])
def test_targets(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, size long")
    rows = mixing.source_targets(df).collect()
    wanted = plain_targets(sizes, (5, 2, 1), 3)
    assert {r.source: r.source_size for r in rows} == sizes
    for r in rows:
        assert r.target == pytest.approx(wanted[r.source], rel=1e-9)
        assert r.target <= 3 * r.source_size and 0 <= r.rate <= 3
    assert sum(r.target for r in rows) == pytest.approx(sum(sizes.values()))


def test_mix_of_odd_rows(spark):
    rows = [(i, f"s{i % 3}", "word " * (1 + i % 7)) for i in range(900)]
    rows += [(None, None, "a b"), (1000, None, None), (1001, "empty", ""), (1002, "empty", " \t\x0b"), (5, "s2", "repeated row"), (5, "s2", "repeated row"),
             (1003, "s0", "x " * 200_000)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, source string, text string, size int, target string")
    mixed = mixing.mix(df)
    assert mixed.columns == [*df.columns, "_size", "_source_size", "_target", "_copies"]
    found = mixed.collect()
    assert len(found) == len(rows) and sorted(map(str, found)) == sorted(map(str, mixing.mix(df).collect()))
    for r in found:
        assert r._size == len((r.text or "").split()) and 0 <= r._copies <= 3
    repeats = mixing.repeat(mixed, ["doc_id", "source"])
    assert repeats.count() == sum(r._copies for r in found)
    assert mixing.mix(df.limit(0)).count() == 0


def test_copies_come_near_the_rate(spark):
    drawn = spark.range(20_000).select(*[mixing.copies(F.lit(rate), F.col("id"), 42).alias(f"c{i}") for i, rate in enumerate((0.0, 0.3, 1.0, 2.75, 3.0))])
    means = drawn.agg(*[F.avg(c) for c in drawn.columns]).first()
    assert all(abs(m - rate) < 0.02 for m, rate in zip(means, (0, 0.3, 1, 2.75, 3)))
    limits = drawn.agg(*[F.min(c) for c in drawn.columns], *[F.max(c) for c in drawn.columns]).first()
    assert tuple(limits) == (0, 0, 1, 2, 3, 0, 1, 1, 3, 3)


def test_rows_without_an_id_or_with_one_id_meet_the_target(spark):
    rows = [(None, f"{i} " + "word " * (i % 40), "none") for i in range(3000)] + [(7, f"{i} " + "word " * (i % 40), "same") for i in range(3000)]
    rows += [(i, "word " * 50, "rest") for i in range(1000)]
    mixed = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    for r in mixed.groupBy("source").agg(F.sum(F.col("_size") * F.col("_copies")).alias("taken"), F.first("_target").alias("target")).collect():
        assert abs(r.taken / r.target - 1) < 0.05


def test_columns_named_like_the_operators_own(spark):
    names = ["_key", "_rate", "_copy", "__key", "_SIZE", "_target", "source_size"]
    rows = spark.createDataFrame([(i, "a b c", f"s{i % 2}") for i in range(50)], "doc_id long, text string, source string")
    odd = rows.select("*", *[F.lit(f"mine {n}").alias(n) for n in names])
    mixed = mixing.mix(odd)
    kept = [n for n in names if n not in ("_SIZE", "_target")]
    assert mixed.columns == ["doc_id", "text", "source", *kept, *mixing.RESULTS]
    plain = {r.doc_id: r._copies for r in mixing.mix(rows).collect()}
    for r in mixed.collect():
        assert r._copies == plain[r.doc_id] and [r[n] for n in kept] == [f"mine {n}" for n in kept]
    assert mixing.repeat(mixed, ["_copy", "_key"]).count() == sum(plain.values())
