"""Sums per group kept up from a change stream, without counting the table again.

A batch's delta is what its keys count after it less what they counted before it, both from the folded state: an item
that moves is -1 in its old group and +1 in the new one; a repeated or late change, which alters no state, adds nothing.
A replayed batch replaces its own delta. Work grows with the batch and the log it is folded from, not with the groups.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.sources.versions import drop_folders, numbered
from shelfmark.streaming.changefeed import KEEP_BASES, latest_per_key, parts, without_deleted


def signed_deltas(before: DataFrame, after: DataFrame, group: str, measures: dict[str, str]) -> DataFrame:
    """(group, measures): sums over `after` less sums over `before`; groups where nothing changed are left out.

    Measures are SQL expressions over a row. A null group is a group of its own; a null measure counts as 0.
    """
    def signed(rows: DataFrame, sign: int) -> DataFrame:
        return rows.select(F.col(group), *[(F.coalesce(F.expr(m), F.lit(0)) * sign).alias(name) for name, m in measures.items()])

    sums = signed(after, 1).unionByName(signed(before, -1)).groupBy(group).agg(*[F.sum(name).alias(name) for name in measures])
    changed = F.lit(False)
    for name in measures:
        changed |= F.col(name) != 0
    return sums.where(changed)


def counter_keeper(state: str, counters: str, key: str, order: list[str], group: str,
                   measures: dict[str, str], compact_every: int = 100) -> Callable[[DataFrame, int], None]:
    """Hook for ``change_apply``: after each batch writes its signed deltas."""
    def keep(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        keys = batch.select(key).distinct()

        def folded(upto: int) -> DataFrame:
            found, _ = parts(spark, state, upto)
            log = spark.read.parquet(*found) if found else batch.limit(0)
            hit = log.join(keys, key, "left_semi").select(*log.columns)
            return without_deleted(latest_per_key(hit, key, order))

        delta = signed_deltas(folded(batch_id - 1), folded(batch_id), group, measures)
        delta.write.mode("overwrite").parquet(f"{counters}/delta/batch={batch_id}")
        if batch_id % compact_every == compact_every - 1:
            compact_counters(spark, counters, group, list(measures))

    return keep


def _summed(spark: SparkSession, paths: list[str], group: str, measures: list[str]) -> DataFrame:
    return spark.read.parquet(*paths).groupBy(group).agg(*[F.sum(m).alias(m) for m in measures])


def current_counters(spark: SparkSession, counters: str, group: str, measures: list[str]) -> DataFrame:
    """Sums per group as they are now; a group that lost its last row is there with 0 until the next compaction."""
    paths, _ = parts(spark, counters)
    if not paths:
        raise FileNotFoundError(f"no counters in {counters}")
    return _summed(spark, paths, group, measures)


def compact_counters(spark: SparkSession, counters: str, group: str, measures: list[str]) -> int:
    """Fold base and deltas into a new base, without groups that have come to 0 in all measures."""
    paths, last = parts(spark, counters)
    target = f"{counters}/base/upto={last}"
    if target not in paths:
        sums = _summed(spark, paths, group, measures)
        nonzero = F.greatest(*[F.abs(m) for m in measures], F.lit(0)) != 0
        sums.where(nonzero).write.mode("overwrite").parquet(target)
        bases = numbered(spark, f"{counters}/base", "upto")
        if len(bases) >= KEEP_BASES:
            drop_folders(spark, f"{counters}/base", "upto", bases[:-KEEP_BASES])
            held = [b for b in numbered(spark, f"{counters}/delta", "batch") if b <= bases[-KEEP_BASES]]
            drop_folders(spark, f"{counters}/delta", "batch", held)
    return last
