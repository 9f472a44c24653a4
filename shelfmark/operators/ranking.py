"""Exact positions within groups, also where one group holds a large share of all rows.

A window over a group would put the whole group into one task. Here the rows are dealt into ranges of (group, sort
key) and written once; the position is the row number inside its range plus the rows of the group in the ranges
before it. There are as many ranges as the session has shuffle partitions, whatever the groups look like.
"""

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.sources.workspace import stored


def position_within(df: DataFrame, groups: list[str], order: list[Column], name: str = "pos") -> DataFrame:
    """Add the 1-based position of each row in its group under an order.

    `order` must end with a column that is unique in the group. Without groups all rows are numbered. The input is
    computed for the sample of the range borders and for the write; what follows reads the written rows, because
    borders may differ between two evaluations while the positions must not.
    """
    group = F.struct(*[F.col(g) for g in groups]) if groups else F.struct(F.lit(0).alias("all"))
    dealt = df.repartitionByRange(*[F.col(g) for g in groups], *order).withColumn("_range", F.spark_partition_id())
    written = stored(dealt, "positions")
    cell = F.struct(F.col("_range"), group.alias("group"))
    numbered = written.withColumn("_row", F.row_number().over(Window.partitionBy(cell).orderBy(*order)))

    sizes = written.groupBy("_range", group.alias("_group")).agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy("_group").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_range", *[F.col(f"_group.{g}").alias(f"_g_{g}") for g in groups],
                           F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    same = reduce(lambda a, b: a & b, (F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in groups),
                  numbered["_range"] == offsets["_range"])
    placed = numbered.join(offsets, same)
    return placed.select(*[F.col(c) for c in df.columns], (F.col("_row") + F.col("_offset")).cast("bigint").alias(name))
