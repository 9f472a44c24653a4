"""Connected components of a graph too large for one machine."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.keys import own_shuffle
from shelfmark.sources.workspace import stored


def _lowest(pairs: DataFrame) -> DataFrame:
    """(key, low) per node `a`: the smallest of its neighbours `b`. Folds before its shuffle."""
    return pairs.groupBy("a").agg(F.min("b").alias("low")).select(own_shuffle(F.col("a")).alias("key"), "low")


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    joined = both.withColumn("key", own_shuffle(F.col("a"))).join(_lowest(both), "key")
    return joined.where("b > a").select(F.col("b").alias("a"), F.least("a", "low").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node ties its smaller neighbours, and itself, to the smallest of them. Edges run from large to small."""
    joined = edges.withColumn("key", own_shuffle(F.col("a"))).join(_lowest(edges), "key")
    tied = joined.select(F.inline(F.array(
        F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))))
    return tied.where("a > b").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) edges of any direction, with repeats and loops -> (node, root): the smallest node reachable.

    Nodes without an edge to another don't appear. Large and small stars alternate until no edge changes, which takes
    a number of rounds logarithmic in the largest path. Each round is written to the shared folder; neither edges nor
    components reach the driver, only the count and checksum that tell whether a round changed anything.
    """
    current = stored(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
                     "edges")
    mark = None
    while True:
        seen = current.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if tuple(seen) == mark:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root")) \
                .unionByName(current.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        mark = tuple(seen)
        current = stored(_small_star(_large_star(current)), "edges")
