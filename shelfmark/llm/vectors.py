"""What vector searches share: usable vectors, copies folded, and answers for every query row."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators.keys import own_shuffle


def usable(df: DataFrame, vec_id: str, vector: Column, nonzero: bool) -> DataFrame:
    """(id, vec) of rows with an id whose vector is neither null nor empty and holds finite numbers only.

    `vector` is an array of doubles or longs; with `nonzero` zero vectors go too. Rows that agree in both count once.
    """
    def number(x):
        whole = x.cast("double")
        return x.isNotNull() & ~F.isnan(whole) & (F.abs(whole) != float("inf"))
    rows = df.select(F.col(vec_id).cast("long").alias("id"), vector.alias("vec"))
    keep = F.col("id").isNotNull() & (F.size("vec") > 0) & F.forall("vec", number)
    if nonzero:
        keep = keep & F.exists("vec", lambda x: x != 0)
    return rows.where(F.coalesce(keep, F.lit(False)))


def folded(rows: DataFrame, keep: int) -> DataFrame:
    """(vid, vec, ids): each different vector once, with its `keep` smallest ids; vid is the smallest.

    An answer of fewer than `keep` rows never needs more ids of one vector, as ties go to smaller ids. Spark applies
    the limit before its shuffle, so copies don't gather in one task.
    """
    placed = rows.distinct().withColumn("n", F.row_number().over(Window.partitionBy("vec").orderBy("id")))
    return placed.where(F.col("n") <= keep).groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids")) \
        .select(F.get("ids", F.lit(0)).alias("vid"), "vec", "ids")


def asked(rows: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query_id, qid): the folded vector of each query row."""
    keys = vectors.select(own_shuffle(F.col("vec")).alias("key"), F.col("vid").alias("qid"))
    return rows.distinct().withColumn("key", own_shuffle(F.col("vec"))).join(keys, "key") \
        .select(F.col("id").alias("query_id"), "qid")


def answers(hits: DataFrame, vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows other than the query's own, ties to smaller ids.

    `hits` (qid, vid, score) hold at least the k + 1 best folded vectors of each qid, or all there are.
    """
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    ids = hits.join(vectors.select("vid", "ids"), "vid").select("qid", "score", F.explode("ids").alias("vec_id")) \
        .withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1)
    lists = ids.select(own_shuffle(F.col("qid")).alias("key"), "score", "vec_id")
    found = queries.withColumn("key", own_shuffle(F.col("qid"))).join(lists, "key").where("vec_id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k) \
        .select("query_id", "rank", "vec_id", "score")


def inner_product(a: str, b: str, zero: Column) -> Column:
    """Sum of products, from the first component to the last."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), zero, lambda total, x: total + x)
