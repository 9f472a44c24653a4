"""A catalog's own edits as one feed: row changes between two commits, tagged with their table.

A commit's changes are one folder of the feed, named by the commit; publishing it again replaces the folder, and rows a
reader sees twice are equal, so state folded to the latest change per key is the same. Old and new image are columns of
their own for each table: whoever splits the feed by table reads that table's columns only.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from shelfmark.sources.commits import latest_commit, table_at
from shelfmark.sources.versions import numbered
from shelfmark.streaming.changefeed import DELETE, change_source

ORDER = ["commit"]


def row_changes(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """(key, op, old, new) of every row that differs between two versions; keys are unique and not null in each.

    Insert has no old image, delete no new one. Columns are compared as wholes, two nulls being equal; a column only one
    version has makes every row differ.
    """
    old = before.select(F.col(key).alias("key"), F.struct(*before.columns).alias("old"))
    new = after.select(F.col(key).alias("key"), F.struct(*after.columns).alias("new"))
    op = F.when(F.col("old").isNull(), "insert").when(F.col("new").isNull(), DELETE).otherwise("update")
    both = old.join(new, "key", "full_outer")
    same = F.col("old").eqNullSafe(F.col("new")) if before.columns == after.columns else F.lit(False)
    return both.where(~same).select("key", op.alias("op"), "old", "new")


def feed_schema(tables: dict[str, StructType]) -> StructType:
    images = []
    for name, columns in tables.items():
        row = StructType([StructField(c.name, c.dataType) for c in columns])  # an image that is absent has no values
        images.append(StructField(name, StructType([StructField("old", row), StructField("new", row)])))
    return StructType([StructField("table", StringType()), StructField("key", StringType()), StructField("op", StringType()), *images])


def commit_changes(spark: SparkSession, folder: str, commit: int, tables: dict[str, StructType], keys: dict[str, str]) -> DataFrame:
    """Tagged changes of the commit against the one before; tables it left alone are not read."""
    schema = feed_schema(tables)
    feed = spark.createDataFrame([], schema)
    for name, columns in tables.items():
        after, before = (table_at(spark, folder, name, c) for c in (commit, commit - 1))
        if after is None or (before is not None and before.inputFiles() == after.inputFiles()):
            continue
        typed = [F.col(c.name).cast(c.dataType).alias(c.name) for c in columns]
        before = spark.createDataFrame([], columns) if before is None else before.select(*typed)
        changed = row_changes(before, after.select(*typed), keys[name])
        images = [(F.struct("old", "new") if other == name else F.lit(None)).cast(schema[other].dataType).alias(other) for other in tables]
        feed = feed.unionByName(changed.select(F.lit(name).alias("table"), F.col("key").cast("string").alias("key"), "op", *images))
    return feed


def publish(spark: SparkSession, folder: str, feed: str, tables: dict[str, StructType], keys: dict[str, str]) -> int:
    """Add the commits since the last one published to the feed; returns the newest. Safe to repeat."""
    done, newest = numbered(spark, feed, "commit"), latest_commit(spark, folder)
    for commit in range(done[-1] + 1 if done else 1, newest + 1):
        commit_changes(spark, folder, commit, tables, keys).write.mode("overwrite").parquet(f"{feed}/commit={commit}")
    return newest


def feed_source(spark: SparkSession, feed: str, tables: dict[str, StructType], files_per_batch: int | None = None) -> DataFrame:
    """The feed of all tables as a stream."""
    schema = StructType([*feed_schema(tables), StructField("commit", LongType())])
    return change_source(spark, feed, schema, files_per_batch=files_per_batch)


def of_table(changes: DataFrame, name: str) -> DataFrame:
    """(commit, op, the table's columns): new rows, and the last image of deleted ones, to be replayed in commit order."""
    image = F.coalesce(F.col(name)["new"], F.col(name)["old"])
    return changes.where(F.col("table") == name).select("commit", "op", image.alias("row")).select("commit", "op", "row.*")
