"""Snapshots of what readers see: menu pages, tabs and the info row, one folder per save time."""

from collections.abc import Callable

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.fixed_values import SNAPSHOT_TTL_MS
from shelfmark.sources.versions import numbered
from shelfmark.sources.workspace import stored

FAILURES = (PySparkException, Py4JError, OSError)  # what a read may end in
CONTENT_SCHEMA = "part string, category_id string, page bigint, data string"
SNAPSHOT_SCHEMA = CONTENT_SCHEMA + ", saved_at bigint"


def to_snapshot(pages: DataFrame, category: str = "category_id", part: str = "items") -> DataFrame:
    """Rows of one part of the catalog, each as JSON; pages and parts of their own keep their category and page."""
    keys = [c for c in (category, "page") if c in pages.columns]
    content = [c for c in pages.columns if c not in keys]
    return pages.select(
        F.lit(part).alias("part"), (F.col(category) if category in keys else F.lit(None)).cast("string").alias("category_id"),
        (F.col("page") if "page" in keys else F.lit(None)).cast("bigint").alias("page"),
        F.to_json(F.struct(*content), {"ignoreNullFields": "false"}).alias("data"))


def catalog_snapshot(pages: DataFrame, tabs: DataFrame, info: DataFrame) -> DataFrame:
    """All that is shown: menu pages, tabs (of empty categories too) and the info row."""
    return to_snapshot(pages).unionByName(to_snapshot(tabs, part="tabs")).unionByName(to_snapshot(info, part="info"))


def snapshot_write(rows: DataFrame, folder: str, *saved_at: int) -> None:
    """Save snapshot rows under each save time (epoch milliseconds). A repeated write replaces its own folder."""
    target, first = [f"{folder}/saved_at={t}" for t in saved_at], None
    for path in target:
        source = rows if first is None else rows.sparkSession.read.schema(CONTENT_SCHEMA).parquet(first)
        source.write.mode("overwrite").parquet(path)
        first = first or path


def snapshot_read(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(SNAPSHOT_SCHEMA).parquet(folder)


def snapshot_latest_valid(spark: SparkSession, folder: str, as_of: int, ttl: int = SNAPSHOT_TTL_MS) -> DataFrame:
    """Rows of the newest readable snapshot no older than the TTL (an age of just the TTL is valid).

    The folders' names say the save times, so only snapshots in time are opened, newest first. One that holds a row
    that is no readable JSON, or a file that can't be read, is corrupt, and the next older one is tried.
    """
    for saved_at in reversed(numbered(spark, folder, "saved_at")):
        if as_of - saved_at > ttl:
            break
        rows = spark.read.schema(CONTENT_SCHEMA).parquet(f"{folder}/saved_at={saved_at}") \
            .withColumn("saved_at", F.lit(saved_at).cast("bigint"))
        if _readable(rows.where(F.get_json_object("data", "$").isNull())) is True:
            return rows
    return spark.createDataFrame([], SNAPSHOT_SCHEMA)


def _readable(rows: DataFrame) -> bool | None:
    """Whether there are no such rows; None where they can't be read."""
    try:
        return rows.isEmpty()
    except FAILURES:
        return None


def snapshot_fallback(fresh: Callable[[], DataFrame], snapshot: DataFrame) -> DataFrame:
    """Fresh rows where their source can be read to the end, else the snapshot; `source` says which.

    The fresh rows are written on the way, so a failure while they are read counts too and nothing is read twice.
    """
    try:
        return stored(fresh(), "fresh").withColumn("source", F.lit("fresh"))
    except FAILURES:
        return snapshot.withColumn("source", F.lit("snapshot"))


def loaded_or_error(menu: DataFrame) -> DataFrame:
    """No fresh data and no valid snapshot: running the query fails instead of showing nothing."""
    n = menu.limit(1).agg(F.count(F.lit(1)).alias("_n"))
    failure = F.raise_error(F.lit("could not load the menu")).cast("boolean")
    nothing = n.where(F.when(F.col("_n") == 0, failure).otherwise(F.lit(False)))
    blank = [F.lit(None).cast(f.dataType).alias(f.name) for f in menu.schema.fields]
    return menu.unionByName(nothing.select(*blank))


def snapshot_clear(spark: SparkSession, folder: str) -> None:
    """Drop every snapshot by overwriting the folder with none."""
    spark.createDataFrame([], SNAPSHOT_SCHEMA).write.mode("overwrite").partitionBy("saved_at").parquet(folder)
