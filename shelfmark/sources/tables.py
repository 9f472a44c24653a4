"""Table scans, the one-row table, literal rows, object manifests and catalog checks."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.functions.objects import media_type


def read_table(spark: SparkSession, folder: str, name: str, schema=None) -> DataFrame:
    """A Parquet table. With a declared schema no file is opened before the query runs."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(f"{folder}/{name}.parquet")


def scan_ordered(df: DataFrame, column: str, tie_break: str) -> DataFrame:
    """Full read ordered by one column, nulls last as the stored tables order them.

    With the tie break the range sort can also split rows that share one value.
    """
    return df.orderBy(F.col(column).asc_nulls_last(), tie_break)


def _single(df: DataFrame, message: str, wrong) -> DataFrame:
    """At most one row, found by one aggregate; running it fails when the row count is wrong."""
    counted = df.agg(F.count(F.lit(1)).alias("_n"), F.any_value(F.struct("*")).alias("_row"))
    failure = F.raise_error(F.concat(F.lit(message + ", rows: "), F.col("_n").cast("string"))).cast("boolean")
    return counted.where(F.when(wrong(F.col("_n")), failure).otherwise(F.col("_n") == 1)).select("_row.*")


def read_singleton(df: DataFrame, key: str = "id", value=1) -> DataFrame:
    """The row with the fixed key: none is fine, more than one is an error."""
    return _single(df.where(F.col(key) == value), "more than one row", lambda n: n > 1)


def require_single(affected: DataFrame) -> DataFrame:
    """Rows a write returned, which must be exactly one."""
    return _single(affected, "exactly one row expected", lambda n: n != 1)


def values_source(spark: SparkSession, rows: list[tuple], schema) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def object_manifest(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """Files below a folder as manifest rows; the listing alone is read, no file content."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern) \
        .option("recursiveFileLookup", "true").load(folder)
    name = F.substring_index("path", "/", -1)
    return files.select(F.col("path"), name.alias("name"), F.col("length").alias("size"),
                        F.col("modificationTime").alias("updated_at"), media_type(name).alias("media"))


def bucket_probe(manifest: DataFrame, bucket: str = "bucket_id", name: str = "name") -> DataFrame:
    """Per bucket its first object in name order and how many it holds."""
    return manifest.groupBy(bucket).agg(F.min(name).alias("first_object"), F.count(F.lit(1)).alias("n_objects"))


def table_rows(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("table"), "n_rows")
              for name, df in tables.items()]
    result = counts[0]
    for frame in counts[1:]:
        result = result.unionByName(frame)
    return result


def catalog_checks(present: DataFrame, expected: list[str], table: str = "table") -> DataFrame:
    """(table, present) for each expected table name."""
    wanted = present.sparkSession.createDataFrame([(n,) for n in expected], f"{table} string")
    found = present.select(table).distinct().withColumn("_found", F.lit(True))
    return wanted.join(found, table, "left").select(table, F.col("_found").isNotNull().alias("present"))


def registered_tables(spark: SparkSession) -> DataFrame:
    names = [(t.name,) for t in spark.catalog.listTables()]
    return spark.createDataFrame(names, "table string")

