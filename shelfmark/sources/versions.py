"""A table as numbered version folders. A reader keeps its version; a writer adds the next one."""

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def _names(spark: SparkSession, folder: str) -> list[str]:
    """Names of complete (committed) subfolders."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    children = [status.getPath() for status in fs.listStatus(path) if status.isDirectory()]
    done = [p for p in children if fs.exists(jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
    return sorted(p.getName() for p in done)


def numbered(spark: SparkSession, folder: str, prefix: str) -> list[int]:
    return sorted(int(n.split("=", 1)[1]) for n in _names(spark, folder) if n.startswith(prefix + "="))


def latest_version(spark: SparkSession, folder: str) -> int | None:
    versions = numbered(spark, folder, "version")
    return versions[-1] if versions else None


def read_version(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    version = latest_version(spark, folder) if version is None else version
    if version is None:
        raise FileNotFoundError(f"no version in {folder}")
    return spark.read.parquet(f"{folder}/version={version}")


class VersionTaken(Exception):
    """Another writer has claimed the version; the statement may be repeated on the newest state."""


def _marker(spark: SparkSession, folder: str, version: int):
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/claim={version}")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


@contextmanager
def claim(spark: SparkSession, folder: str, version: int):
    """Hold a number while its version is written.

    A marker file claims it, which the file system makes for one caller only, so of two writers one fails and no version
    is replaced. A write that fails gives its number back; one that was killed leaves its marker, which `release` takes
    away.
    """
    fs, marker = _marker(spark, folder, version)
    if not fs.createNewFile(marker):
        raise VersionTaken(f"version {version} of {folder} is taken")
    try:
        yield
    except BaseException:
        fs.delete(marker, False)
        raise


def write_version(df: DataFrame, folder: str, cluster_by: list[str] = (), version: int | None = None) -> int:
    """Write the next version, or the one given; sorting inside files lets later scans skip row groups."""
    spark = df.sparkSession
    version = (latest_version(spark, folder) or 0) + 1 if version is None else version
    frame = df.sortWithinPartitions(*cluster_by) if cluster_by else df
    with claim(spark, folder, version):
        frame.write.mode("overwrite").parquet(f"{folder}/version={version}")
    return version


def release(spark: SparkSession, folder: str, version: int) -> None:
    """Give back the number of a write that was killed."""
    fs, marker = _marker(spark, folder, version)
    fs.delete(marker, False)


def drop_folders(spark: SparkSession, folder: str, prefix: str, numbers: list[int]) -> None:
    """Remove numbered folders that no reader needs any more."""
    for number in numbers:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/{prefix}={number}")
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
