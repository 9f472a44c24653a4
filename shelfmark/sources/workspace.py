"""Where jobs keep what they write."""

import atexit
import shutil
import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def workspace(spark: SparkSession) -> str:
    """The shared folder the cluster names; a local session without one gets a folder of its own until it ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder all executors share")
    return _local_folder(spark.sparkContext.applicationId)


@cache
def _local_folder(application: str) -> str:
    folder = tempfile.mkdtemp(prefix=f"shelfmark-{application}-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{workspace(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, name: str, compression: str | None = None) -> DataFrame:
    """The rows of `df`, written as Parquet and read again, so that what follows doesn't compute them anew.

    The plan behind them is cut off: a lost executor costs no more than the tasks that ran on it. `compression` is the
    session's unless given.
    """
    folder = fresh_folder(df.sparkSession, name)
    df.write.parquet(folder, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
