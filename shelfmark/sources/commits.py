"""Several tables under one commit: a small table that names the version of each. Readers bound to a commit see all of
it; what a failed or unfinished commit wrote is named nowhere, and so seen by nobody."""

from pyspark.sql import DataFrame, SparkSession

from shelfmark.sources.versions import claim, latest_version, read_version

COMMITS = "commits"


def latest_commit(spark: SparkSession, folder: str) -> int:
    return latest_version(spark, f"{folder}/{COMMITS}") or 0


def versions_at(spark: SparkSession, folder: str, commit: int) -> dict[str, int]:
    """Version of each table (one row a table, few) at a commit; none before the first."""
    if commit == 0:
        return {}
    return {r["table"]: r["version"] for r in read_version(spark, f"{folder}/{COMMITS}", commit).collect()}


def table_at(spark: SparkSession, folder: str, name: str, commit: int) -> DataFrame | None:
    version = versions_at(spark, folder, commit).get(name)
    return None if version is None else read_version(spark, f"{folder}/{name}", version)


def write_commit(spark: SparkSession, folder: str, states: dict[str, DataFrame], base: int,
                 cluster_by: dict[str, list[str]] | None = None) -> int:
    """Write new states of some tables as the commit after `base`, on which they were planned.

    The commit's number is claimed first, so tables written under it are this writer's alone, and what a failed commit
    left there is overwritten. Of two writers planned on one base the second fails. The commit becomes visible by its
    own table, written last.
    """
    number, order = base + 1, cluster_by or {}
    with claim(spark, f"{folder}/{COMMITS}", number):
        for name, state in states.items():
            frame = state.sortWithinPartitions(*order[name]) if order.get(name) else state
            frame.write.mode("overwrite").parquet(f"{folder}/{name}/version={number}")
        named = versions_at(spark, folder, base) | dict.fromkeys(states, number)
        rows = spark.createDataFrame(sorted(named.items()), "table string, version long")
        rows.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{COMMITS}/version={number}")
    return number
