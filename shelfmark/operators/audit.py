"""Checks over whole tables, each with a status and a detail text."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions.text import count_label
from shelfmark.operators.listing import union_all


def check_not_empty(name: str, df: DataFrame, singular: str, plural: str) -> DataFrame:
    n = df.agg(F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("n") > 0, F.lit("ok")).otherwise(F.lit("fail"))
    return n.select(F.lit(f"{name} readable").alias("check_name"), status.alias("status"),
                    F.concat(count_label("n", singular, plural), F.lit(" found")).alias("detail"))


def check_singleton(name: str, df: DataFrame, key: str, value, label: str) -> DataFrame:
    found = df.where(F.col(key) == value).agg(F.max(label).alias("label"), F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("n") == 1, F.lit("ok")).otherwise(F.lit("fail"))
    detail = F.when(F.col("n") == 1, F.col("label").cast("string")).otherwise(F.lit(f"missing row {key}={value}"))
    return found.select(F.lit(f"{name} row exists").alias("check_name"), status.alias("status"), detail.alias("detail"))


def check_none_visible(name: str, visible: DataFrame) -> DataFrame:
    """Rows a stranger can see where none should be: a warning."""
    n = visible.agg(F.count(F.lit(1)).alias("n"))
    status = F.when(F.col("n") == 0, F.lit("ok")).otherwise(F.lit("warn"))
    return n.select(F.lit(f"{name} not exposed").alias("check_name"), status.alias("status"),
                    F.concat(count_label("n", "row", "rows"), F.lit(" visible")).alias("detail"))


def audit_tables(checks: list[DataFrame]) -> DataFrame:
    return union_all(checks)


def check_rollup(checks: DataFrame, status: str = "status") -> DataFrame:
    """Failures and warnings counted; the audit passes if nothing failed."""
    counted = checks.agg(F.count(F.lit(1)).alias("n_checks"),
                         F.count_if(F.col(status) == "fail").alias("n_fail"),
                         F.count_if(F.col(status) == "warn").alias("n_warn"))
    return counted.withColumn("passed", F.col("n_fail") == 0)


def expectations(df: DataFrame, rules: dict[str, tuple[Column, object]]) -> DataFrame:
    """(rule, actual, expected, ok) per rule; all rules are aggregated in one pass over the table."""
    measured = df.agg(*[actual.cast("string").alias(rule) for rule, (actual, _) in rules.items()])
    rows = [F.struct(F.lit(rule).alias("rule"), F.col(f"`{rule}`").alias("actual"), F.lit(str(expected)).alias("expected"))
            for rule, (_, expected) in rules.items()]
    listed = measured.select(F.inline(F.array(*rows)))
    return listed.withColumn("ok", F.coalesce(F.col("actual") == F.col("expected"), F.lit(False)))


def seed_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows whose number of copies differs between two states; empty when a rerun changed nothing."""
    columns = before.columns
    sides = before.withColumn("_n", F.lit(-1)).unionByName(after.select(*columns).withColumn("_n", F.lit(1)))
    changed = sides.groupBy(*columns).agg(F.sum("_n").alias("n_added"))
    return changed.where(F.col("n_added") != 0)
