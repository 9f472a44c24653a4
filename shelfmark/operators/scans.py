"""Scans of whole text columns."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfmark import fixed_values as V
from shelfmark.functions.text import secret_hits, strip_comments


def secret_scan(df: DataFrame, text: str, key: str, rules=V.SECRET_RULES) -> DataFrame:
    """(key, rule) for every secret rule a text breaks. Comments are removed once for all rules."""
    bare = df.select(key, text, strip_comments(text).alias("_code"))
    return bare.select(key, F.explode(secret_hits(text, "_code", rules)).alias("rule"))
