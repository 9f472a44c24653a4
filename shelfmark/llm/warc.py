"""A content-addressed WARC archive: payloads once by digest, exact record headers apart, records by a join.

    payloads: digest, payload            one row per different payload, checked against its digest when read
    headers:  record_id, header, digest  the exact header block of each record
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.operators.keys import own_shuffle

CRLF = "\r\n"
PAYLOADS, HEADERS = "payloads", "headers"


def _urn(record_id: Column) -> Column:
    return F.concat(F.lit("<urn:record:"), F.coalesce(record_id.cast("string"), F.lit("")), F.lit(">"))


def _header(*lines: Column) -> Column:
    """Named lines below the version, ended by an empty one; a null line is left out."""
    return F.concat(F.concat_ws(CRLF, F.lit("WARC/1.1"), *lines), F.lit(CRLF + CRLF))


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), value.cast("string"))


def _field(header: Column, name: str) -> Column:
    """Value of a header line; null if there is none. Only the header block is looked at, not the payload."""
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(F.contains(header, F.lit(f"{CRLF}{name}: ")), found)


def write_archive(pages: DataFrame, folder: str, record_id: str = "page_id", url: str = "url",
                  payload: str = "html", revisit_from: int = 100) -> None:
    """Write one record per row to an archive in `folder`.

    The payload is the UTF-8 of the text, empty for null. Of the records with one payload of at least `revisit_from`
    bytes, those with the smallest id are responses and the others revisit it; shorter ones are all responses.
    A null id counts as larger than all ids. A null address becomes an empty target; line ends in addresses are
    percent-encoded. Repeated rows all get records; a table without rows gives an empty archive.

    Both the payloads and the smallest id of a digest come from groupings that fold copies before their shuffle, so no
    group of copies lands in one task.
    """
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(record_id).cast("long").alias("id"), F.col(url).alias("url"), body.alias("payload")) \
        .withColumn("digest", F.sha2("payload", 256))
    slim = rows.select("id", "url", "digest", F.octet_length("payload").cast("long").alias("bytes"))
    firsts = slim.groupBy("digest").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("copies"))

    rows.select("digest", "payload").dropDuplicates(["digest"]).write.parquet(f"{folder}/{PAYLOADS}")

    first = firsts.where("copies > 1").select(own_shuffle(F.col("digest")).alias("key"), "first_id")
    marked = slim.withColumn("key", own_shuffle(F.col("digest"))).join(first, "key", "left")
    later = (F.col("bytes") >= revisit_from) & F.col("first_id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first_id"))
    target = F.coalesce(F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")), F.lit(""))
    revisit = F.coalesce(later, F.lit(False))
    header = _header(
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _urn(F.col("id"))),
        _line("WARC-Target-URI", target),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, _line("WARC-Refers-To", _urn(F.col("first_id")))),
        F.when(revisit, _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))))
    marked.select(F.col("id").alias("record_id"), header.alias("header"), "digest") \
        .write.parquet(f"{folder}/{HEADERS}")


def read_headers(spark: SparkSession, folder: str) -> DataFrame:
    """Record headers as written, with what their lines say: record_type, target, refers_to, length."""
    headers = spark.read.schema("record_id long, header string, digest string").parquet(f"{folder}/{HEADERS}")
    number = F.regexp_extract(_field(F.col("header"), "WARC-Refers-To"), r"<urn:record:(-?\d+)>", 1)
    return headers.select(
        "record_id", "header", F.regexp_extract("header", r"\r\nWARC-Payload-Digest: sha256:([0-9a-f]{64})", 1).alias("digest"),
        _field(F.col("header"), "WARC-Type").alias("record_type"),
        _field(F.col("header"), "WARC-Target-URI").alias("target"),
        F.when(F.length(number) > 0, number.cast("long")).alias("refers_to"),
        _field(F.col("header"), "Content-Length").cast("long").alias("length"))


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """Stored payloads, each checked: a payload that doesn't give its digest fails the job."""
    stored = spark.read.schema("digest string, payload binary").parquet(f"{folder}/{PAYLOADS}")
    actual = F.sha2("payload", 256)
    checked = F.when(actual == F.col("digest"), actual) \
        .otherwise(F.raise_error(F.concat(F.lit("payload does not match its digest "), F.col("digest"))))
    return stored.select(checked.alias("digest"), "payload")


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """The original records: header lines, the full payload, and `record`, the exact bytes of the WARC record."""
    payloads = read_payloads(spark, folder).select(own_shuffle(F.col("digest")).alias("key"), "payload")
    joined = read_headers(spark, folder).withColumn("key", own_shuffle(F.col("digest"))).join(payloads, "key").drop("key")
    block = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return joined.withColumn("record", F.concat(F.encode("header", "UTF-8"), block, F.lit((CRLF * 2).encode())))


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record with digest and byte count of its full payload, read without multiplying payloads."""
    sizes = read_payloads(spark, folder) \
        .select(own_shuffle(F.col("digest")).alias("key"), F.octet_length("payload").cast("long").alias("payload_bytes"))
    return read_headers(spark, folder).withColumn("key", own_shuffle(F.col("digest"))).join(sizes, "key").drop("key")
