"""Language identification by fusing text, declared language, address suffix and host, each as log evidence.

    log P(language | document) = prior of the host + likelihood of the text + likelihood of the declared language

The prior is smoothed along a hierarchy: all documents, those with the same address suffix, those of the same host.
Its counts come from one grouped aggregation over all documents, by the language their text alone suggests.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.sources.workspace import stored

UNKNOWN = "und"
BITS = 16             # trigrams of bytes are hashed to so many bits
CHUNK = 1 << 20       # bytes scored at once
PER_LANGUAGE = 400    # documents a language's model is fitted on, at most
LONGEST = 20_000      # characters of a text that may be in that sample
FULL_EVIDENCE = 200   # trigrams after which more text makes no surer
TRUST = 0.9           # how often a declared language is right
STRENGTH = 20.0       # documents' worth of the level above in a host's or suffix's prior


def _buckets(text: bytes) -> np.ndarray:
    """Bucket of each trigram of bytes."""
    b = np.frombuffer(text, dtype=np.uint8).astype(np.uint32)
    codes = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
    return (codes * np.uint32(2654435761)) >> np.uint32(32 - BITS)


def _chunks(text: bytes):
    """Pieces that overlap by two bytes, so that they hold each trigram once."""
    lowered = text.lower()
    return (lowered[i:i + CHUNK + 2] for i in range(0, max(len(lowered) - 2, 0), CHUNK))


def _count(texts: list[bytes]) -> np.ndarray:
    counts = np.zeros(1 << BITS)
    for text in texts:
        for piece in _chunks(text):
            counts += np.bincount(_buckets(piece), minlength=1 << BITS)
    return counts


def fit(docs: DataFrame, languages: tuple[str, ...], doc_id: str = "doc_id", text: str = "text",
        declared: str = "lang", per_language: int = PER_LANGUAGE) -> np.ndarray:
    """Log likelihood per bucket (rows) and language (columns), and of `UNKNOWN`, for which all trigrams are alike.

    Fitted on at most `per_language` documents declared to be in each language, of at most LONGEST characters, the
    first in the order of a hash of their ids. A language without documents is as `UNKNOWN`.
    """
    eligible = docs.where(F.col(declared).isin(*languages) & (F.char_length(text) <= LONGEST) & F.col(doc_id).isNotNull())
    order = Window.partitionBy("language").orderBy("rank", "id")
    chosen = eligible.select(F.col(declared).alias("language"), F.col(doc_id).alias("id"), F.xxhash64(doc_id).alias("rank")) \
        .withColumn("n", F.row_number().over(order)).where(F.col("n") <= per_language).select("id").distinct()
    sample = eligible.select(F.col(doc_id).alias("id"), F.col(declared).alias("language"), F.col(text).alias("text")) \
        .join(F.broadcast(chosen), "id", "left_semi")      # at most per_language ids for each language

    def counted(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        counts = _count(table["text"].cast(pa.binary()).to_pylist())
        return pa.table({"language": [key[0].as_py()], "counts": [counts]})
    found = sample.groupBy("language").applyInArrow(counted, "language string, counts array<double>")
    model = np.full((1 << BITS, len(languages) + 1), -BITS * np.log(2.0))
    for row in found.collect():                            # one row for each language
        counts = np.array(row["counts"])
        model[:, languages.index(row["language"])] = np.log((counts + 0.05) / (counts.sum() + 0.05 * len(counts)))
    return model.astype(np.float32)


def likelihoods(spark, model: np.ndarray, text: Column) -> Column:
    """Array of log likelihoods of a text by class; null where it has no trigram. The whole text counts."""
    shared = spark.sparkContext.broadcast(model)           # 65,536 rows whatever the corpus

    @F.arrow_udf("array<double>")
    def of(texts: pa.Array) -> pa.Array:
        rows = []
        for t in texts.cast(pa.binary()).to_pylist():
            n = max(len(t or b"") - 2, 0)
            total = sum((shared.value[_buckets(piece)].sum(axis=0, dtype=np.float64) for piece in _chunks(t or b"")), 0.0)
            rows.append((total * min(1.0, FULL_EVIDENCE / n)).tolist() if n else None)
        return pa.array(rows, pa.list_(pa.float64()))
    return of(text)


def _best(scores: Column) -> Column:
    """Place of the largest score, the first of ties."""
    return F.array_position(scores, F.array_max(scores)) - 1


def _smoothed(counts: Column, above: Column) -> Column:
    """Shares of the classes among counts, with STRENGTH documents shared out as on the level above."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.zip_with(counts, above, lambda c, p: (c + p * STRENGTH) / (total + STRENGTH))


def priors(found: DataFrame, classes: int) -> DataFrame:
    """(host, suffix, class) of all documents -> (host, suffix, prior): class shares smoothed along the hierarchy.

    A host is read together with its suffix. Nulls are a host and a suffix of their own.
    """
    one_hot = [F.count_if(F.col("class") == k).cast("double") for k in range(classes)]
    hosts = stored(found.groupBy("host", "suffix").agg(F.array(*one_hot).alias("counts")), "host-counts")
    sums = [F.sum(F.get("counts", F.lit(k))) for k in range(classes)]
    total = [x or 0.0 for x in hosts.agg(*sums).first()]       # one number for each class
    shares = [(x + STRENGTH / classes) / (sum(total) + STRENGTH) for x in total]
    overall = F.array(*map(F.lit, shares))
    suffixes = hosts.groupBy("suffix").agg(F.array(*sums).alias("suffix_counts")) \
        .select(F.struct("suffix").alias("suffix_key"), _smoothed(F.col("suffix_counts"), overall).alias("above"))
    joined = hosts.withColumn("suffix_key", F.struct("suffix")).join(suffixes, "suffix_key")
    return joined.select("host", "suffix", _smoothed(F.col("counts"), F.col("above")).alias("prior"))


def address_suffix(host: Column) -> Column:
    """The last label of a host name, lower-cased; null where there is none."""
    last = F.lower(F.substring_index(host, ".", -1))
    return F.when(F.contains(host, F.lit(".")) & (last != ""), last)


def markup_language(html: Column) -> Column:
    """Primary language subtag that the first `<html>` tag declares, lower-cased; null without one."""
    found = F.regexp_extract(html, r"(?i)<html\b[^>]*?\slang\s*=\s*[\"']?([a-z]{2,3})\b", 1)
    return F.when(found != "", F.lower(found))


def identify(docs: DataFrame, languages: tuple[str, ...], model: np.ndarray, text: str = "text",
             declared: Column | None = None, host: Column | None = None, suffix: Column | None = None,
             least_confidence: float = 0.5) -> DataFrame:
    """`docs` with _language, _confidence and _accepted; all other columns and rows stay.

    Missing evidence (a null declared language or one not in `languages`, no host, no suffix) says nothing. A text
    without a trigram, as null and empty ones, is `UNKNOWN` with confidence 1. Accepted are texts in one of the
    languages with at least `least_confidence`. Ties go to the language named first. Repeated rows are judged alike;
    an empty table gives no rows. Texts stay where they are: only (host, suffix) counts are shuffled, and the priors
    come to the documents by a join that Spark broadcasts if it finds them small and deals out otherwise.
    """
    nothing = F.lit(None).cast("string")
    names = [*languages, UNKNOWN]
    declared, host, suffix = (nothing if c is None else c for c in (declared, host, suffix))
    scored = docs.withColumn("_scores", likelihoods(docs.sparkSession, model, F.col(text)))
    found = docs.select(host.alias("host"), suffix.alias("suffix"),
                        likelihoods(docs.sparkSession, model, F.col(text)).alias("scores")) \
        .where("scores is not null").select("host", "suffix", _best(F.col("scores")).alias("class"))
    table = stored(priors(found, len(names)), "priors").select(F.struct("host", "suffix").alias("_place"), F.col("prior").alias("_prior"))
    placed = scored.withColumn("_place", F.struct(host.alias("host"), suffix.alias("suffix"))).join(table, "_place", "left")

    prior = F.coalesce("_prior", F.array(*[F.lit(1.0 / len(names))] * len(names)))
    wrong = (1 - TRUST) / max(len(languages) - 1, 1)
    told = F.when(declared.isin(*languages), F.array(
        *[F.when(declared == name, TRUST).otherwise(wrong) for name in languages], F.lit(1.0 / len(languages)))) \
        .otherwise(F.array(*[F.lit(1.0)] * len(names)))
    evidence = F.zip_with(F.zip_with("_scores", prior, lambda s, p: s + F.ln(p)), told, lambda s, t: s + F.ln(t))
    fused = placed.withColumn("_evidence", evidence)
    top = F.array_max("_evidence")
    confidence = 1 / F.aggregate("_evidence", F.lit(0.0), lambda a, x: a + F.exp(x - top))
    language = F.get(F.array(*map(F.lit, names)), _best(F.col("_evidence")).cast("int"))
    return fused.withColumn("_language", F.coalesce(language, F.lit(UNKNOWN))) \
        .withColumn("_confidence", F.coalesce(confidence, F.lit(1.0))) \
        .withColumn("_accepted", (F.col("_language") != UNKNOWN) & (F.col("_confidence") >= least_confidence)) \
        .drop("_scores", "_place", "_prior", "_evidence")
