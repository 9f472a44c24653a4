"""From raw documents to token ids, in five stages of the training-data operators."""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfmark.llm import bpe, langid, mixing, simhash, substrings
from shelfmark.llm.production import LANGUAGES, VOCABULARY
from shelfmark.operators.keys import own_shuffle
from shelfmark.sources.tables import read_table
from shelfmark.sources.workspace import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents found to be in one of the languages, from text, declared language and source."""
    model = langid.fit(docs, LANGUAGES)
    judged = langid.identify(docs, LANGUAGES, model, declared=F.col("lang"), host=F.col("source"))
    return judged.where("_accepted").select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id; of rows in it that share it, the least.

    Documents without an id stay as long as their class has no document with one; such a class keeps one.
    """
    found = simhash.near_duplicates(docs.select("doc_id", "text"))
    kept = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select("fp", "root", "component_id").distinct() \
        .select(own_shuffle(F.col("fp")).alias("_key"), "root", "component_id")
    marked = docs.select(*COLUMNS).withColumn("_key", own_shuffle(simhash.fingerprints(F.col("text"))))
    stay = marked.join(kept, "_key").where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    return stay.groupBy("root").agg(F.min(F.struct(*COLUMNS)).alias("row")).select("row.*")


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages found before; a document of which nothing but white space is left goes."""
    found = substrings.remove_repeats(docs)
    cut = F.size("removed_spans") > 0
    whole = found.where(~cut | F.rlike("text", F.lit(r"(?U)\S")))
    return whole.withColumn("n_chars", F.when(cut, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target weight asks for."""
    return mixing.repeat(mixing.mix(docs), COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each copy of a document, checked to decode to its text."""
    ranks = bpe.load(public_tokenizers.path(VOCABULARY))
    encoded = bpe.encode(docs.withColumn("_sha", F.sha2(F.coalesce("text", F.lit("")), 256)), ranks, public_tokenizers.PATTERN,
                         keep=["doc_id", "source", "_sha"])
    same = F.sha2(bpe.decode(F.col("_ids"), ranks), 256) == F.col("_sha")
    checked = F.when(same, F.col("_ids")).otherwise(F.raise_error(F.lit("token ids do not decode to their text")))
    return encoded.select("doc_id", "source", checked.alias("ids")).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup),
          ("source_mixing", source_mixing), ("tokenize", tokenize)]

# Fingerprints, a trained model and merges of byte pairs: no SQL can say these rows; tests compare them by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows the last stage makes of all documents; each stage is written and read again by the next."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
