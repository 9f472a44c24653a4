"""Mixing sources to target weights by repeating documents."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.sources.workspace import stored
from shelfmark.operators.ranking import position_within

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Words between ASCII blanks; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3) -> DataFrame:
    """(source, source_size, target, rate) from (source, size) rows.

    Sources in code point order, null last, weigh `weights` in turn and share the sum of all sizes. A target stops at
    `most` times its source's size, and the excess is shared by weight among the others until none is above: with
    targets min(cap, level * weight) the level rises until they add up. Each round is one aggregate over the sources;
    a round that caps no further source is the last. Rate is target / size, 0 for a source without words.
    """
    sources = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    placed = position_within(sources, [], [F.col("source").asc_nulls_last()], "position")
    weight = F.get(F.array(*map(F.lit, weights)), ((F.col("position") - 1) % len(weights)).cast("int"))
    weighted = stored(placed.select("source", "source_size", weight.cast("long").alias("weight"),
                                    (F.col("source_size") * most).alias("cap")), "mix-weights")

    def round_from(level: float) -> tuple[float, int]:
        capped = F.col("cap") <= F.lit(level) * F.col("weight")
        got = weighted.agg(F.sum("source_size"), F.sum(F.when(capped, F.col("cap")).otherwise(0)),
                           F.sum(F.when(capped, 0).otherwise(F.col("weight"))), F.count_if(capped)).first()
        total, fixed, free, n_capped = (x or 0 for x in got)
        return ((total - fixed) / free if free else float("inf")), n_capped

    level, n_capped = round_from(-1.0)
    while True:
        following, now_capped = round_from(level)
        if now_capped == n_capped or following == float("inf"):
            break
        level, n_capped = following, now_capped
    if level == float("inf"):
        level = 0.0
    share = F.lit(level) * F.col("weight")
    target = F.when(F.col("cap") <= share, F.col("cap").cast("double")).otherwise(share)
    rate = F.when(F.col("source_size") > 0, F.least(target / F.col("source_size"), F.lit(float(most)))).otherwise(0.0)
    return weighted.select("source", "source_size", target.alias("target"), rate.alias("rate"))


def copies(rate: Column, key: Column, seed: int) -> Column:
    """floor(rate) copies and one more with probability equal to the fraction, drawn from a hash of seed and key."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit(""))))
    draw = F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(16 ** 13)
    whole = F.floor(rate)
    return (whole + F.when(draw < rate - whole, 1).otherwise(0)).cast("long")


RESULTS = ("_size", "_source_size", "_target", "_copies")


def unused(columns: list[str], name: str) -> str:
    """`name`, with underscores before it until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def draw_key(doc_id: Column, text: Column) -> Column:
    """What a document is drawn by: its id and its text, so rows without an id, or that share one, draw each for itself."""
    return F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))


def mix(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), most: int = 3, seed: int = 42,
        doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """`docs` with _size, _source_size, _target and _copies: how often the mix takes each document.

    Null texts have no words; null sources are one source, the last; repeated rows count as often as they occur, and
    rows with one doc_id (or none) draw by their texts: only rows equal in both draw alike. An empty table gives no
    rows. All other columns are kept, whatever their names; columns named like the four results are replaced by them.
    Documents keep their order on disk and aren't shuffled as long as Spark can broadcast the sources; beyond that
    its skew join splits a hot source.
    """
    kept = docs.drop(*[c for c in docs.columns if c.lower() in RESULTS])
    key, rate = unused(kept.columns, "_key"), unused(kept.columns, "_rate")
    sized = kept.withColumn("_size", word_count(F.col(text)))
    targets = source_targets(sized.select(F.col(source).alias("source"), F.col("_size").alias("size")), weights, most)
    named = stored(targets.select(F.struct(F.col("source").alias("key")).alias(key), F.col("source_size").alias("_source_size"),
                                  F.col("target").alias("_target"), F.col("rate").alias(rate)), "mix-targets")
    joined = sized.withColumn(key, F.struct(F.col(source).alias("key"))).join(named, key).drop(key)
    drawn = copies(F.col(rate), draw_key(F.col(doc_id), F.col(text)), seed)
    return joined.withColumn("_copies", drawn).drop(rate)


def repeat(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mixed corpus itself: each document as often as `mix` takes it."""
    copy = unused(mixed.columns, "_copy")
    taken = mixed.where("_copies > 0")
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*columns)
