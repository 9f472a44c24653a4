"""Near-duplicates by SimHash fingerprints and multi-index hashing.

A 64-bit fingerprint is two segments of 32 bits. Of two fingerprints with at most 4 differing bits, the high segments
differ in at most 2 bits or the low segments in at most 1: otherwise they would differ in 3 + 2 bits. So the table of
each segment is probed with small Hamming balls. For 2 bits both sides enumerate the ball of radius 1 and meet in the
middle (33 keys a fingerprint, not 529); for 1 bit one side does. Every match is verified on all 64 bits.
"""

import re
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.llm.components import connected_components
from shelfmark.operators.keys import own_shuffle
from shelfmark.sources.workspace import stored

MAX_BITS = 4
HALF = 0xFFFFFFFF
DENSE = 128           # fingerprints with one segment value from which its buckets are linked by centres
CHUNK = 1 << 20       # bytes of text cut into words at once
_BLANK = re.compile(rb"[ \t-\r]")


def _pieces(text: bytes):
    """The text in pieces of about CHUNK bytes, cut at blanks."""
    start = 0
    while start < len(text):
        cut = _BLANK.search(text, min(start + CHUNK, len(text)))
        end = cut.end() if cut else len(text)
        yield text[start:end]
        start = end


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """The SimHash of UTF-8 text as a signed 64-bit number.

    A bit is set if it is set in over half the hashes of the shingles, repeats included. Words lie between ASCII
    blanks, A-Z count as a-z. Fewer words than a shingle are one shingle; without words the result is 0.
    """
    ones, n, carried = np.zeros(64, dtype=np.int64), 0, []
    for piece in _pieces(text):
        words = carried + piece.lower().split()
        if len(words) >= shingle:
            joined = b" ".join(words)
            starts = [0, *accumulate(len(w) + 1 for w in words)]
            hashes = np.array([xxhash.xxh64_intdigest(joined[a:b - 1], seed)
                               for a, b in zip(starts, starts[shingle:])], dtype="<u8")
            ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            n += len(hashes)
            words = words[len(words) - shingle + 1:]
        carried = words
    if not n:
        if not carried:
            return 0
        whole = np.array([xxhash.xxh64_intdigest(b" ".join(carried), seed)], dtype="<u8")
        return int(whole.view("<i8")[0])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprints(text: Column, shingle: int = 4, seed: int = 42) -> Column:
    """The fingerprint of each text; null text has none of the words and so fingerprint 0."""
    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array([fingerprint(t or b"", shingle, seed) for t in texts.cast(pa.binary()).to_pylist()], pa.int64())
    return of(text)


def _ball(segment: Column, radius: int) -> Column:
    """All 32-bit values within `radius` of the segment."""
    masks = [sum(1 << i for i in bits) for r in range(radius + 1) for bits in combinations(range(32), r)]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: segment.bitwiseXOR(m))


def _distance(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _dense_values(table: DataFrame, segment: str) -> DataFrame:
    return table.groupBy(segment).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > DENSE).select(segment)


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) that connect the distinct fingerprints `fp` at most 4 bits apart.

    Every such pair gets an edge, or, if it lies in a dense part, both ends get an edge to a third fingerprint of the
    same class. Dense are buckets around a segment value that over DENSE fingerprints have: there, pairs would grow
    with the square of the bucket. Their fingerprints enumerate all 2,081 centres within 2 bits instead, and each is
    tied to the smallest fingerprint of its centres: two fingerprints share a centre just if they are at most 4 bits
    apart. A bucket outside holds at most 33 * DENSE fingerprints.
    """
    if max_bits != MAX_BITS:
        raise ValueError("the two segments and their radii are made for 4 bits")
    table = prints.select("fp", F.shiftrightunsigned("fp", 32).alias("high"), F.col("fp").bitwiseAND(HALF).alias("low"))
    dense = {s: stored(_dense_values(table, s), f"dense-{s}") for s in ("high", "low")}
    edges, hot = [], None
    for segment, reach in (("high", 1), ("low", 0)):
        crowded = not dense[segment].isEmpty()
        probes = table.select(F.explode(_ball(F.col(segment), 1)).alias("key"), F.col("fp").alias("a"),
                              F.col(segment).alias("sa"))
        held = table.select((F.explode(_ball(F.col(segment), reach)) if reach else F.col(segment)).alias("key"),
                            F.col("fp").alias("b"), F.col(segment).alias("sb"))
        if crowded:
            crowds = dense[segment].select(F.explode(_ball(F.col(segment), 1)).alias("key")).distinct()
            near = dense[segment].select(F.explode(_ball(F.col(segment), 2)).alias(segment)).distinct()
            found = table.join(near, segment, "left_semi").select("fp")
            hot = found if hot is None else hot.unionByName(found)
            probes, held = probes.join(crowds, "key", "left_anti"), held.join(crowds, "key", "left_anti")
        steps = F.expr("int(sa <> key) + int(sb <> key)")
        # of the keys two fingerprints share, those on a shortest way between their segments
        pairs = probes.join(held, "key").where((_distance("a", "b") <= max_bits) & (steps == _distance("sa", "sb")))
        pairs = pairs.where("a < b") if reach else pairs.where("a <> b")
        edges.append(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    result = edges[0].unionByName(edges[1])
    if hot is not None:
        masks = [sum(1 << i for i in bits) for r in range(3) for bits in combinations(range(64), r)]
        signed = [m - (1 << 64) if m >> 63 else m for m in masks]
        centres = hot.distinct().select("fp", F.explode(F.transform(
            F.array(*[F.lit(m).cast("long") for m in signed]), lambda m: F.col("fp").bitwiseXOR(m))).alias("centre"))
        smallest = centres.groupBy("centre").agg(F.min("fp").alias("b"), F.max("fp").alias("most")).where("b < most")
        tied = centres.join(smallest.select(own_shuffle(F.col("centre")).alias("key"), "b"),
                            own_shuffle(F.col("centre")) == F.col("key"))
        result = result.unionByName(tied.select(F.col("fp").alias("a"), "b"))
    return result.distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = 4,
                    max_bits: int = MAX_BITS, seed: int = 42) -> DataFrame:
    """One row per document: its id, fp (signed), component_id, the smallest id reachable over linked fingerprints, and
    root, the smallest fingerprint so reachable, which names the class also where it has no id.

    Equal fingerprints are linked, those of texts without words (0) too. Null ids never are the smallest; a class of
    null ids only has a null component_id. Repeated rows each get a row. Other columns are left behind, whatever their
    names. An empty table gives no rows.

    Texts don't leave their tasks: only (id, fingerprint) rows are shuffled. Copies fold to one fingerprint by a
    grouping; candidates, links and classes are joins and groupings.
    """
    marked = stored(docs.select(F.col(doc_id).alias(doc_id), fingerprints(F.col(text), shingle, seed).alias("fp")), "prints")
    prints = stored(marked.groupBy("fp").agg(F.min(doc_id).alias("first")), "distinct-prints")
    classes = connected_components(links(prints.select("fp"), max_bits))
    rooted = prints.join(classes, prints["fp"] == classes["node"], "left") \
        .select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id")).select(own_shuffle(F.col("root")).alias("key"), "component_id")
    named = rooted.withColumn("key", own_shuffle(F.col("root"))).join(least, "key").select("fp", "component_id", "root")
    classed = named.select(own_shuffle(F.col("fp")).alias("key"), "component_id", "root")
    return marked.withColumn("key", own_shuffle(F.col("fp"))).join(classed, "key").select(doc_id, "fp", "component_id", "root")
