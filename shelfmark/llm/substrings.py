"""Repeated passages: sentences and whole lines, hashed over all documents, of which only the first occurrence stays."""

import re
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.keys import own_shuffle
from shelfmark.sources.workspace import stored

_SEPARATORS = {
    "sentence": re.compile(r"(?<=[.!?])\s+|\n+"),
    "line": re.compile(r"\n+"),
    "paragraph": re.compile(r"\n\s*\n\s*"),
}


class Unit(NamedTuple):
    start: int       # code points
    end: int         # of the unit with the separator behind it
    ends_line: bool


def _digest(joined: str) -> bytes:
    return xxhash.xxh3_128_digest(joined.encode("utf-8", "surrogatepass"))


def cut(text: str, unit: str = "sentence") -> list[Unit]:
    """The units of a text in order, by their offsets; those without words are left out.

    The last unit of a line of sentences ends it; lines and paragraphs end by themselves.
    """
    units, start = [], 0
    for match in _SEPARATORS[unit].finditer(text):
        end = match.end()
        if not (match.start() == start or text[start:match.start()].isspace()):
            units.append(Unit(start, end, unit != "sentence" or "\n" in match[0] or "\n" in text[start:end]))
        start = end
    if start < len(text) and not text[start:].isspace():
        units.append(Unit(start, len(text), True))
    elif units:
        units[-1] = units[-1]._replace(ends_line=True)
    return units


def lines_of(units: list[Unit]) -> list[tuple[int, int]]:
    """The first unit of each line, and the one behind its last."""
    ends = [i + 1 for i, u in enumerate(units) if u.ends_line]
    return list(zip([0, *ends[:-1]], ends))


def _numbered(text: str, unit: str, digests: list[bytes], whole: list[bool]) -> None:
    """Append a text's digests, and whether each is a whole line's: of its units, then of lines of several units.

    Case and white space don't count: a digest is 128 bits of XXH3 over the lower-cased words. A line of one sentence
    has the sentence's digest, and no sentence has that of a line of several.
    """
    units = cut(text, unit)
    words = [" ".join(text[u.start:u.end].lower().split()) for u in units]
    digests.extend(map(_digest, words))
    alone = [False] * len(units)
    lines = []
    for first, end in lines_of(units):
        if end == first + 1:
            alone[first] = True
        else:
            lines.append(_digest(" ".join(words[first:end])))
    digests.extend(lines)
    whole.extend(alone)
    whole.extend([True] * len(lines))


def _digests(text: Column, unit: str) -> Column:
    """Digests of a text by their numbers, as one flat array for a batch of texts."""
    @F.arrow_udf("array<struct<high:long,low:long,whole:boolean>>")
    def of(texts: pa.Array) -> pa.Array:
        digests: list[bytes] = []
        whole: list[bool] = []
        ends = [0]
        for t in texts:
            _numbered(t.as_py() or "", unit, digests, whole)
            ends.append(len(digests))
        halves = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2).astype(np.int64)
        flat = pa.StructArray.from_arrays([pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array(whole, pa.bool_())],
                                          ["high", "low", "whole"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
    return of(text)


def without(text: str, later: list[int], later_lines: list[int], unit: str, min_words: int) -> list[tuple[int, int]]:
    """The spans to remove from a text, in order.

    `later` are numbers of units found before, `later_lines` of those that are whole lines, and were one before. Lines go
    whatever their length. Sentences next to each other are one passage, which goes from `min_words` words on.
    """
    units = cut(text, unit)
    several = [x for x in lines_of(units) if x[1] > x[0] + 1]
    gone = {i for n in later_lines for i in ([n] if n < len(units) else range(*several[n - len(units)]))}
    repeated = sorted(i for i in gone.union(later) if i < len(units))
    at = 0
    while at < len(repeated):
        end = at + 1
        while end < len(repeated) and repeated[end] == repeated[end - 1] + 1:
            end += 1
        run = repeated[at:end]
        if not gone.issuperset(run) and sum(len(text[units[i].start:units[i].end].split()) for i in run) >= min_words:
            gone.update(run)
        at = end
    spans: list[tuple[int, int]] = []
    last = None
    for i in sorted(gone):
        if last is not None and i == last + 1:
            spans[-1] = (spans[-1][0], units[i].end)
        else:
            spans.append((units[i].start, units[i].end))
        last = i
    return spans


def _cleaned(text: Column, later: Column, lines: Column, unit: str, min_words: int) -> Column:
    """Texts without their repeats, and the spans removed."""
    @F.arrow_udf("struct<text:string,spans:array<struct<start:int,end:int>>>")
    def of(texts: pa.Array, lists: pa.Array, whole: pa.Array) -> pa.Array:
        kept: list[str | None] = []
        spans: list[tuple[int, int]] = []
        ends = [0]
        for t, repeats, again in zip(texts, lists, whole):
            t = t.as_py()
            found = without(t, repeats.as_py(), again.as_py(), unit, min_words) if t is not None and repeats.is_valid else []
            if found:
                starts = [0, *(end for _, end in found)]
                t = "".join(t[a:b] for a, b in zip(starts, [*(start for start, _ in found), len(t)]))
            kept.append(t)
            spans.extend(found)
            ends.append(len(spans))
        flat = np.array(spans, np.int32).reshape(-1, 2)
        pairs = pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], ["start", "end"])
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pairs)], ["text", "spans"])
    return of(text, later, lines)


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", unit: str = "sentence",
                   min_words: int = 10) -> DataFrame:
    """`docs` with the text cut down to first occurrences, and `removed_spans`, offsets into the original text.

    A unit's first occurrence is that in the document with the smallest id, and there the first; all later ones are
    repeats, in the same document too. Every repeat of a whole line (or paragraph, if those are the units) is removed,
    whatever its length; of sentences, passages of neighbouring repeats with at least `min_words` words are.
    Null ids rank after all others. Rows that share an id, or have none, are documents of their own, in the order in
    which they are stored. Null texts stay null. Without repeats a text stays as it is, to the character. All other
    columns are kept, whatever their names, but a removed_spans is replaced; an empty table gives no rows.

    The documents are written once, with a number for each row. Digests with (id, row, place) are grouped, folding
    before the shuffle; only digests found twice meet their occurrences again, on a key of their own that the adaptive
    planner can split.
    """
    kept = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = stored(docs.select(kept.alias("kept"), F.monotonically_increasing_id().alias("row")), "rows", "zstd")
    own, words = F.col(f"kept.`{doc_id}`"), F.col(f"kept.`{text}`")
    order = [own.isNull().alias("none"), own.alias("id"), F.col("row")]
    places = rows.where(words.isNotNull()).select(*order, F.posexplode(_digests(words, unit)).alias("number", "unit")) \
        .select(F.struct("none", "id", "row", "number").alias("place"), "unit.*")
    firsts = places.groupBy("high", "low").agg(
        F.min("place").alias("first"), F.min(F.when(F.col("whole"), F.col("place"))).alias("first_line"), F.count(F.lit(1)).alias("n")).where("n > 1")
    key = own_shuffle(F.struct("high", "low"))
    later = places.withColumn("key", key).join(firsts.select(key.alias("key"), "first", "first_line"), "key") \
        .where(F.col("place") > F.col("first"))
    line = F.col("whole") & (F.col("place") > F.col("first_line"))
    per_row = later.groupBy(F.col("place.row").alias("row")).agg(
        F.collect_list("place.number").alias("later"), F.collect_list(F.when(line, F.col("place.number"))).alias("lines"))
    joined = rows.join(per_row, "row", "left").select("kept", _cleaned(words, F.col("later"), F.col("lines"), unit, min_words).alias("clean"))
    columns = [F.col("clean.text").alias(c) if c == text else F.col(f"kept.`{c}`").alias(c) for c in docs.columns if c != "removed_spans"]
    return joined.select(*columns, F.col("clean.spans").alias("removed_spans"))
