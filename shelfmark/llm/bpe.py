"""Byte-level BPE: the distinct words of some texts at a time are merged together, texts are put together from them.

A text is cut into pieces by the tokenizer's pattern, here called words. Each task encodes the distinct words of as many
texts at once as have KNOWN words in all: the bytes of every word become ids, and in rounds over all of these words the pair of
neighbours with the lowest rank in each is merged, until none has a rank. Texts and words don't leave their tasks, no word
reaches the driver, and the ranks are a broadcast, not a part of the plan.
"""

import base64
import heapq
from collections.abc import Callable, Iterator
from functools import cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KNOWN = 1 << 20       # words, repeats included, of the texts whose words a task holds with their ids at once
LONG = 64             # bytes; longer words are merged with a heap, as the rounds take time by the square of the length
MERGED = 1 << 16      # distinct words merged in the same rounds


class Ranks(NamedTuple):
    """The ranks by piece, and as arrays: of single bytes and of merges.

    Merges of token a with b stand in one array at shift[a] + b as a * 2**16 + rank, so that a pair is found by two
    reads. The shifts are such that no two merges share a place.
    """
    of: dict[bytes, int]
    bytes: np.ndarray
    shift: np.ndarray
    merges: np.ndarray


@cache
def load(path: str) -> Ranks:
    """Ranks of a file with one base64 piece and its rank on each line. Ranks are 0, 1, 2 ... below 65,536."""
    with open(path, "rb") as lines:
        ranks = {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, lines)}
    if sorted(ranks.values()) != list(range(len(ranks))) or len(ranks) >= 1 << 16:
        raise ValueError("ranks must be 0, 1, 2 ... below 65536")
    after: dict[int, list[tuple[int, int]]] = {}
    for piece, rank in ranks.items():
        for i in range(1, len(piece)):
            if piece[:i] in ranks and piece[i:] in ranks:
                after.setdefault(ranks[piece[:i]], []).append((ranks[piece[i:]], rank))
    return Ranks(ranks, np.array([ranks[bytes([b])] for b in range(256)], np.int32), *_placed(after, len(ranks)))


def _placed(after: dict[int, list[tuple[int, int]]], size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shift of each token and the array of merges; tokens with the most merges are placed first."""
    span = 4 * max(size // 4, sum(map(len, after.values())))
    rng = np.random.default_rng(0)
    shift, merges = np.zeros(size, dtype=np.int32), np.full(span + size, -1, dtype=np.int64)
    for token, pairs in sorted(after.items(), key=lambda x: (-len(x[1]), x[0])):
        seconds, ranks = (np.array(x) for x in zip(*pairs))
        at = int(rng.integers(span))
        while (merges[at + seconds] >= 0).any():
            at = int(rng.integers(span))
        shift[token], merges[at + seconds] = at, (token << 16) + ranks
    return shift, merges


def merged(words: pa.Array, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Ids of words given as large binaries, one word's behind the other's, and how many each has.

    A round merges, in every word that has a pair with a rank, the pair of the lowest rank, of these the first.
    """
    if not len(words):
        return np.empty(0, np.int32), np.empty(0, np.int64)
    bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset:words.offset + len(words) + 1]
    text = np.frombuffer(words.buffers()[2] or b"", np.uint8)[bounds[0]:bounds[-1]]
    found, alive = ranks.bytes[text], np.ones(len(text), bool)
    ids, place, sizes = found, np.arange(len(text)), np.diff(bounds)     # of the words not done yet
    sizes = sizes[sizes > 0]
    while len(sizes):
        ends = np.cumsum(sizes)
        entry = ranks.merges[ranks.shift[ids] + np.append(ids[1:], 0)]
        ranked = entry >> 16 == ids
        ranked[ends - 1] = False                           # a word's last id has no neighbour
        pairs = np.where(ranked, (entry & 0xFFFF) << 32, 1 << 62) + np.arange(len(ids))
        best = np.minimum.reduceat(pairs, ends - sizes)
        more = best < 1 << 62
        at = best[more] & 0xFFFFFFFF
        ids[at] = found[place[at]] = best[more] >> 32
        alive[place[at + 1]] = False
        stay = np.repeat(more, sizes)
        stay[at + 1] = False
        ids, place, sizes = ids[stay], place[stay], sizes[more] - 1
    until = np.concatenate([[0], np.cumsum(alive)])
    return found[alive], np.diff(until[bounds - bounds[0]])


def merged_by_heap(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a word of any length: the same merges, lowest rank first and of those the leftmost."""
    end = list(range(1, len(word) + 1))                    # of the part that starts here
    before = list(range(-1, len(word) - 1))
    alive = [True] * len(word)
    queue: list[tuple[int, int, int]] = []

    def offer(a):
        b = end[a]
        if b < len(word) and (rank := ranks.get(word[a:end[b]])) is not None:
            heapq.heappush(queue, (rank, a, end[b]))
    for a in range(len(word)):
        offer(a)
    while queue:
        _, a, stop = heapq.heappop(queue)
        if not alive[a] or end[a] >= len(word) or end[end[a]] != stop:
            continue                                       # one of the two parts has changed since
        b = end[a]
        alive[b], end[a] = False, stop
        if stop < len(word):
            before[stop] = a
        offer(a)
        if before[a] >= 0:
            offer(before[a])
    return [ranks[word[a:end[a]]] for a in range(len(word)) if alive[a]]


# Code points from which Java's older Unicode tables miss letters or numbers; all others it classes alike.
_NEWER = [(0x0870, 0x08C9), (0x0C5D, 0x0C5D), (0x0CDD, 0x0CDD), (0x170D, 0x171F), (0x1B4C, 0x1B4C), (0x1C89, 0x1C8A),
          (0x2C2F, 0x2C5F), (0x9FFD, 0x9FFF), (0xA7C0, 0xA7F4), (0x10000, 0x10FFFF)]


def _java(ranges) -> str:
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in ranges)


@cache
def _classed(kind: str) -> str:
    """The class `kind` of the tokenizer's own pattern matcher within _NEWER, as ranges for Java."""
    probe = tiktoken.Encoding("class", pat_str=kind, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    ranges: list[list[int]] = []
    for a, b in _NEWER:
        for point in range(a, b + 1):
            if probe.encode_ordinary(chr(point)):
                if ranges and ranges[-1][1] == point - 1:
                    ranges[-1][1] = point
                else:
                    ranges.append([point, point])
    return _java(ranges)


def words(text: Column, pattern: str) -> Column:
    """Matches of the tokenizer's pattern in a text, in order; none in a null text.

    Texts with a code point that Java may class otherwise go through a pattern with the classes spelled out. Most texts
    have none above the first range, which a test of one range finds out sooner.
    """
    letters, numbers = _classed(r"\p{L}"), _classed(r"\p{N}")
    spelled = pattern.replace(r"[^\s\p{L}\p{N}]", rf"[^\s\p{{L}}\p{{N}}{letters}{numbers}]") \
        .replace(r"\p{L}+", rf"[\p{{L}}{letters}]+").replace(r"\p{N}+", rf"[\p{{N}}{numbers}]+")
    odd = F.rlike(text, F.lit(rf"[^\x00-\x{{{_NEWER[0][0] - 1:X}}}]")) & F.rlike(text, F.lit(f"[{_java(_NEWER)}]"))
    found = F.when(odd, F.regexp_extract_all(text, F.lit("(?U)" + spelled), F.lit(0))) \
        .otherwise(F.regexp_extract_all(text, F.lit("(?U)" + pattern), F.lit(0)))
    return F.coalesce(found, F.array().cast("array<string>"))


def _ids(words: pa.Array, ranks: Ranks, long: int) -> pa.ListArray:
    """Ids of each of the words, given as large binaries."""
    heaped = np.array(pc.greater(pc.binary_length(words), long))
    rest = words.filter(pa.array(~heaped))
    parts = [merged(rest.slice(at, MERGED), ranks) for at in range(0, max(1, len(rest)), MERGED)]
    slow = [np.array(merged_by_heap(w, ranks.of), np.int32) for w in words.filter(pa.array(heaped)).to_pylist()]
    counts = np.empty(len(words), np.int64)
    counts[~heaped], counts[heaped] = np.concatenate([n for _, n in parts]), [len(ids) for ids in slow]
    flat, of_slow = np.empty(counts.sum(), np.int32), np.repeat(heaped, counts)
    flat[~of_slow] = np.concatenate([ids for ids, _ in parts])
    if slow:
        flat[of_slow] = np.concatenate(slow)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat))


def _encoder(shared, known: int, long: int) -> Callable:
    """Batches of texts' words -> a row for each text with its ids, in batches of at most `known` words or of one text."""
    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words")
            ends = np.cumsum(np.array(lists.value_lengths()), dtype=np.int64)
            at = 0
            while at < batch.num_rows:
                begun = ends[at - 1] if at else 0
                n = max(1, int(np.searchsorted(ends, begun + known, "right")) - at)
                coded = lists.slice(at, n).flatten().dictionary_encode()
                taken = _ids(coded.dictionary.cast(pa.large_binary()), shared.value, long).take(coded.indices)
                offsets = np.array(taken.offsets)[np.concatenate([[0], ends[at:at + n] - begun])]
                ids = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), taken.values)
                yield pa.RecordBatch.from_arrays([batch.column("kept").slice(at, n), ids], ["kept", "ids"])
                at += n
    return encoded


def encode(docs: DataFrame, ranks: Ranks, pattern: str, text: str = "text", keep: list[str] | None = None,
           known: int = KNOWN) -> DataFrame:
    """`docs` with _ids, the ids of the whole text, instead of the text; no special tokens.

    Null and empty texts have no ids. `keep` names the columns to keep, all but the text unless given; their names
    may be any but _ids. Rows stay rows, repeated ones too; an empty table gives no rows. Nothing is shuffled or
    collected. A task encodes as many texts together as have at most `known` words, and at least one.
    """
    columns = [c for c in docs.columns if c != text] if keep is None else keep
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    kept = F.struct(F.lit(True).alias("_here"), *[F.col(f"`{c}`") for c in columns])
    lists = docs.select(kept.alias("kept"), words(F.col(text), pattern).alias("words"))
    kind = lists.schema["kept"].dataType.simpleString()
    done = lists.mapInArrow(_encoder(shared, known, LONG), f"kept {kind}, ids array<int>")
    return done.select(*[F.col(f"kept.`{c}`").alias(c) for c in columns], F.col("ids").alias("_ids"))


def _bounds(lists: pa.ListArray) -> np.ndarray:
    """Where each list begins in the flat array, and where the last ends."""
    return np.concatenate([[0], np.cumsum(np.array(pc.fill_null(pc.list_value_length(lists), 0)))]).astype(np.int64)


def _parted(data: pa.Buffer, bounds: np.ndarray, lists: pa.ListArray) -> pa.Array:
    """Binary values between the bounds of one buffer; null where the list is."""
    whole = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(bounds), data])
    return pc.if_else(lists.is_valid(), whole, pa.scalar(None, pa.large_binary())).cast(pa.binary())


def decode(ids: Column, ranks: Ranks) -> Column:
    """The bytes of ids: their binary pieces, one behind the other; null ids give null."""
    pieces = pa.array(sorted(ranks.of, key=ranks.of.get), pa.large_binary())

    @F.arrow_udf("binary")
    def of(lists: pa.Array) -> pa.Array:
        taken = pieces.take(lists.flatten())
        ends = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset:taken.offset + len(taken) + 1]
        return _parted(taken.buffers()[2], ends[_bounds(lists)].copy(), lists)
    return of(ids)


def packed(ids: Column) -> Column:
    """Ids as little-endian unsigned 32-bit integers; null ids give null."""
    @F.arrow_udf("binary")
    def of(lists: pa.Array) -> pa.Array:
        return _parted(pa.py_buffer(np.array(lists.flatten()).astype("<u4")), 4 * _bounds(lists), lists)
    return of(ids)
