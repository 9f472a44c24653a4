"""The trie of all prefixes of conversations, from whole sequences collapsed first.

Equal conversations become one weighted sequence, with the list of those that end there. Sequences that are proper
prefixes of others are no leaves, which an anti-join finds. Only the prefixes of distinct sequences are then aggregated,
each with its sequence's weight, into the trie's nodes.

A prefix is known by 128 bits: the exclusive or of one digest for each of its turns, which has the turn's place in it. So
prefixes of long conversations are made by windows over blocks of turns, and never by one task walking a conversation.
"""

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.operators.keys import own_shuffle
from shelfmark.operators.ranking import position_within
from shelfmark.sources.workspace import stored

BLOCK = 1024           # turns, and ids in a list, that one group holds at most
KEY = ["depth", "high", "low"]


class Trie(NamedTuple):
    """The nodes; the weighted sequences (leaf: nothing longer starts with it); their lists of ends, in chunks."""
    nodes: DataFrame
    sequences: DataFrame
    ends: DataFrame


def turn_digest(role: Column, text: Column) -> Column:
    """Digest of a turn; null role or text is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)


def numbered_turns(conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, place, turn, chars): each row's place in its conversation, the turn's digest and the code points of its text.

    By turn, null first; rows with one turn by their digests, repeated rows one behind the other. Rows without a
    conversation's id belong to none and are left out, as are all other columns. Conversations may be of any length: rows
    are numbered in ranges.
    """
    narrow = conversations.where(F.col(conv_id).isNotNull()).select(
        F.col(conv_id).cast("long").alias("conv"), F.col(turn).alias("nr"), turn_digest(F.col(role), F.col(text)).alias("turn"),
        F.coalesce(F.char_length(text), F.lit(0)).cast("long").alias("chars"), F.monotonically_increasing_id().alias("row"))
    placed = position_within(stored(narrow, "turns", "zstd"), ["conv"], [F.col("nr").asc_nulls_first(), F.col("turn"), F.col("row")], "place")
    return stored(placed.select("conv", "place", "turn", "chars"), "numbered-turns", "zstd")


def rebuilt(turns: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations with the first `head` (0 to `most`) turns of conversation `base` for their own first `head` turns.

    Both are expressions on the column `conv`. A shorter base gives what it has, a missing one nothing. Returns rows
    (conv, depth, turn, chars) and all (conv, length), 0 for those with no turn left.
    """
    counted = turns.groupBy("conv").agg(F.max("place").alias("own")).select("conv", "own", base.alias("base"), head.cast("long").alias("head"))
    lengths = counted.select(F.col("conv").alias("base"), F.col("own").alias("base_own"))
    plan = stored(counted.join(lengths, "base", "left").withColumn("taken", F.least("head", F.coalesce("base_own", F.lit(0).cast("long"))))
                  .withColumn("length", F.col("taken") + F.greatest(F.col("own") - F.col("head"), F.lit(0).cast("long"))), "rebuilt-plan")
    bases = plan.select(F.col("base").alias("b")).distinct()
    heads = turns.where(F.col("place") <= most).join(bases, F.col("conv") == F.col("b"), "left_semi") \
        .select(F.col("conv").alias("base"), "place", "turn", "chars")
    first = plan.where("taken > 0").join(heads, "base").where("place <= taken") \
        .select("conv", F.col("place").alias("depth"), "turn", "chars", "length")
    shift = plan.where("own > head").select(own_shuffle(F.col("conv")).alias("key"), "head", "taken", "length")
    rest = turns.withColumn("key", own_shuffle(F.col("conv"))).join(shift, "key").where("place > head") \
        .select("conv", (F.col("taken") + F.col("place") - F.col("head")).alias("depth"), "turn", "chars", "length")
    return stored(first.unionByName(rest), "rebuilt", "zstd"), plan.select("conv", "length")


def _half(digest: Column, n: int) -> Column:
    return F.conv(F.substring(digest, 16 * n + 1, 16), 16, -10).cast("long")


def _running(rows: DataFrame, group: str, depth: str, columns: dict[str, tuple], backwards: bool = False) -> DataFrame:
    """Running aggregates along each group, by blocks of depth: within a block by a window, over whole blocks by another.

    `columns` has (aggregate, column, what nothing amounts to) by name; the aggregate of aggregates must be the whole.
    """
    block = F.call_function("div", F.col(depth).cast("long"), F.lit(BLOCK))
    step = F.desc if backwards else F.asc
    dealt = rows.withColumn("_block", block)
    within = Window.partitionBy(group, "_block").orderBy(step(depth)).rowsBetween(Window.unboundedPreceding, 0)
    inner = dealt.select("*", *[agg(F.col(c)).over(within).alias(f"_{name}") for name, (agg, c, _) in columns.items()])
    totals = dealt.groupBy(F.col(group).alias("_group"), F.col("_block").alias("_at")).agg(*[agg(F.col(c)).alias(name) for name, (agg, c, _) in columns.items()])
    before = Window.partitionBy("_group").orderBy(step("_at")).rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(F.struct(F.col("_group").alias("g"), F.col("_at").alias("b")).alias("_key"),
                            *[agg(F.col(name)).over(before).alias(f"_more_{name}") for name, (agg, c, _) in columns.items()])
    first = next(iter(columns))
    joined = inner.withColumn("_key", F.struct(F.col(group).alias("g"), F.col("_block").alias("b"))) \
        .join(carried.where(F.col(f"_more_{first}").isNotNull()), "_key", "left")
    done = [nothing(F.col(f"_{name}"), F.coalesce(f"_more_{name}", F.lit(0).cast("long"))).alias(name) for name, (_, _, nothing) in columns.items()]
    return joined.select(*rows.columns, *done)


def prefixes(turns: DataFrame) -> DataFrame:
    """`turns` (conv, depth, turn, ...) with (high, low), the digest of the turns up to each, and that of its parent."""
    tagged = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("turn")), 256)
    own = turns.withColumn("_own", tagged).withColumn("own_high", _half(F.col("_own"), 0)).withColumn("own_low", _half(F.col("_own"), 1)).drop("_own")

    def either(a, b):
        return a.bitwiseXOR(b)
    run = _running(own, "conv", "depth", {"high": (F.bit_xor, "own_high", either), "low": (F.bit_xor, "own_low", either)})
    return run.select(*turns.columns, "high", "low", F.col("high").bitwiseXOR(F.col("own_high")).alias("up_high"),
                      F.col("low").bitwiseXOR(F.col("own_low")).alias("up_low"))


def _key(*names: str, depth=None) -> Column:
    depth = F.col("depth") if depth is None else depth
    return F.struct(depth.alias("depth"), *[F.col(n).alias(k) for n, k in zip(names or KEY[1:], KEY[1:])])


def build(turns: DataFrame, lengths: DataFrame) -> Trie:
    """The trie over (conv, depth, turn, chars, length) rows, depth from 1 to length, and all (conv, length).

    A node has conv (its smallest member), depth, high and low (its key), up_high and up_low (its parent's), turn and
    chars (its last turn's digest and code points; none at the root), parent (its parent's conv), n_convs, n_children,
    n_leaves and saved: (n_convs - 1) * chars summed over its subtree. The root is there as soon as one conversation is,
    be it without turns; without any conversation there is no node.

    Copies fold into weights by partial aggregates before anything else. Hot prefixes fold likewise; joins to a hot
    parent or a long sequence go by keys of their own, which the adaptive planner can split.
    """
    marked = stored(prefixes(turns), "prefixes", "zstd")
    nothing = [F.lit(0).cast("long").alias(c) for c in KEY]
    last = marked.where("depth = length").select("conv", *KEY) \
        .unionByName(lengths.where("length = 0").select("conv", *nothing))
    ends = stored(last, "ends", "zstd")
    sequences = stored(ends.groupBy(*KEY).agg(F.min("conv").alias("conv"), F.count(F.lit(1)).alias("weight")), "sequences")

    chosen = sequences.select(own_shuffle(F.col("conv")).alias("key"), "weight")
    below = marked.withColumn("key", own_shuffle(F.col("conv"))).join(chosen, "key") \
        .select("conv", *KEY, "up_high", "up_low", "turn", "chars", "weight", "length")
    root = sequences.select("conv", *nothing, *[F.lit(None).cast("long").alias(c) for c in ("up_high", "up_low")],
                            F.lit(None).cast("string").alias("turn"), F.lit(0).cast("long").alias("chars"), "weight", F.col("depth").alias("length"))
    paths = stored(below.unionByName(root), "paths", "zstd")

    inner = paths.where("depth < length").select(_key().alias("key")).distinct()
    tips = sequences.withColumn("key", _key()).join(inner, "key", "left_anti")
    leaf = stored(tips.select("conv"), "leaves")
    nodes = paths.join(leaf.withColumn("leaf", F.lit(1)).select(own_shuffle(F.col("conv")).alias("k"), "leaf"), own_shuffle(F.col("conv")) == F.col("k"), "left") \
        .groupBy(*KEY).agg(F.min("conv").alias("conv"), F.sum("weight").alias("n_convs"), F.max("chars").alias("chars"), F.max("turn").alias("turn"),
                           F.min("up_high").alias("up_high"), F.min("up_low").alias("up_low"), F.count("leaf").alias("n_leaves"))
    nodes = stored(nodes.withColumn("own", (F.col("n_convs") - 1) * F.col("chars")), "nodes")

    # a node's smallest member is that of its subtree's nodes on the member's way down, so each node is on one sequence's account
    own = nodes.select("conv", "depth", "own")
    charged = paths.join(own, ["conv", "depth"], "left").select("conv", *KEY, F.coalesce("own", F.lit(0).cast("long")).alias("own"))
    down = _running(charged, "conv", "depth", {"saved": (F.sum, "own", lambda a, b: a + b)}, backwards=True)
    saved = down.groupBy(*KEY).agg(F.sum("saved").alias("saved"))

    up = _key("up_high", "up_low", depth=F.col("depth") - 1)
    children = nodes.where("depth > 0").select(up.alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("n_children"))
    parents = nodes.select(own_shuffle(_key()).alias("up"), F.col("conv").alias("parent"))
    whole = nodes.drop("own").join(saved, KEY).withColumn("key", _key()).join(children, "key", "left") \
        .withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))) \
        .withColumn("up", own_shuffle(up)).join(parents, "up", "left").drop("up", "key")
    flagged = sequences.join(leaf.withColumn("leaf", F.lit(True)), "conv", "left").withColumn("leaf", F.coalesce("leaf", F.lit(False)))
    return Trie(whole, flagged, _end_lists(ends))


def _end_lists(ends: DataFrame) -> DataFrame:
    """(depth, high, low, chunk, ids): the ids that end at a node, ascending, in lists of at most BLOCK."""
    placed = position_within(ends, KEY, [F.col("conv")], "place")
    chunk = F.call_function("div", F.col("place") - 1, F.lit(BLOCK)).alias("chunk")
    return stored(placed.groupBy(*KEY, chunk).agg(F.sort_array(F.collect_list("conv")).alias("ids")), "end-lists", "zstd")


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of lists that come chunk by chunk, a list's chunks in order one behind the other."""
    open_key, digest = None, None

    def closed():
        values = [*([v] for v in open_key), [digest.hexdigest()]]
        return pa.RecordBatch.from_arrays([pa.array(v) for v in values], [*KEY, "digest"])
    for batch in batches:
        for row in batch.to_pylist():
            key = tuple(row[k] for k in KEY)
            if key != open_key:
                if digest is not None:
                    yield closed()
                open_key, digest = key, hashlib.sha256(row["text"].encode())
            else:
                digest.update(b"," + row["text"].encode())
    if digest is not None:
        yield closed()


def end_digests(ends: DataFrame) -> DataFrame:
    """(depth, high, low, digest): SHA-256 of each list of ends, decimal and joined by commas.

    Lists of one chunk are hashed as they are. A digest of a longer one has to be made in order: its chunks go to one task,
    which holds one of them at a time.
    """
    texts = ends.select(*KEY, "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("text"))
    folded = texts.groupBy(*KEY).agg(F.max("chunk").alias("last"), F.min(F.when(F.col("chunk") == 0, F.col("text"))).alias("text"))
    short = folded.where("last = 0").select(*KEY, F.sha2("text", 256).alias("digest"))
    many = folded.where("last > 0").select(_key().alias("key"))
    long = texts.withColumn("key", _key()).join(many, "key", "left_semi").select(*KEY, "chunk", "text") \
        .repartition(*KEY).sortWithinPartitions(*KEY, "chunk")
    return short.unionByName(long.mapInArrow(_streamed, "depth long, high long, low long, digest string"))


def last_turns(nodes: DataFrame, conversations: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """`nodes` with the role and text of their last turns, from the conversations they were made of; null at the root."""
    texts = conversations.select(turn_digest(F.col(role), F.col(text)).alias("turn"), F.struct(
        F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")).alias("said")).groupBy("turn").agg(F.min("said").alias("said"))
    keyed = texts.select(own_shuffle(F.col("turn")).alias("key"), "said")
    return nodes.withColumn("key", own_shuffle(F.col("turn"))).join(keyed, "key", "left").drop("key") \
        .withColumns({"role": F.col("said.role"), "text": F.col("said.text")}).drop("said")
