"""A Merkle manifest of a table, kept as postorder logs.

Each tree hashes runs of ARITY nodes into the next level until one node is left. Its log holds the nodes in the order in
which they are completed while leaves are appended: a node stands right behind its subtree, so its position follows
from the sizes of the subtrees before it and no pointer is stored. Builders are aligned: one makes the STEPS levels over
ARITY ** STEPS neighbouring nodes, which lie next to each other in the log, and writes them as one section. The roots of
sections are the leaves of builders one tier above. A proof is read from the sections a leaf lies in, by position.
"""

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.operators.ranking import position_within
from shelfmark.sources.workspace import stored

ARITY = 3
STEPS = 6                     # levels a builder makes
WIDTH = ARITY ** STEPS        # nodes a builder takes: 729, so a section is some 80 kB
_POWERS = [ARITY ** k for k in range(40)]
PATH = "array<struct<place:int,others:array<string>>>"


class Manifest(NamedTuple):
    """Sections by tier, and the (tree, total) sizes of the trees.

    A section has tree, block (its number in the tier), total (leaves of the tree), inputs, height (levels made),
    nodes (digests in the order of completion, inputs among them) and, in the first tier, the rows kept for the leaves.
    """
    sections: list[DataFrame]
    sizes: DataFrame


def field(column: Column) -> Column:
    """A value with its length in front, so that no two lists of values read alike; `-` for null."""
    text = column.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def digest(*parts: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the parts, one behind the other."""
    return F.sha2(F.concat(*parts), 256)


def _div(a: Column, b) -> Column:
    return F.call_function("div", a.cast("long"), b if isinstance(b, Column) else F.lit(b))


def _let(value: Column, body) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _power(k: Column) -> Column:
    return F.get(F.array(*map(F.lit, _POWERS)), k.cast("int"))


def _ceil_div(a: Column, b: Column) -> Column:
    return _div(a + b - 1, b)


def height(leaves: Column) -> Column:
    """Levels above the leaves of a tree."""
    return F.size(F.filter(F.array(*map(F.lit, _POWERS)), lambda p: p < leaves))


def log_position(level: Column, end: Column, top: Column) -> Column:
    """Where in the log of a tree with `top` levels the node of a level stands whose last leaf is number `end` - 1.

    Once `end` leaves are in, level k has ceil(end / ARITY**k) nodes begun. Of the levels above the node's each has one
    not done yet, and the node itself is the last one done.
    """
    begun = F.aggregate(F.sequence(F.lit(0), top), F.lit(0).cast("long"), lambda n, k: n + _ceil_div(end, _power(k)))
    return begun - (top - level) - 1


def _ends(inputs: Column, level: Column) -> Column:
    """The leaf behind each node of a level, in order."""
    wide = _power(level)
    return F.transform(F.sequence(F.lit(1).cast("long"), _ceil_div(inputs, wide)), lambda i: F.least(i * wide, inputs))


def _parents(nodes: Column) -> Column:
    def run(i):
        return digest(F.array_join(F.slice(nodes, i * ARITY + 1, F.lit(ARITY)), ""))
    return F.transform(F.sequence(F.lit(0), _div(F.size(nodes) - 1, ARITY).cast("int")), run)


def _in_completion_order(inputs: Column, top: Column) -> Column:
    """Digests of the nodes over `inputs`, `top` levels of them, in the order in which they are completed."""
    size = F.size(inputs).cast("long")

    def grow(levels, _):
        return F.concat(levels, F.array(_let(F.element_at(levels, -1), _parents)))
    levels = F.aggregate(F.filter(F.sequence(F.lit(0), F.lit(STEPS - 1)), lambda k: k < top), F.array(inputs), grow)

    def placed(nodes, k):
        ends = _ends(size, k)
        return F.transform(F.arrays_zip(ends.alias("end"), nodes.alias("digest")),
                           lambda x: F.struct(log_position(k, x["end"], top).alias("position"), x["digest"].alias("digest")))
    return F.transform(F.sort_array(F.flatten(F.transform(levels, placed))), lambda x: x["digest"])


def _sections(inputs: DataFrame, sizes: DataFrame, tier: int) -> DataFrame:
    """Run the builders of a tier over (tree, place, digest, item) rows; no group has more than WIDTH of them."""
    def earlier(a, b):
        return F.when(a["place"] < b["place"], -1).when(a["place"] > b["place"], 1).otherwise(0)
    grouped = inputs.groupBy("tree", _div(F.col("place"), WIDTH).alias("block")) \
        .agg(F.collect_list(F.struct("place", "digest", "item")).alias("rows"))
    top = F.least(F.lit(STEPS), height(F.col("total")) - tier * STEPS)
    built = grouped.join(sizes, "tree").withColumn("rows", F.array_sort("rows", earlier)) \
        .select("tree", "block", "total", F.size("rows").alias("inputs"), top.alias("height"),
                _in_completion_order(F.col("rows.digest"), top).alias("nodes"), F.col("rows.item").alias("items"))
    return stored(built, "merkle-sections", "zstd")


def build(docs: DataFrame, leaf: Column, tree: Column, order: list[Column], keep: list[Column]) -> Manifest:
    """One tree for each value of `tree` (null is one), with the digests `leaf` of its rows in the given order.

    Rows that tie in the order come by their digests; equal rows are leaves of their own next to each other. `keep` are
    the columns to find again with each leaf. An empty table has no tree.

    Only digests, order and kept columns are written and shuffled. They are numbered in ranges, so that a hot tree or a
    hot group of equal rows is dealt to many tasks, then grouped by aligned blocks; each tier has a WIDTH-th of the
    rows of the one below.
    """
    by = [f"order_{i}" for i in range(len(order))]
    item = F.struct(F.lit(True).alias("_here"), *keep)
    rows = stored(docs.select(F.struct(tree.alias("key")).alias("tree"), leaf.alias("digest"), item.alias("item"),
                              *[o.alias(b) for o, b in zip(order, by)], F.monotonically_increasing_id().alias("row")), "merkle-leaves", "zstd")
    numbered = position_within(rows, ["tree"], [*[F.col(b).asc_nulls_first() for b in by], F.col("digest"), F.col("row")], "place")
    sizes = stored(rows.groupBy("tree").agg(F.count(F.lit(1)).alias("total")), "merkle-sizes")
    largest = sizes.agg(F.max("total")).first()[0] or 0
    inputs = numbered.select("tree", (F.col("place") - 1).alias("place"), "digest", "item")
    sections = [_sections(inputs, sizes, 0)]
    while WIDTH ** len(sections) < largest:
        going_on = sections[-1].where(F.col("total") > WIDTH ** len(sections))
        roots = going_on.select("tree", F.col("block").alias("place"), F.element_at("nodes", -1).alias("digest"),
                                F.lit(None).cast("boolean").alias("item"))
        sections.append(_sections(roots, sizes, len(sections)))
    return Manifest(sections, sizes)


def _tops(manifest: Manifest, tier: int) -> DataFrame:
    """Sections of a tier that end in the root of their tree."""
    tall = F.col("total") <= WIDTH ** (tier + 1)
    return manifest.sections[tier].where(tall & (F.col("total") > WIDTH ** tier) if tier else tall)


def roots(manifest: Manifest) -> DataFrame:
    """(tree, total, root) of each tree; a lone leaf is its root."""
    found = [_tops(manifest, t).select("tree", "total", F.element_at("nodes", -1).alias("root")) for t in range(len(manifest.sections))]
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every


def _paths(read) -> Column:
    """What `read` makes of each input's number, digest and path within a section, for all inputs of it.

    A path has a row for each level: the siblings from left to right, and how many stand left of the node.
    """
    size, top, nodes = F.col("inputs").cast("long"), F.col("height"), F.col("nodes")
    # nodes begun by each number of leaves, from which every position follows
    begun = F.transform(F.sequence(F.lit(0).cast("long"), size),
                        lambda end: F.aggregate(F.sequence(F.lit(0), top), F.lit(0).cast("long"), lambda n, k: n + _ceil_div(end, _power(k))))

    def of(begun):
        def node(level, i, wide):
            end = F.least((i + 1) * wide, size)
            return F.get(nodes, (F.get(begun, end.cast("int")) - (top - level) - 1).cast("int"))

        def one(i):
            def step(level):
                def within(wide):
                    own = _div(i, wide)
                    first = own - own % ARITY
                    last = F.least(first + ARITY, _ceil_div(size, wide)) - 1
                    others = F.filter(F.sequence(first, last), lambda j: j != own)
                    return F.struct((own % ARITY).cast("int").alias("place"), F.transform(others, lambda j: node(level, j, wide)).alias("others"))
                return _let(_power(level), within)
            levels = F.filter(F.sequence(F.lit(0), F.lit(STEPS - 1)), lambda k: k < top)
            return read(i, node(F.lit(0), i, F.lit(1).cast("long")), F.transform(levels, step))
        return F.transform(F.sequence(F.lit(0).cast("long"), size - 1), one)
    return _let(begun, of)


def proofs(manifest: Manifest, above: DataFrame) -> DataFrame:
    """(item.*, tree, place, leaf, path, top): for each leaf its path to the root, and what `above` says of its tree.

    `above` has tree, path (steps beyond the root, appended to every path) and top, any struct. Trees not in it are left
    out. A section is read once for all its leaves; it makes at most WIDTH paths at a time.
    """
    coming = None
    for tier in reversed(range(len(manifest.sections))):
        entering = _tops(manifest, tier).select("tree", "block").join(above, "tree").select("tree", "block", "path", "top")
        coming = entering if coming is None else entering.unionByName(coming)
        here = manifest.sections[tier].join(coming, ["tree", "block"])

        def read(i, leaf, path):
            return F.struct((F.col("block") * WIDTH + i).alias("place"), leaf.alias("leaf"), F.concat(path, F.col("path")).alias("path"),
                            F.get("items", i.cast("int")).alias("item"))
        rows = here.select("tree", "top", F.inline(_paths(read)))
        if tier:
            coming = stored(rows.select("tree", F.col("place").alias("block"), "path", "top"), "merkle-paths", "zstd")
    kept = [f for f in manifest.sections[0].schema["items"].dataType.elementType.fieldNames() if f != "_here"]
    return rows.select(*[F.col(f"item.`{f}`").alias(f) for f in kept], F.col("tree.key").alias("tree"), "place", "leaf", "path", "top")


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and a path lead to."""
    def up(node, step):
        left = F.array_join(F.slice(step["others"], F.lit(1), step["place"]), "")
        right = F.array_join(F.slice(step["others"], step["place"] + 1, F.lit(ARITY)), "")
        return digest(left, node, right)
    return F.aggregate(path, leaf, up)


def siblings_digest(path: Column) -> Column:
    """One digest for all siblings on a path, from the leaf up and from left to right."""
    return digest(F.array_join(F.flatten(F.transform(path, lambda step: step["others"])), ""))


def over_trees(manifest: Manifest) -> Manifest:
    """The tree over the roots of all trees, ordered by their keys, null first, others by their bytes."""
    return build(roots(manifest), F.col("root"), F.lit(0), [F.col("tree.key")], [F.col("tree").alias("below"), F.col("root").alias("subroot")])


def tree_tops(over: Manifest) -> DataFrame:
    """What `proofs` of the trees below need: path and (subroot, root) of each tree."""
    root = roots(over).select("tree", F.array().cast(PATH).alias("path"), F.struct("root").alias("top"))
    return proofs(over, root).select(F.col("below").alias("tree"), "path", F.struct("subroot", F.col("top.root").alias("root")).alias("top"))


def log_rows(manifest: Manifest) -> DataFrame:
    """(tree, position, level, digest): the log of each tree, node by node."""
    size, top = F.col("inputs").cast("long"), F.col("height")
    every = None
    for tier, sections in enumerate(manifest.sections):
        levels = F.filter(F.sequence(F.lit(0), F.lit(STEPS)), lambda k: k <= top)
        local = F.sort_array(F.flatten(F.transform(levels, lambda k: F.transform(
            _ends(size, k), lambda end: F.struct(log_position(k, end, top).alias("at"), k.alias("level"), end.alias("end"))))))
        placed = F.transform(F.arrays_zip(local.alias("x"), F.col("nodes").alias("digest")), lambda z: F.struct(
            (z["x"]["level"] + tier * STEPS).alias("level"), z["digest"].alias("digest"),
            F.least((F.col("block") * WIDTH + z["x"]["end"]) * WIDTH ** tier, F.col("total")).alias("end")))
        rows = sections.select("tree", "total", F.inline(placed))
        if tier:
            rows = rows.where(F.col("level") > tier * STEPS)         # inputs stand in the sections below
        rows = rows.select(F.col("tree.key").alias("tree"), log_position(F.col("level"), F.col("end"), height(F.col("total"))).alias("position"),
                           "level", "digest")
        every = rows if every is None else every.unionByName(rows)
    return every
