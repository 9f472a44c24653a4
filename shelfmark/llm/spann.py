"""Approximate nearest neighbours by balanced posting lists.

Centroids come from a balanced splitting of a bounded sample. A vector goes to the lists of its nearest centroids, to
several if it lies near their border. Centroids are found by a best-first walk over a graph of centroids that every
task holds in memory; a query reads the lists whose centroid is not much farther than the nearest. How much is fitted on
the sample, so that most of the nearest vectors of its queries lie in lists they read; a query whose lists hold too few
vectors goes on to the next nearest lists.
"""

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm import vectors as V
from shelfmark.sources.workspace import stored

MAX_LISTS = 2048      # centroids, however many vectors: they and their graph are held in memory
PER_LIST = 200        # vectors a list is made for
SAMPLE = 32_768       # vectors the centroids are fitted on, the first in the order of a hash of their ids
REPLICAS = 4          # lists a vector goes to, at most
NEAR_BORDER = 1.10    # ... if their centroids are at most so many times as far as the nearest
ASKED = 256           # vectors of the sample that the ratio of a query's lists is fitted on
REACHED = 0.95        # ... so that this share of their nearest in the sample is in the lists they read
WALKED = 32           # centroids a walk looks around, at the fewest
DEGREE = 24           # neighbours of a centroid in the graph
ENTRIES = 8           # centroids a walk starts from
CELL = 4096           # vectors, or queries, of a list in a cell
CELLS = 32            # cells that one task compares
SPARE = 8             # candidates beyond the wanted ones that are scored exactly


def _split(sample: np.ndarray, members: np.ndarray, lists: int, rng: np.random.Generator) -> list[np.ndarray]:
    """Members in `lists` parts of about equal size, by halving along the line between two means."""
    if lists == 1:
        return [members]
    x = sample[members]
    means = x[rng.choice(len(x), 2, replace=False)]
    for _ in range(6):
        nearer = ((x - means[0]) ** 2).sum(1) < ((x - means[1]) ** 2).sum(1)
        if nearer.all() or not nearer.any():
            break
        means = np.stack([x[nearer].mean(0), x[~nearer].mean(0)])
    order = np.argsort(((x - means[0]) ** 2).sum(1) - ((x - means[1]) ** 2).sum(1), kind="stable")
    left = lists // 2
    cut = len(order) * left // lists
    return _split(sample, members[order[:cut]], left, rng) + _split(sample, members[order[cut:]], lists - left, rng)


class Graph:
    """Centroids, each with its nearest others."""

    def __init__(self, sample: np.ndarray, lists: int):
        parts = _split(sample, np.arange(len(sample)), lists, np.random.default_rng(0))
        self.centroids = np.stack([sample[p].mean(0) for p in parts])
        squares = (self.centroids ** 2).sum(1)
        apart = squares[:, None] - 2 * self.centroids @ self.centroids.T + squares[None]
        self.neighbours = np.argsort(apart, axis=1, kind="stable")[:, 1:DEGREE + 1]
        self.entries = np.unique(np.linspace(0, lists - 1, min(ENTRIES, lists)).astype(int))
        self.ratio, self.sizes = 1.0, np.zeros(lists, dtype=np.int64)

    def near(self, point: np.ndarray, ratio: float, least: int) -> list[tuple[float, int]]:
        """Centroids up to `ratio` times as far as the nearest, nearest first; the walk sees `least` at the fewest."""
        def distances(nodes):
            return np.sqrt(((self.centroids[nodes] - point) ** 2).sum(1)).tolist()
        seen = set(self.entries.tolist())
        queue = list(zip(distances(self.entries), self.entries.tolist()))
        found = sorted(queue)
        heapq.heapify(queue)
        best, walked = found[0][0], 0
        while queue:
            distance, node = heapq.heappop(queue)
            if walked >= least and distance > ratio * best:
                break
            walked += 1
            fresh = [x for x in self.neighbours[node].tolist() if x not in seen]
            if fresh:
                seen.update(fresh)
                for item in zip(distances(fresh), fresh):
                    best = min(best, item[0])
                    heapq.heappush(queue, item)
                    found.append(item)
        return sorted(x for x in found if x[0] <= ratio * best)

    def homes(self, point: np.ndarray) -> list[int]:
        """Lists a vector goes to: the nearest, and others if it lies near their border."""
        return [c for _, c in self.near(point, NEAR_BORDER, WALKED)[:REPLICAS]]

    def read_by(self, point: np.ndarray, least: int) -> list[int]:
        """Lists a query reads, nearest first: those up to the fitted ratio, and more until they hold `least` rows."""
        lists = [c for _, c in self.near(point, self.ratio, WALKED)]
        if self.sizes[lists].sum() < least:
            known = set(lists)
            rest = np.argsort(((self.centroids - point) ** 2).sum(1), kind="stable")
            lists += [c for c in rest.tolist() if c not in known]
            lists = lists[:int(np.searchsorted(np.cumsum(self.sizes[lists]), least)) + 1]
        return lists

    def fit_ratio(self, sample: np.ndarray, longest: float, k: int) -> None:
        """The ratio up to which queries must read so that REACHED of their k nearest in the sample are found."""
        raw = sample[:, :-1]
        k = min(k, len(raw) - 1)
        if k < 1:
            return
        scores = raw[:ASKED] @ raw.T
        np.fill_diagonal(scores, -np.inf)
        nearest = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        homes = {j: self.homes(sample[j]) for j in np.unique(nearest).tolist()}
        needed = []
        for vector, found in zip(raw, nearest.tolist()):
            goal = np.append(vector * np.sqrt(longest / (vector ** 2).sum()), 0.0)
            far = np.sqrt(((self.centroids - goal) ** 2).sum(1))
            needed += [far[homes[j]].min() / max(far.min(), 1e-300) for j in found]
        self.ratio = float(np.quantile(needed, REACHED))


def _lists_of(spark, graph: Graph, point: Column, lists: Callable[[Graph, np.ndarray], list[int]]) -> Column:
    """Array of the lists that `lists` finds for a point."""
    shared = spark.sparkContext.broadcast(graph)           # at most MAX_LISTS centroids

    @F.arrow_udf("array<int>")
    def of(points: pa.Array) -> pa.Array:
        size = shared.value.centroids.shape[1]
        matrix = np.array(points.flatten(), dtype=np.float64).reshape(-1, size)
        return pa.array([lists(shared.value, row) for row in matrix], pa.list_(pa.int32()))
    return of(point)


def _best(qids: np.ndarray, vids: np.ndarray, scores: np.ndarray, keep: int) -> np.ndarray:
    """Places of the `keep` best different vectors of each query."""
    order = np.lexsort((vids, qids))
    first = np.ones(len(order), dtype=bool)
    first[1:] = (np.diff(qids[order]) != 0) | (np.diff(vids[order]) != 0)
    order = order[first]
    order = order[np.lexsort((vids[order], -scores[order], qids[order]))]
    starts = np.flatnonzero(np.r_[True, np.diff(qids[order]) != 0]) if len(order) else np.zeros(0, int)
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)]))
    return order[rank < keep]


def _compare(keep: int):
    """For some cells, each with vectors and queries of one list: the `keep` best vectors of each query."""
    def compare(key: tuple[pa.Scalar, ...], held: pa.Table, asked: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if held.num_rows and asked.num_rows:
            held, asked = held.sort_by([("cell", "ascending"), ("vid", "ascending")]), asked.sort_by("cell")
            vectors, wanted = (np.array(t["vec"].combine_chunks().flatten()).reshape(t.num_rows, -1) for t in (held, asked))
            vids, qids = np.array(held["vid"], dtype=np.int64), np.array(asked["qid"], dtype=np.int64)
            cells, reads = np.array(held["cell"], dtype=np.int64), np.array(asked["cell"], dtype=np.int64)
            for cell in np.intersect1d(cells, reads):
                v, q = (slice(*np.searchsorted(x, [cell, cell + 1])) for x in (cells, reads))
                for at in range(q.start, q.stop, 1024):
                    block = slice(at, min(at + 1024, q.stop))
                    scores = wanted[block] @ vectors[v].T
                    best = np.argsort(-scores, axis=1, kind="stable")[:, :keep]
                    found.append((np.repeat(qids[block], best.shape[1]), vids[v][best].ravel(), np.take_along_axis(scores, best, 1).ravel()))
        qid, vid, score = (np.concatenate(x) for x in zip(*found))
        best = _best(qid, vid, score, keep)
        return pa.table({"qid": qid[best], "vid": vid[best], "score": score[best]})
    return compare


def _fit(table: DataFrame, n: int, dims: int, k: int) -> tuple[Graph, float]:
    """The graph of centroids with the ratio for queries, and the largest squared length of any vector.

    Points get one more component that brings all to the largest length: the largest inner product with a query, which
    has 0 there, is then the nearest point.
    """
    longest = table.agg(F.max(V.inner_product("vec", "vec", F.lit(0.0)))).first()[0]
    drawn = F.pmod(F.xxhash64("vid"), F.lit(1 << 30)) < int(min(1.0, 1.2 * SAMPLE / n) * (1 << 30))
    chosen = table.where(drawn).select("vid", "vec").orderBy(F.xxhash64("vid"), "vid").limit(SAMPLE).toArrow()
    sample = np.array(chosen["vec"].combine_chunks().flatten()).reshape(-1, dims)
    sample = np.column_stack([sample, np.sqrt(np.maximum(longest - (sample ** 2).sum(1), 0))])
    graph = Graph(sample, max(1, min(MAX_LISTS, n // PER_LIST, len(sample))))
    graph.fit_ratio(sample, longest, k)
    return graph, longest


def candidates(table: DataFrame, wanted: DataFrame, n: int, dims: int, keep: int) -> DataFrame:
    """(qid, vid) pairs: the `keep` best vectors of the lists each query reads.

    A cell is a part of a list with a part of the queries that read it, of about CELL rows either; a task compares
    CELLS of them and keeps a query's best.
    """
    graph, longest = _fit(table, n, dims, keep)
    spark = table.sparkSession
    filled = F.sqrt(F.greatest(F.lit(longest) - V.inner_product("vec", "vec", F.lit(0.0)), F.lit(0.0)))
    point = F.concat("vec", F.array(filled))
    scale = F.sqrt(F.lit(longest) / V.inner_product("vec", "vec", F.lit(0.0)))
    goal = F.concat(F.transform("vec", lambda x: x * scale), F.array(F.lit(0.0)))
    homes = _lists_of(spark, graph, point, lambda g, x: g.homes(x))
    postings = stored(table.select("vid", "vec", F.explode(homes).alias("list")), "postings")
    for row in postings.groupBy("list").count().collect():  # at most MAX_LISTS rows
        graph.sizes[row["list"]] = row["count"]
    least = REPLICAS * (keep + SPARE)                      # postings, as copies of a vector may be among them
    read = _lists_of(spark, graph, goal, lambda g, x: g.read_by(x, least))
    reads = stored(wanted.select(F.col("vid").alias("qid"), "vec", F.explode(read).alias("list")), "reads")

    def parts(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("list").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias(name))
    sizes = stored(parts(postings, "hs").join(parts(reads, "rs"), "list"), "cells")
    cells = sizes.agg(F.sum(F.col("hs").cast("long") * F.col("rs"))).first()[0] or 1
    sizes = F.broadcast(sizes)                             # one row for each of at most MAX_LISTS lists
    cell = ((F.col("list").cast("long") * (1 << 20) + F.col("h")) * (1 << 20) + F.col("r")).alias("cell")
    group = F.pmod(F.xxhash64("list", "h", "r"), F.lit(-(-cells // CELLS))).alias("group")

    def dealt(rows: DataFrame, key: str, own: str, other: str) -> DataFrame:
        placed = rows.join(sizes, "list").withColumn(own, F.pmod(F.xxhash64(key), F.col(own + "s")).cast("int")) \
            .withColumn(other, F.explode(F.sequence(F.lit(0), F.col(other + "s") - 1)))
        return placed.select(group, cell, key, "vec")
    left, right = dealt(postings, "vid", "h", "r"), dealt(reads, "qid", "r", "h")
    found = left.groupBy("group").cogroup(right.groupBy("group")).applyInArrow(_compare(keep + SPARE), "qid long, vid long, score double")
    # a few more than asked for, as scores summed in another order may differ in the last bit
    folded = found.groupBy("qid", "vid").agg(F.max("score").alias("score"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vid")
    return folded.withColumn("n", F.row_number().over(best)).where(F.col("n") <= keep + SPARE).select("qid", "vid")


def search(df: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): about the k largest inner products of each query row with all other rows.

    `is_query` is a condition on the column `id`. Scores are exact, in double precision from the first component to
    the last. Ties go to smaller ids; a query gets fewer than k rows only where there are fewer others. Rows without an
    id, and vectors that are null, empty, zero or hold a null or non-finite component take no part. All vectors must
    have one length, else the search fails with a message. Copies of a vector are indexed once. Extra columns are left
    behind; without usable rows the result is empty.
    """
    doubles = F.transform(F.col(vector), lambda x: x.cast("double"))
    rows = stored(V.usable(df, vec_id, doubles, nonzero=True), "rows")
    table = stored(V.folded(rows, k + 1), "vectors")
    queries = stored(V.asked(rows.where(is_query), table), "asked")
    wanted = table.join(queries.select(F.col("qid").alias("vid")).distinct(), "vid", "left_semi")
    n, least, most = table.agg(F.count(F.lit(1)), F.min(F.size("vec")), F.max(F.size("vec"))).first()
    if not n:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if least != most:
        raise ValueError(f"vectors have from {least} to {most} components")
    pairs = candidates(table, wanted, n, most, k + 1)
    exact = pairs.join(table.select("vid", "vec"), "vid") \
        .join(wanted.select(F.col("vid").alias("qid"), F.col("vec").alias("asked")), "qid")
    hits = exact.select("qid", "vid", V.inner_product("vec", "asked", F.lit(0.0)).alias("score"))
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "vid")
    top = hits.withColumn("n", F.row_number().over(best)).where(F.col("n") <= k + 1).drop("n")
    return V.answers(stored(top, "hits"), table, queries, k)
