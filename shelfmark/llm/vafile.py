"""Exact top-k search by a vector-approximation file.

Every component is quantised to one of 2**BITS cells, so a vector takes a byte for each. A scan of the cells bounds
each inner product from below and above. Exact vectors are then read in the order of the upper bound: the first k of
each query settle a score that the rest must reach, and those whose bound reaches it are read too. What isn't read
can't be among the k best.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfmark.llm import vectors as V
from shelfmark.sources.workspace import stored

BITS = 6
BLOCK = 1024          # vectors in a block of cells
BLOCKS = 8            # blocks one task scans for a block of queries
QUERIES = 8192        # queries in a block
STEP = 1024           # queries whose bounds are held at once


def _edges(table: DataFrame) -> dict[int, np.ndarray]:
    """Cell borders by vector length: a row of 2**BITS + 1 borders for each component, about equally many in a cell.

    The outer borders are the exact extremes, so each component lies within the borders of its cell.
    """
    shares = [i / (1 << BITS) for i in range(1, 1 << BITS)]
    parts = table.select(F.size("vec").alias("dims"), F.posexplode("vec").alias("place", "x")).groupBy("dims", "place") \
        .agg(F.min("x"), F.percentile_approx("x", shares, 2000), F.max("x"))
    borders: dict[int, list] = {}
    for dims, place, least, inner, most in sorted(parts.collect()):   # one row for each component, however many vectors
        borders.setdefault(dims, []).append([least, *inner, most])
    return {dims: np.array(rows, dtype=np.float64) for dims, rows in borders.items()}


def _packed(table: DataFrame, size: int, rows: int, edges=None) -> DataFrame:
    """Vectors in blocks of about `size`: (dims, block, ids, body), body their cells or, without edges, their numbers."""
    block = F.pmod(F.xxhash64("vid"), F.lit(max(1, -(-rows // size)))).cast("int")

    def pack(key: tuple[pa.Scalar, ...], part: pa.Table) -> pa.Table:
        dims, number = (x.as_py() for x in key)
        matrix = np.array(part["vec"].combine_chunks().flatten(), dtype=np.float64).reshape(-1, dims)
        if edges is None:
            body = matrix
        else:
            body = np.stack([np.searchsorted(e[1:-1], column, side="right") for e, column in zip(edges[dims], matrix.T)], axis=1)
            body = body.astype(np.uint8)
        ids = np.array(part["vid"], dtype=np.int64)
        return pa.table({"dims": pa.array([dims], pa.int32()), "block": pa.array([number], pa.int32()),
                         "ids": pa.array([ids.tobytes()]), "body": pa.array([body.tobytes()])})
    return table.select("vid", "vec", F.size("vec").alias("dims"), block.alias("block")).groupBy("dims", "block") \
        .applyInArrow(pack, "dims int, block int, ids binary, body binary")


def _bounds(cells: np.ndarray, edges: np.ndarray, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bound of the inner product of each query with each vector."""
    place = np.arange(cells.shape[1])
    low, high = edges[place, cells], edges[place, cells.astype(np.int64) + 1]
    plus, minus = np.maximum(queries, 0), np.minimum(queries, 0)
    return plus @ low.T + minus @ high.T, plus @ high.T + minus @ low.T


def _scan(edges: dict[int, np.ndarray], keep: int):
    """For a group of cell blocks and a block of queries: vectors whose upper bound reaches the keep-th best lower bound."""
    def scan(key: tuple[pa.Scalar, ...], blocks: pa.Table, asked: pa.Table) -> pa.Table:
        dims = key[0].as_py()
        out: dict[str, list] = {"qid": [], "vid": [], "lower": [], "upper": []}
        if blocks.num_rows and asked.num_rows:
            vids = np.concatenate([np.frombuffer(b, dtype=np.int64) for b in blocks["ids"].to_pylist()])
            cells = np.concatenate([np.frombuffer(b, dtype=np.uint8) for b in blocks["body"].to_pylist()]).reshape(-1, dims)
            qids = np.concatenate([np.frombuffer(b, dtype=np.int64) for b in asked["ids"].to_pylist()])
            matrix = np.concatenate([np.frombuffer(b) for b in asked["body"].to_pylist()]).reshape(-1, dims)
            for at in range(0, len(qids), STEP):
                lower, upper = _bounds(cells, edges[dims], matrix[at:at + STEP])
                if len(vids) > keep:
                    reached = upper >= -np.partition(-lower, keep - 1, axis=1)[:, keep - 1:keep]
                else:
                    reached = np.ones(upper.shape, dtype=bool)
                q, v = np.nonzero(reached)
                for name, values in (("qid", qids[at + q]), ("vid", vids[v]), ("lower", lower[q, v]), ("upper", upper[q, v])):
                    out[name].append(values)
        kinds = {"qid": np.int64, "vid": np.int64, "lower": np.float64, "upper": np.float64}
        return pa.table({name: np.concatenate(out[name]) if out[name] else np.zeros(0, kind) for name, kind in kinds.items()})
    return scan


def candidates(table: DataFrame, wanted: DataFrame, keep: int) -> DataFrame:
    """(qid, vid, lower, upper) of all vectors that can be among the `keep` best of a query, by the cells alone."""
    n, m = table.count(), wanted.count()
    edges = _edges(table)
    cells = stored(_packed(table, BLOCK, n, edges), "cells")
    blocks = stored(_packed(wanted, QUERIES, m), "queries")
    groups, parts = -(-max(1, -(-n // BLOCK)) // BLOCKS), max(1, -(-m // QUERIES))
    left = cells.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))) \
        .select("dims", F.pmod("block", F.lit(groups)).alias("group"), "part", "ids", "body")
    right = blocks.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))) \
        .select("dims", "group", F.col("block").alias("part"), "ids", "body")
    keys = ("dims", "group", "part")
    found = stored(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(
        _scan(edges, keep), "qid long, vid long, lower double, upper double"), "bounds")
    by_lower = Window.partitionBy("qid").orderBy(F.desc("lower"))
    floor = found.withColumn("n", F.row_number().over(by_lower)).where(F.col("n") <= keep) \
        .groupBy("qid").agg(F.min("lower").alias("floor"), F.count(F.lit(1)).alias("n"))
    reach = floor.select("qid", F.when(F.col("n") < keep, float("-inf")).otherwise(F.col("floor")).alias("floor"))
    return found.join(reach, "qid").where("upper >= floor").drop("floor")


def search(df: DataFrame, is_query: Column, k: int, vec_id: str = "vec_id", vector: Column | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the k largest inner products of each query row with all other rows.

    `vector` is an array of longs, `is_query` a condition on the column `id`. Scores are exact as long as their parts
    stay below 2**53. Ties go to smaller ids. Rows without an id, and vectors that are null, empty or hold a null or
    non-finite component take no part; a query with fewer than k other rows gets all. Vectors meet vectors of their
    own length only. Copies of a vector are scanned once. Extra columns are left behind; without usable rows the
    result is empty.
    """
    rows = stored(V.usable(df, vec_id, F.col("embedding") if vector is None else vector, nonzero=False), "rows")
    table = stored(V.folded(rows, k + 1), "vectors")
    queries = stored(V.asked(rows.where(is_query), table), "asked")
    wanted = table.join(queries.select(F.col("qid").alias("vid")).distinct(), "vid", "left_semi")
    possible = stored(candidates(table, wanted, k + 1), "possible") \
        .withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("upper"), "vid")))

    def read(pairs: DataFrame) -> DataFrame:
        exact = pairs.join(table.select("vid", "vec"), "vid") \
            .join(wanted.select(F.col("vid").alias("qid"), F.col("vec").alias("asked")), "qid")
        return exact.select("qid", "vid", V.inner_product("vec", "asked", F.lit(0).cast("long")).alias("score"))
    first = stored(read(possible.where(F.col("n") <= k + 1).select("qid", "vid")), "first")
    settled = first.groupBy("qid").agg(F.min("score").alias("settled"))
    rest = possible.where(F.col("n") > k + 1).join(settled, "qid").where("upper >= settled").select("qid", "vid")
    return V.answers(first.unionByName(read(rest)), table, queries, k)
