"""Exact top-k inner products by norm-bucketed retrieval.

Vectors are grouped into blocks of similar length, a block holding a bounded number of rows. Queries, in blocks as well, are
scored first against the longest vectors, which gives each a score that its k-th result reaches at least. With it, pairs of
blocks whose lengths can't reach it are left out before any vector moves. In what is left, the score over both lengths is
the cosine that a result needs at least, query by query and block by block: where it is low, only lengths prune (a vector
must be long enough); where it is high, so does a coordinate: in the one where the query points most, a result's share of
its length lies in an interval about the query's. What is left is multiplied out exactly, in integers.

Blocks of equal lengths are split by a hash, so many copies of one vector don't meet in one task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemark.llm.common import Ranges, Scratch

ROWS, QUERIES, STEEP, SLACK = 2048, 2048, 0.35, 1e-9  # rows of a block; the cosine from which coordinates prune; against rounding
FOUND = "query_id long, twin long, vec_id long, score long"


def whole(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component as a double; null if the vector or one of its components is null, NaN or infinite."""
    v = vector.cast("array<double>")
    fit = F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(fit, F.transform(v, lambda x: F.floor(x * scale).cast("double")))


def products(rows: np.ndarray, query: np.ndarray, bound: float) -> np.ndarray:
    """Exact inner products: in doubles while every partial sum is an integer below 2**53, else in integers of any size."""
    if bound < 2**52:
        return (rows @ query).astype(np.int64)
    exact = rows.astype(object) @ query.astype(object)
    return np.array([int(x) for x in exact], np.int64)


def search_block(left: pa.Table, right: pa.Table, k: int) -> pa.Table:
    """Results of the queries (right: id, twin, v, norm, least) among the vectors of one block (left: id, v, norm)."""
    out = [[], [], [], []]
    if left.num_rows and right.num_rows:
        ids, norm = left.column("id").to_numpy(), left.column("norm").to_numpy()
        rows = np.array(left.column("v").to_pylist(), np.float64).reshape(len(ids), -1)
        order = np.lexsort((ids, -norm))  # longest first
        ids, norm, rows = ids[order], norm[order], rows[order]
        unit = rows / np.where(norm > 0, norm, 1)[:, None]
        for q, twin, v, length, least in zip(*(right.column(c).to_pylist() for c in ("id", "twin", "v", "norm", "least")), strict=True):
            v, hit = np.array(v, np.float64), slice(None)
            if least is not None and least > 0:
                if length * norm[0] * (1 + SLACK) < least:
                    continue
                n = np.searchsorted(-norm, -least / length * (1 - SLACK), "right")
                if n == 0:
                    continue
                hit = slice(0, n)
                cosine = min(1.0, least / (length * norm[0]))
                if cosine >= STEEP:
                    at = int(np.argmax(np.abs(v)))
                    mine = v[at] / length
                    wide = np.sqrt(max(0.0, 1 - mine * mine) * max(0.0, 1 - cosine * cosine)) + SLACK
                    # the least share of the coordinate on the query's side; beyond the query's own direction there is no limit below cosine 1
                    low = mine * cosine - wide if mine >= 0 else -np.inf
                    high = mine * cosine + wide if mine < 0 else np.inf
                    hit = np.flatnonzero((unit[:n, at] >= low) & (unit[:n, at] <= high))
            score = products(rows[hit], v, float(length * norm[0]))
            own, hits = ids[hit], ids[hit] != q
            if least is not None:
                hits &= score >= least
            score, own = score[hits], own[hits]
            best = np.lexsort((own, -score))[:k]
            for column, x in zip(out, ([q] * len(best), [twin] * len(best), own[best].tolist(), score[best].tolist()), strict=True):
                column += x
    return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "twin", "vec_id", "score"), out, strict=True)})


def searched(vectors: DataFrame, queries: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """The results of each pair (block, part) of a block of vectors and one of queries."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        return search_block(left, right, k)

    fresh = lambda *names: [F.col(n).alias(n) for n in names]  # noqa: E731  both sides read some of the same columns
    left = vectors.join(pairs.select("block", "part"), "block").select(*fresh("block", "part", "id", "v", "norm"))
    right = queries.join(pairs.select("block", "part"), "part").select(*fresh("block", "part", "id", "twin", "v", "norm", "least"))
    key = ["block", "part"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(run, FOUND)


def blocked(scratch: Scratch, vectors: DataFrame, rows: int) -> DataFrame:
    """vectors with block: the dimension, the range of lengths and, where a range holds more rows than a block, a share of it."""
    squared = vectors.withColumn("square", F.least(F.round(F.col("norm") * F.col("norm")), F.lit(9e18)).cast("long"))
    ranged = Ranges(scratch, squared, "square", rows, rows).add(squared, "range").withColumn("dim", F.size("v")).drop("square")
    full = ranged.groupBy("dim", "range").agg(F.ceil(F.count("*") / rows).alias("shares"))
    dealt = ranged.join(full, ["dim", "range"])
    share = F.pmod(F.xxhash64("id", "twin"), F.col("shares"))
    return scratch.save(dealt.withColumn("block", F.concat_ws("/", "dim", "range", share)).drop("shares"), "vectors")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, rows: int = ROWS, queries: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of highest integer inner product for each row whose id is divisible by every.

    Ties go to the smaller vec_id. Vectors that are null, or hold null, NaN or infinite components, and null ids take no part;
    vectors of different dimension are not compared; two empty vectors score 0. Rows that repeat id and vector count once,
    and rows of a query's own id are no candidates for it; ids with several vectors are ranked for each. Components are exact up to
    2**53; a score beyond 64 bits fails. Other columns aren't read. An empty table gives an empty one.
    """
    scratch = Scratch(vectors.sparkSession, "top-k")
    v = vectors.select(F.col(id_col).cast("long").alias("id"), whole(F.col(vector_col), scale).alias("v")).filter("id is not null and v is not null")
    v = v.withColumns({"twin": F.xxhash64("v"), "norm": F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))}).dropDuplicates(["id", "twin"])
    own = blocked(scratch, v, rows)
    asked = own.filter(F.col("id") % every == 0)
    parts = max(1, -(-asked.count() // queries))
    asked = asked.withColumn("part", F.concat_ws("/", "dim", F.pmod(F.xxhash64("id", "twin", F.lit(1)), F.lit(parts)))).drop("block", "range")
    asked = scratch.save(asked.withColumn("least", F.lit(None).cast("long")), "queries")

    blocks = own.groupBy("dim", "block").agg(F.max("norm").alias("longest"), F.max("range").alias("range"), F.count("*").alias("n"))
    first = W.partitionBy("dim").orderBy(F.desc("range"), "block")
    blocks = scratch.save(blocks.withColumn("turn", F.row_number().over(first)), "blocks")
    part = asked.groupBy("dim", "part").agg(F.max("norm").alias("reach"))
    seeds = blocks.filter("turn = 1").join(part, "dim")
    begun = scratch.save(searched(own, asked, seeds, k), "begun")
    kth = begun.groupBy("query_id", "twin").agg(F.when(F.count("*") >= k, F.min("score")).alias("least")).withColumnRenamed("query_id", "id")
    told = scratch.save(asked.drop("least").join(kth, ["id", "twin"], "left"), "told")

    floor = told.groupBy("dim", "part").agg(F.max("norm").alias("reach"), F.min(F.coalesce("least", F.lit(-(1 << 62)))).alias("floor"))
    rest = blocks.filter("turn > 1").join(floor, "dim").filter(F.col("reach") * F.col("longest") * (1 + SLACK) >= F.col("floor"))
    found = begun.union(searched(own, told, scratch.save(rest.select("block", "part"), "pairs"), k))
    scratch.drop(asked, blocks)
    rank = F.row_number().over(W.partitionBy("query_id", "twin").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
