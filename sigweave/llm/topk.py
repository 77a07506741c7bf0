"""Exact top-k inner products by columnar branch and bound.

Query rows and candidate rows are dealt into blocks of bounded size; every pair of a query
block and a candidate block is one task's work. Inside it vectors lie in vertical layout,
one row of the matrix per dimension. Scores grow by one block of dimensions at a time; a
candidate stays only while its partial score plus the product of the remaining masses (norms
of the dimensions not yet seen) reaches the k-th best score known for the query. Surviving
pairs are compacted after every block. A window keeps the k best per query of all blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

FIRST = 256  # candidates scored in full to set the first thresholds


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component, or null if any is null or not finite."""
    v = F.transform(vector, lambda x: x.cast("double"))
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(vector.isNotNull() & ~bad, F.transform(v, lambda x: F.floor(x * scale).cast("double")))


def best_of_block(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int, width: int) -> pd.DataFrame:
    """The k best candidates of a block for every query, ties to the smaller id.

    Components are whole numbers, so sums are exact while below 2**53.
    """
    order = np.argsort(cid, kind="stable")
    cid, columns = cid[order], np.ascontiguousarray(c[order].T)
    n, dims = len(cid), q.shape[1]
    own = qid[:, None] == cid[None, :FIRST]
    first = np.where(own, -np.inf, q @ columns[:, :FIRST])
    pad = np.full((len(qid), k), -np.inf)
    bound = -np.partition(-np.hstack([first, pad]), k - 1, axis=1)[:, k - 1]  # k-th best so far
    starts = list(range(0, dims, width))
    # Masses of the dimensions from each block on, by suffix sums.
    q_mass = np.sqrt(np.stack([(q[:, s:] ** 2).sum(1) for s in [*starts[1:], dims]]))
    c_mass = np.sqrt(np.stack([(columns[s:] ** 2).sum(0) for s in [*starts[1:], dims]]))
    rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for i in range(len(qid)):
        alive = np.flatnonzero(cid != qid[i])
        score = np.zeros(len(alive))
        for b, s in enumerate(starts):
            score += q[i, s:s + width] @ columns[s:s + width, alive]
            stays = score + q_mass[b, i] * c_mass[b, alive] * (1 + 1e-12) + 1e-6 >= bound[i]
            if not stays.all():
                alive, score = alive[stays], score[stays]
        top = np.lexsort((cid[alive], -score))[:k]
        rows.append((np.full(len(top), qid[i]), cid[alive[top]], score[top]))
    out = [np.concatenate([r[j] for r in rows]) if rows else np.zeros(0) for j in range(3)]
    return pd.DataFrame({"query_id": out[0].astype(np.int64), "vec_id": out[1].astype(np.int64), "score": out[2].astype(np.int64)})


def exact_top_k(vectors: DataFrame, is_query: Column, *, key: str = "vec_id", vector: str = "embedding", k: int = 5,
                scale: float = 256.0, dims_per_block: int = 16, queries_per_block: int = 1024,
                candidates_per_block: int = 16_384) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every query.

    Queries are the rows where ``is_query`` holds, candidates all rows with another key.
    Vectors that are null, empty, or hold null or non-finite components take no part, nor
    do rows without a key; vectors of different lengths are not compared. A repeated row is
    a candidate each time, and its key is one query. Memory of a task is bounded by the two
    block sizes; the work is queries times candidates, as an exact search asks for, less
    what the bounds cut off.
    """
    rows = vectors.select(F.col(key).cast("long").alias("_id"), quantised(F.col(vector), scale).alias("_v"),
                          F.coalesce(is_query, F.lit(False)).alias("_q")).filter(
        F.col("_id").isNotNull() & (F.size("_v") > 0)).withColumn("_dim", F.size("_v"))
    rows = settle(rows)
    queries = rows.filter("_q").dropDuplicates(["_id", "_dim"])
    size = rows.agg(F.count("*").alias("n"), F.count_if("_q").alias("q")).first()
    q_blocks, c_blocks = max(1, -(-size["q"] // queries_per_block)), max(1, -(-size["n"] // candidates_per_block))

    def every(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    mine = F.pmod(F.xxhash64("_id"), F.lit(q_blocks)).cast("int")
    theirs = F.pmod(F.xxhash64("_id", F.lit(1)), F.lit(c_blocks)).cast("int")
    asked = queries.select("_id", "_v", "_dim", mine.alias("_qb"), every(c_blocks).alias("_cb"))
    given = rows.select("_id", "_v", "_dim", every(q_blocks).alias("_qb"), theirs.alias("_cb"))
    keys = ["_dim", "_qb", "_cb"]

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        return best_of_block(left["_id"].to_numpy(), np.stack(left["_v"].to_numpy()), right["_id"].to_numpy(),
                             np.stack(right["_v"].to_numpy()), k, dims_per_block)

    found = asked.groupBy(*keys).cogroup(given.groupBy(*keys)).applyInPandas(meet, "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
