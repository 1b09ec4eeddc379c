"""Exact top-k inner products by block-at-a-time pruning.

Vectors are cut into document-range blocks of neighbouring ids with each
component's largest and smallest value, and blocks are dealt to groups by a hash.
For a query, the summed component maxima bound every score in a block. Blocks
are taken in order of falling bounds and scored through their forward index (the
block's rows) until the bound falls below the k-th best score; a tie with the
k-th is still scored, so equal scores go to the smaller id. Query chunks meet
candidate groups by a cogroup on (chunk, group); each returns k rows a query at
most. The first group is searched first, and its k-th best score is the floor
for the search of all the others: blocks that can't reach it are never scored.

Defined results
* vectors that are null, empty of components or hold null or non-finite ones take no part.
* a query meets vectors of its own length only; rows with its own id are left out.
* repeated candidate rows count each; of query rows that repeat an id one is taken.
* fewer than k candidates: all of them; empty table: empty result.
* scores beyond 64 bits are clipped to them.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.session import cut, ship

BLOCK = 256
_ROWS = 1024
_LONG = (1 << 63) - 1


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component as long; null if the vector takes no part."""
    ok = vector.isNotNull() & (F.size(vector) > 0) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(ok, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def search_group(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, block: int = BLOCK, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query positions, ids, scores) of each query's best k among ``rows``, and how many blocks were scored.

    Scores below a query's ``floor`` may be left out: k others reach it. The
    least long stands for no floor.
    """
    order = np.argsort(ids, kind="stable")
    rows, ids = rows[order], ids[order]
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * rows.shape[1]
    kind = np.float64 if most < 2**53 else np.int64 if most < 2**62 else object
    x, q = rows.astype(kind), queries.astype(kind)
    starts = np.arange(0, len(x), block)
    high, low = np.maximum.reduceat(x, starts, axis=0), np.minimum.reduceat(x, starts, axis=0)
    zero = q.dtype.type(0) if kind is not object else 0
    bound = np.maximum(q, zero) @ high.T + np.minimum(q, zero) @ low.T  # query x block
    by_bound = np.argsort(-bound, axis=1, kind="stable")
    none = -math.inf if kind is np.float64 else -(1 << 70) if kind is object else -(1 << 62)
    score = np.full((len(q), k), none, dtype=kind)
    least = np.full(len(q), none, dtype=kind) if floor is None else np.array([none if f <= -_LONG - 1 else f for f in floor.tolist()], dtype=kind)
    found = np.full((len(q), k), _LONG, dtype=np.int64)
    scored = 0
    for r in range(len(starts)):
        at = by_bound[:, r]
        live = np.flatnonzero(bound[np.arange(len(q)), at] >= np.maximum(score[:, -1], least))
        if not len(live):
            break
        for b in np.unique(at[live]):
            here = live[at[live] == b]
            part = slice(starts[b], starts[b] + block)
            made = q[here] @ x[part].T
            scored += len(here)
            own = query_ids[here][:, None] == ids[part][None, :]
            made[own] = none
            better = (made >= np.maximum(score[here, -1], least[here])[:, None]).any(axis=1)
            here, made, own = here[better], made[better], own[better]
            if not len(here):
                continue
            all_s = np.concatenate([score[here], made], axis=1)
            all_i = np.concatenate([found[here], np.where(own, _LONG, ids[part][None, :])], axis=1)
            best = np.lexsort((all_i, -all_s), axis=-1)[:, :k]
            score[here], found[here] = np.take_along_axis(all_s, best, 1), np.take_along_axis(all_i, best, 1)
    full = score > none
    where = np.nonzero(full)
    return where[0], found[full], np.array([max(-_LONG - 1, min(_LONG, int(s))) for s in score[full]], dtype=np.int64), scored


def top_k(rows: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", *, k: int = 10, scale: int = 1024, group_rows: int = 16_384, chunk_queries: int = 16_384) -> DataFrame:
    """(query_id, rank, vec_id, score) of each query's ``k`` highest inner products."""
    vectors = cut(rows.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), is_query.alias("asks"), quantised(F.col(vector_col), scale).alias("x")).where("x is not null"))
    n, asked = vectors.agg(F.count("*"), F.count_if("asks")).first()
    groups, chunks = max(1, math.ceil(n / group_rows)), max(1, math.ceil(asked / chunk_queries))
    own = vectors.select("id", "x", F.size("x").alias("d"), F.pmod(F.xxhash64(F.floor(F.col("id") / BLOCK)), F.lit(groups)).cast("int").alias("g"))
    candidates = own.withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    asks = vectors.where("asks").groupBy(F.col("id").alias("qid")).agg(F.min("x").alias("x"))
    asks = asks.select("qid", "x", F.size("x").alias("d"), F.pmod(F.xxhash64("qid"), F.lit(chunks)).cast("int").alias("c"))

    ship(rows.sparkSession)

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="int64")})
        x, ids = np.stack(left["x"].to_numpy()), left["id"].to_numpy(dtype=np.int64)
        q, query_ids = np.stack(right["x"].to_numpy()), right["qid"].to_numpy(dtype=np.int64)
        floor = right["floor"].to_numpy(dtype=np.int64)
        out = []
        for a in range(0, len(q), _ROWS):
            at, found, score, _ = search_group(q[a : a + _ROWS], query_ids[a : a + _ROWS], x, ids, k, floor=floor[a : a + _ROWS])
            out.append(pd.DataFrame({"query_id": query_ids[a : a + _ROWS][at], "vec_id": found, "score": score}))
        return pd.concat(out)

    def met_in(some: DataFrame, queries: DataFrame) -> DataFrame:
        return some.groupBy("c", "g", "d").cogroup(queries.groupBy("c", "g", "d")).applyInPandas(search, "query_id long, vec_id long, score long")

    met = met_in(candidates.where("g = 0"), asks.withColumn("g", F.lit(0)).withColumn("floor", F.lit(-_LONG - 1)))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    if groups > 1:
        met = cut(met)
        floors = met.groupBy(F.col("query_id").alias("qid")).agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
        floored = asks.join(floors, "qid", "left").select("qid", "x", "d", "c", F.coalesce("floor", F.lit(-_LONG - 1)).alias("floor"))
        met = met.union(met_in(candidates.where("g > 0"), floored.withColumn("g", F.explode(F.sequence(F.lit(1), F.lit(groups - 1))))))
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
