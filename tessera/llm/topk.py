"""Exact top-k inner-product search by columnar branch-and-bound.

Vectors and queries are dealt into blocks of bounded size; a task holds one block of each, and all pairs of blocks meet.
Inside a block the vectors lie dimension by dimension.  Scores are accumulated one block of dimensions at a time; what the remaining
dimensions can still add is bounded by the product of the remaining lengths (Cauchy-Schwarz), and candidates whose upper
bound lies below the k-th best lower bound are compacted away.  All arithmetic is exact in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import checkpointed

ROWS_PER_BLOCK, QUERIES_PER_BLOCK, QUERIES_AT_ONCE, DIMS_AT_ONCE = 16_384, 16_384, 128, 8
FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """vec_id and v, floor(scale * x) of each component as long; rows null or with null or non-finite components go."""
    x = F.col(vec_col)
    fine = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < float("inf")))
    whole = F.transform(x, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fine, whole).alias("v")).where("v is not null and vec_id is not null")


def _matrix(column: pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Rows of longs; shorter rows are filled with zeros, which add nothing to a product."""
    rows = column.combine_chunks()
    sizes = rows.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    width = max(width or 0, int(sizes.max(initial=0)))
    out = np.zeros((len(sizes), width), dtype=np.int64)
    flat = rows.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(np.int64)
    out[np.arange(width)[None, :] < sizes[:, None]] = flat
    return out


def search_block(ids: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each query (indices of rows, scores) of at least its k best rows with another id, ties included."""
    most = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, vectors.shape[1])
    kind = np.float64 if most < 2**52 else object  # whole numbers below 2**53 are exact in doubles
    order = np.argsort(-(vectors.astype(np.float64) ** 2).sum(axis=0), kind="stable")
    columns, queries = np.ascontiguousarray(vectors.T[order]).astype(kind), queries[:, order].astype(kind)
    dims = len(order)
    cuts = list(range(0, dims, DIMS_AT_ONCE)) + [dims]
    tail = lambda m, axis: np.sqrt(np.maximum(0.0, (m.astype(np.float64) ** 2).sum(axis=axis))) * (1 + 1e-9)
    row_rest = [tail(columns[c:], 0) for c in cuts[1:]]
    query_rest = [tail(queries[:, c:], 1) for c in cuts[1:]]
    # Two blocks for all rows at once, in one product; then each query goes on with its own survivors.
    first = min(2, len(cuts) - 1)
    partial = queries[:, : cuts[first]] @ columns[: cuts[first]] if dims else np.zeros((len(queries), len(ids)), dtype=kind)
    out = []
    for q in range(len(queries)):
        alive = np.flatnonzero(ids != query_ids[q])
        score = partial[q][alive]
        for b in range(first, len(cuts)):
            slack = query_rest[b - 1][q] * row_rest[b - 1][alive] if dims else np.zeros(len(alive))
            if len(alive) > k:
                low = (score - slack).astype(np.float64)
                bound = np.partition(low, len(low) - k)[len(low) - k]
                stay = (score + slack).astype(np.float64) >= bound - 1e-6 * (1 + abs(bound))
                alive, score = alive[stay], score[stay]
            if b < len(cuts) - 1:
                score = score + queries[q, cuts[b] : cuts[b + 1]] @ columns[cuts[b] : cuts[b + 1], alive]
        if len(alive) > k:
            best = np.sort(score)[len(score) - k]
            alive, score = alive[score >= best], score[score >= best]
        out.append((alive, score))
    return out


def _search(k: int):
    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[list] = [[], [], []]
        if rows.num_rows and queries.num_rows:
            ids, query_ids = rows.column("vec_id").to_numpy(), queries.column("vec_id").to_numpy()
            q = _matrix(queries.column("v"))
            v = _matrix(rows.column("v"), q.shape[1])
            if v.shape[1] > q.shape[1]:
                q = np.pad(q, ((0, 0), (0, v.shape[1] - q.shape[1])))
            for at in range(0, len(q), QUERIES_AT_ONCE):
                ask = slice(at, at + QUERIES_AT_ONCE)
                for query, (where, score) in zip(query_ids[ask], search_block(ids, v, query_ids[ask], q[ask], k), strict=True):
                    # Of equal scores the k smallest ids are enough.
                    best = np.lexsort((ids[where], -score.astype(np.int64)))[:k]
                    found[0] += [query] * len(best)
                    found[1] += ids[where][best].tolist()
                    found[2] += [int(x) for x in score[best]]
        return pa.table({n: pa.array(x, pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), found, strict=True)})

    return run


def exact_top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the k best rows for each query (all, if fewer), ties to the smaller vec_id.

    is_query is a condition on vec_id.  Rows with the query's own id are no candidates.  Of rows that share a query's id
    the smallest vector asks; as candidates, repeated rows each count.  Vectors of different lengths are compared over
    the dimensions that both have.  Other columns are not read; an empty table gives an empty table.

    Work grows with queries times rows.  A row is copied once for each QUERIES_PER_BLOCK queries, a query once for each
    ROWS_PER_BLOCK rows, and the best of all pairs of blocks are ranked together.
    """
    rows = quantised(vectors, id_col, vec_col, scale)
    queries = checkpointed(rows.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v")))
    blocks, asks = rows.count() // ROWS_PER_BLOCK + 1, queries.count() // QUERIES_PER_BLOCK + 1
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # The place of a row keeps equal rows from meeting in one block.
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("vec_id", "v", F.monotonically_increasing_id()), F.lit(blocks))).withColumn("ask", every(asks))
    asked = queries.withColumn("ask", F.pmod(F.xxhash64("vec_id"), F.lit(asks))).withColumn("block", every(blocks))
    found = dealt.groupBy("block", "ask").cogroup(asked.groupBy("block", "ask")).applyInArrow(_search(k), FOUND)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
