"""Exact top-k by integer inner product: columnar branch and bound over tiles.

Vectors become integers floor(scale * x). Queries and candidates are packed into blocks of bounded size;
every query block meets every candidate block (a stated query set against all rows). Inside a tile
the candidates stand component by component: for one query, scores grow by a block of components at
a time, and the candidates whose score so far plus the product of the remaining norms cannot reach
the tile's k-th best are dropped before the next components are read. A query's tiles are then merged.

Vectors that are null or hold null or non-finite components, and rows without an id, take no part. Rows with
the id of a query are that query itself; of several query rows with one id the least vector counts.
Missing components of shorter vectors count as 0. Ties go to the smaller id. Other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 2048
BLOCK_DIMS = 16
_EXACT = 2**53  # floats hold all integers below


def _matrix(lists, dims: int) -> np.ndarray:
    """Components in rows, vectors in columns."""
    n = len(lists)
    lengths = lists.value_lengths().to_numpy()
    values = lists.flatten().to_numpy()
    out = np.zeros((n, dims), dtype=np.int64)
    row = np.repeat(np.arange(n), lengths)
    ends = np.cumsum(lengths)
    out[row, np.arange(len(values)) - np.repeat(ends - lengths, lengths)] = values
    return np.ascontiguousarray(out.T)


def best_in_tile(query: np.ndarray, own_id: int, table: np.ndarray, ids: np.ndarray, rest: np.ndarray, k: int):
    """(ids, scores) of the k best of one tile. `rest[b]`: norms of the candidates from component block b on."""
    alive = np.flatnonzero(ids != own_id)
    if not len(alive):
        return ids[:0], np.zeros(0, dtype=np.int64)
    seed = alive[: 16 * k]
    known = query @ table[:, seed]
    floor = np.partition(known, len(known) - k)[len(known) - k] if len(known) >= k else None
    score = np.zeros(len(alive), dtype=query.dtype)
    starts = list(range(0, len(query), BLOCK_DIMS))
    for b, at in enumerate(starts):
        part = table[at : at + BLOCK_DIMS]
        score = score + query[at : at + BLOCK_DIMS] @ (part if len(alive) == part.shape[1] else part[:, alive])
        if b + 1 == len(starts):
            break
        left = float(np.sqrt(np.square(query[at + BLOCK_DIMS :].astype(np.float64)).sum()))
        most = score + left * rest[b + 1][alive] * (1 + 1e-9) + 1
        if len(alive) > k:
            sure = score - left * rest[b + 1][alive] * (1 + 1e-9) - 1
            least = np.partition(sure, len(sure) - k)[len(sure) - k]
            floor = least if floor is None else max(floor, least)
        if floor is not None:
            keep = most >= floor
            if keep.mean() < 0.8:
                alive, score = alive[keep], score[keep]
    if len(alive) > k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        alive, score = alive[score >= cut], score[score >= cut]
    order = np.lexsort((ids[alive], -score))[:k]
    return ids[alive][order], score[order].astype(np.int64)


def _tiles(k: int):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                queries, rows = batch.column("queries")[i].values, batch.column("rows")[i].values
                q_ids, ids = queries.field("id").to_numpy(), rows.field("id").to_numpy()
                qv, cv = queries.field("v"), rows.field("v")
                dims = max(int(qv.value_lengths().to_numpy().max()), int(cv.value_lengths().to_numpy().max()), 1)
                q, c = _matrix(qv, dims), _matrix(cv, dims)
                size = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * dims
                if size >= 2.0**62:
                    raise OverflowError("inner products of these vectors exceed 64 bits")
                norms = np.square(c.astype(np.float64))
                rest = [np.sqrt(norms[at:].sum(axis=0)) for at in range(0, dims, BLOCK_DIMS)]
                if size < _EXACT:
                    q, c = q.astype(np.float64), c.astype(np.float64)
                out = [best_in_tile(q[:, j], q_ids[j], c, ids, rest, k) for j in range(len(q_ids))]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat(q_ids, [len(x) for x, _ in out])),
                        pa.array(np.concatenate([x for x, _ in out])),
                        pa.array(np.concatenate([s for _, s in out])),
                    ],
                    names=["query_id", "vec_id", "score"],
                )

    return run


def exact_topk(
    vectors: DataFrame,
    query_where: str = "vec_id % 50 = 0",
    k: int = 5,
    scale: float = 256.0,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k highest scores of each query among all other rows.

    `query_where` is a condition on the id, called `vec_id` in it. Scores are exact integers; vectors so large
    that a score might not fit in 62 bits are refused.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    sound = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < math.inf))
    rows = rows.where(F.col("id").isNotNull() & F.col("x").isNotNull()).where(sound)
    rows = rows.select("id", F.transform("x", lambda x: F.floor(F.lit(scale) * x).cast("long")).alias("v"))
    queries = rows.withColumn("vec_id", F.col("id")).where(query_where).groupBy("id").agg(F.min("v").alias("v"))

    def blocks(table: DataFrame, name: str, block: str) -> tuple[DataFrame, int]:
        n = max(1, math.ceil(table.count() / block_rows))
        dealt = table.withColumn(block, F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
        return dealt.groupBy(block).agg(F.collect_list(F.struct("id", "v")).alias(name)), n

    q_blocks, n_q = blocks(queries, "queries", "q")
    c_blocks, _ = blocks(rows, "rows", "c")
    tiles = c_blocks.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1)))).join(q_blocks, "q")
    found = tiles.repartition("q", "c").select("queries", "rows").mapInArrow(_tiles(k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
