"""Exact top-k search: tiled integer matrix products, selection within each tile, tree merging of the lists.

Vectors are quantised to floor(scale * x) and packed in blocks, as 16-bit numbers where they fit. Groups of query blocks meet
groups of shard blocks in the cells of a grid, which are dealt out to tasks; a query block is sent once to each group of
shards, a shard once to each group of queries. Within a cell each pair of blocks is a tile: one matrix product, of which
the k best of each query are kept. The lists of a query are then merged in rounds, a few at a time, first within the cell, until one is left.
Every score is computed.

Nulls: rows with a null id, a null vector, or a null or non-finite component take no part. Vectors of unequal length are
padded with zeros. A query's own row is every row with its id. Repeated candidate rows count each; of repeated query
ids the smallest vector asks. Ties go to the smaller id. Scores beyond 64 bits are clamped to the range of a long. Fewer
than k candidates give fewer rows; no query, or no table, gives none. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import shared

#: Vectors in a block, and the most blocks in a group: so many, or as many as have so many bytes. Cells of the grid at most,
#: where groups are smaller, and those that there are rather than that shards are sent more than twice.
BLOCK, GROUP, GROUP_BYTES, CELLS, FEW = 1024, 16, 32 << 20, 512, 64
FAN_IN = 8
_EXACT = 1 << 53


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, vec): whole numbers as doubles; only rows that take part."""
    usable = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return (
        df.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec"))
        .where(F.col("id").isNotNull() & F.col("vec").isNotNull())
        .where(usable)
        .select("id", F.transform("vec", lambda x: _floor(x * scale)).alias("vec"))
    )


def _floor(x):
    """floor() as a double: that of SQL gives a long, which can't hold large values."""
    whole = x - x % F.lit(1.0)
    return F.when(F.abs(x) >= float(1 << 52), x).otherwise(F.when(x % F.lit(1.0) < 0, whole - 1.0).otherwise(whole))


def _blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows packed in blocks, in the order of ids: ids, vectors row by row, and their length."""

    def packed(rows: list[tuple[int, np.ndarray]]) -> pd.DataFrame:
        rows.sort(key=lambda r: r[0])
        dim = max(len(v) for _, v in rows)
        mat = np.zeros((len(rows), dim))
        for k, (_, v) in enumerate(rows):
            mat[k, : len(v)] = v
        return pd.DataFrame({"ids": [np.array([r[0] for r in rows], np.int64).tobytes()], "mat": [mat.astype(np.int16).tobytes() if np.abs(mat).max(initial=0) < 1 << 15 else mat.tobytes()], "dim": [dim]})

    held: list[tuple[int, np.ndarray]] = []
    for b in batches:
        held += zip(b["id"], b["vec"], strict=True)
        while len(held) >= BLOCK:
            yield packed(held[:BLOCK])
            del held[:BLOCK]
    if held:
        yield packed(held)


def _unpacked(ids: bytes, mat: bytes, dim: int) -> tuple[np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(mat, np.int16 if len(mat) == 2 * len(i) * dim else np.float64).reshape(len(i), dim).astype(np.float64)


def best_of_tile(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate id, score) of the k best candidates of each query of the tile."""
    dim = max(q.shape[1], c.shape[1])
    q, c = (np.pad(m, ((0, 0), (0, dim - m.shape[1]))) for m in (q, c))
    order = np.argsort(c_ids, kind="stable")
    c, c_ids = c[order], c_ids[order]
    n = len(c_ids)
    bound = dim * float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0))
    if bound * n + n < _EXACT:  # the product and the place of the tie-break fit a double exactly
        key = q @ c.T * n + np.arange(n - 1, -1, -1)
        key[q_ids[:, None] == c_ids[None, :]] = -np.inf
        take = min(k, n)
        top = np.argpartition(-key, take - 1, axis=1)[:, :take]
        kept = np.take_along_axis(key, top, 1) > -np.inf
        rows, top = np.repeat(np.arange(len(q)), take).reshape(-1, take)[kept], top[kept]
        return rows, c_ids[top], np.rint(np.einsum("ij,ij->i", q[rows], c[top])).astype(np.int64)
    # Products that fit 64 bits are exact as such; other pairs, each alone, are not bounded.
    high_q, high_c = (np.abs(m).max(axis=1, initial=0) for m in (q, c))
    wide = np.outer(high_q, high_c) * dim >= 2.0**62
    own, other = (np.where(h[:, None] < 2.0**62, m, 0).astype(np.int64) for m, h in ((q, high_q), (c, high_c)))
    score = np.where(wide, 0, own @ other.T)
    rows, ids, scores = [], [], []
    for r in range(len(q)):
        free = np.flatnonzero(~wide[r] & (c_ids != q_ids[r]))
        free = free[np.lexsort((c_ids[free], -score[r, free]))[:k]]
        found = list(zip((-score[r, free]).tolist(), c_ids[free].tolist(), strict=True))
        v = [int(x) for x in q[r]] if wide[r].any() else []
        found += [(-sum(a * int(b) for a, b in zip(v, c[j], strict=True)), int(c_ids[j])) for j in np.flatnonzero(wide[r] & (c_ids != q_ids[r])).tolist()]
        found = sorted(found)[:k]
        rows += [r] * len(found)
        ids += [i for _, i in found]
        scores += [min(max(-s, -(1 << 63)), (1 << 63) - 1) for s, _ in found]
    return np.array(rows, np.int64), np.array(ids, np.int64), np.array(scores, np.int64)


def merged(lists: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One list (query row, candidate id, score) of the k best of each query of several."""
    rows, ids, score = (np.concatenate(x) for x in zip(*lists, strict=True))
    score = np.maximum(score, -(2**63) + 1)
    order = np.lexsort((ids, -score, rows))
    rows, ids, score = rows[order], ids[order], score[order]
    kept = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
    return rows[kept], ids[kept], score[kept]


def _cell(k: int):
    """The k best of each query in its cell. Tiles of one query block that follow each other are merged, FAN_IN lists at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, lists = None, []

        def found() -> pd.DataFrame:
            rows, ids, score = merged(lists, k)
            return pd.DataFrame({"query_id": np.frombuffer(key[1], np.int64)[rows], "cell": key[0], "worse": -score, "vec_id": ids})

        for b in batches:
            for cell, q_ids, q_mat, q_dim, ids, mat, dim in zip(*(b[c] for c in ("cell", "q_ids", "q_mat", "q_dim", "ids", "mat", "dim")), strict=True):
                if key != (cell, q_ids):
                    if lists:
                        yield found()
                    key, lists = (cell, q_ids), []
                (qi, q), (ci, c) = _unpacked(q_ids, q_mat, q_dim), _unpacked(ids, mat, dim)
                lists.append(best_of_tile(q, qi, c, ci, k))
                if len(lists) == FAN_IN:
                    lists = [merged(lists, k)]
        if lists:
            yield found()

    return run


def top_k(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """The k best rows of each query: query_id, rank, vec_id, score. is_query: a condition on the id column."""
    spark = vectors.sparkSession
    block = "ids binary, mat binary, dim int"
    asking = quantised(vectors.where(is_query), id_col, vec_col, scale).groupBy("id").agg(F.min("vec").alias("vec"))
    numbered = F.monotonically_increasing_id()
    with shared.small_batches(spark, BLOCK):
        shards = shared.written(quantised(vectors, id_col, vec_col, scale).mapInPandas(_blocks, block).withColumn("no", numbered), "topk-shards")
        queries = shared.written(asking.mapInPandas(_blocks, block), "topk-queries")
    n_shards, size = shards.agg(F.count("*"), F.max(F.octet_length("mat"))).first()
    n_blocks, cells = queries.count(), min(2 * shared.partitions(spark), CELLS)
    # Smaller cells where there are few tiles for the tasks, but with half of the queries in each where that leaves enough of them.
    side = max(1, math.isqrt(n_shards * n_blocks // cells), min(math.ceil(n_blocks / 2), math.isqrt(n_shards * n_blocks // FEW)))
    side = min(side, max(GROUP, GROUP_BYTES // max(size or 1, 1)))
    groups, query_groups = max(1, math.ceil(n_shards / side)), max(1, math.ceil(n_blocks / side))

    def each(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    right = shards.withColumn("cell", F.pmod(F.xxhash64("no"), F.lit(groups)).cast("int")).withColumn("asked", each(query_groups)).drop("no")
    left = queries.select(F.col("ids").alias("q_ids"), F.col("mat").alias("q_mat"), F.col("dim").alias("q_dim"), F.pmod(F.xxhash64("ids"), F.lit(query_groups)).cast("int").alias("asked"))
    left = left.withColumn("cell", each(groups))
    # By sorting, as Spark takes either side for as small as its table and would send all of its copies through the driver.
    tiles = left.hint("merge").join(right, ["cell", "asked"]).select("cell", "q_ids", "q_mat", "q_dim", "ids", "mat", "dim")
    with shared.small_batches(spark, 4):
        lists = shared.written(tiles.mapInPandas(_cell(k), "query_id long, cell int, worse long, vec_id long"), "topk-lists")
    best = F.slice(F.array_sort(F.flatten(F.collect_list("best"))), 1, k).alias("best")
    lists = lists.groupBy("query_id", "cell").agg(F.slice(F.array_sort(F.collect_list(F.struct("worse", "vec_id"))), 1, k).alias("best"))
    while groups > 1:
        lists = lists.withColumn("cell", F.expr(f"cell div {FAN_IN}")).groupBy("query_id", "cell").agg(best)
        groups = math.ceil(groups / FAN_IN)
    return lists.select("query_id", F.posexplode("best").alias("place", "one")).select(
        "query_id", (F.col("place") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), (-F.col("one.worse")).alias("score")
    )
