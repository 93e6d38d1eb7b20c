"""Sharding: a consistent-hash ring with virtual nodes and bounded loads.

Each shard has virtual nodes on a 63-bit ring. A row's key is hashed to a point and belongs to the next virtual node
clockwise; where that shard is full, it continues clockwise to the next node whose shard is not. A shard may hold
ceil((1 + slack) * rows / shards); with slack 0 the counts of shards differ by one at most (law ``rows``).

Rows between two neighbouring nodes (an arc) meet the same nodes in the same order, so the walk is settled for whole arcs
on the driver: from counts by arc (shards * vnodes numbers, whatever the input) it makes ranges of ranks within an arc
that go to the same shard. Rows then only need their rank within the arc, which is counted within equal cells of the ring. Equal
rows are counted before the shuffle and share a range of ranks; they are made again in runs of ``RUN``, which are dealt out anew.

The point depends on doc_id, size and checksum of the text. Nulls: a null text has no bytes; a null doc_id is a key like
any other. Rows that agree in all of doc_id, size and checksum are interchangeable. An empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import shared

OVERHEAD = 16
RING = 1 << 63
#: Repeated rows that are made in one go.
RUN = 1 << 16


def ring(n_shards: int, vnodes: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Sorted points of the virtual nodes and the shard of each. A shard's points don't depend on n_shards."""
    points = np.concatenate([np.random.Generator(np.random.PCG64([seed, s])).integers(0, RING, vnodes, dtype=np.int64) for s in range(n_shards)])
    shard = np.repeat(np.arange(n_shards), vnodes)
    order = np.lexsort((shard, points))
    return points[order], shard[order]


def settle(counts: np.ndarray, shard: np.ndarray, capacity: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Walk whole arcs clockwise. counts: rows by arc (arc a ends at node a); shard: that of each node. Returns
    (arc, first rank, end rank, shard, first slot). In each round every waiting arc asks at its current node; a shard
    accepts the arcs that have walked least, then in ring order, as far as it has room; the rest walks on."""
    n = len(counts)
    waiting, taken, steps = counts.astype(np.int64).copy(), np.zeros(n, np.int64), np.zeros(n, np.int64)
    room, used = capacity.astype(np.int64).copy(), np.zeros(len(capacity), np.int64)
    out: list[tuple[int, int, int, int, int]] = []
    while (arcs := np.flatnonzero(waiting)).size:
        arcs = arcs[np.lexsort((arcs, steps[arcs]))]
        for a in arcs:
            s = shard[(a + steps[a]) % n]
            if k := min(room[s], waiting[a]):
                out.append((int(a), int(taken[a]), int(taken[a] + k), int(s), int(used[s])))
                room[s] -= k
                used[s] += k
                taken[a] += k
                waiting[a] -= k
            if waiting[a]:
                steps[a] += 1
                while room[shard[(a + steps[a]) % n]] == 0:
                    steps[a] += 1
    return out


def capacities(n_rows: int, n_shards: int, slack: float) -> np.ndarray:
    """Rows that each shard may hold; with slack 0 exactly n_rows in all."""
    if slack:
        return np.full(n_shards, -(-int(np.ceil(n_rows * (1 + slack))) // n_shards))
    return n_rows // n_shards + (np.arange(n_shards) < n_rows % n_shards)


def sharded(docs: DataFrame, n_shards: int, vnodes: int = 64, slack: float = 0.0) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for each row; slots of a shard are gapless from 0."""
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keys = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
        .groupBy("doc_id", "size", "text_crc32")
        .count()
        .withColumn("point", F.xxhash64("doc_id", "size", "text_crc32").bitwiseAND(F.lit(RING - 1)))
    )
    points, shard = ring(n_shards, vnodes)
    spark = docs.sparkSession

    def to_arc(batches):
        for b in batches:
            b["arc"] = (np.searchsorted(points, b["point"].to_numpy()) % len(points)).astype(np.int32)
            yield b

    keys = shared.written(keys.mapInPandas(to_arc, "doc_id long, size long, text_crc32 long, count long, point long, arc int"), "shard-keys")
    width = RING // (4 * shared.partitions(spark)) + 1
    keys = keys.withColumn("cell", F.expr(f"cast(point div {width} AS int)"))
    by_cell = sorted((r["arc"], r["cell"], r["n"]) for r in keys.groupBy("arc", "cell").agg(F.sum("count").alias("n")).collect())  # nodes and cells at most
    counts, starts = np.zeros(len(points), np.int64), []
    for a, c, k in by_cell:
        starts.append((a, c, int(counts[a])))
        counts[a] += k
    ranges = settle(counts, shard, capacities(int(counts.sum()), n_shards, slack))
    where = spark.createDataFrame(ranges, "arc int, lo long, hi long, shard int, base long")
    order = Window.partitionBy("arc", "cell").orderBy("point", "doc_id", "size", "text_crc32")
    ranked = keys.withColumn("before", F.sum("count").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("count"))
    # Starts and ranges are bounded by the ring and the partitions, not by the rows.
    ranked = ranked.join(F.broadcast(spark.createDataFrame(starts, "arc int, cell int, start long")), ["arc", "cell"]).withColumn("first", F.col("start") + F.col("before"))
    met = ranked.join(F.broadcast(where), "arc").where((F.col("lo") < F.col("first") + F.col("count")) & (F.col("first") < F.col("hi")))
    made = met.select("doc_id", "size", "text_crc32", "shard", "lo", "base", F.greatest("first", "lo").alias("rank"), F.least(F.col("first") + F.col("count"), "hi").alias("end"))
    run = F.least(F.col("end"), F.col("rank") + RUN)
    long = made.where(F.col("end") - F.col("rank") > RUN).withColumn("rank", F.explode(F.sequence("rank", F.col("end") - 1, F.lit(RUN)))).withColumn("end", run).repartition(shared.partitions(spark), "doc_id", "rank")
    made = made.where(F.col("end") - F.col("rank") <= RUN).unionByName(long).withColumn("rank", F.explode(F.sequence("rank", F.col("end") - 1)))
    return made.select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"))
