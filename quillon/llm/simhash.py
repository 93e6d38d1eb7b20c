"""SimHash near-duplicates by a generalised pigeonhole.

Fingerprints: ASCII letters in lower case, words between white space, shingles of three words (fewer words: the whole
sequence), XXH64 with seed 42; a bit is set if it is set in over half of the shingles' hashes. No words: zero.

Links: two fingerprints that differ in at most ``radius`` bits. Equal fingerprints are first counted as one. Bits are
grouped into partitions so that correlated bits stand together; dynamic programming over estimated candidate counts
gives each partition a threshold t (-1: not probed) with sum(t + 1) = radius + 1. Two fingerprints within the radius
then differ by at most t bits in at least one partition (generalised pigeonhole), so a fingerprint is indexed under its
value in each probed partition and probes all values within t bits. Fingerprints that meet under a key are verified.
A key that more than ``LIMIT`` rows share is split: its rows meet again under the key and one more of radius + 1 equal
parts of the bits outside it, of which at least one agrees; this is exact and repeats as often as needed. Within a key,
links are reduced to a spanning forest, so their number stays below that of the fingerprints.

Components: large-star and small-star rounds over the links, each round written to the shared folder.

Nulls: a null text is empty; a null doc_id counts as a document but not as a smallest id (a component of null ids has a
null id). Repeated rows stay. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm import shared

BITS, SEED, SHINGLE = 64, 42, 3
#: Rows under one key that are compared with each other in one task.
LIMIT = 512
#: Bytes beyond which a text is hashed in slices of words.
LONG = 4 << 20
#: Rows of one key up to which a join needs no care.
CROWD = 100_000


# --- fingerprints ---------------------------------------------------------------------------


def shingle_hashes(text: bytes) -> np.ndarray:
    one = b" ".join(text.lower().split())
    if not one:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(one, np.uint8) == 32)
    if len(gaps) < SHINGLE - 1:
        return np.array([xxhash.xxh64_intdigest(one, SEED)], np.uint64)
    starts = [0, *(gaps[: len(gaps) - SHINGLE + 1] + 1).tolist()]
    ends = [*gaps[SHINGLE - 1 :].tolist(), len(one)]
    h = xxhash.xxh64_intdigest
    return np.array([h(one[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64)


def _slices(text: bytes) -> Iterator[bytes]:
    """The text, or where it is long parts of it that hold each shingle once."""
    if len(text) <= LONG:
        yield text
        return
    parts = shared.word_slices(np.frombuffer(text, np.uint8), shared.SPACE, LONG // 64, after=SHINGLE - 1)
    for k, (part, _) in enumerate(parts):
        if k == 0 or len(part.split(None, SHINGLE - 1)) >= SHINGLE:
            yield part


def fingerprint(text: str | None) -> int:
    """The bits that are set in over half of the hashes."""
    total, n = np.zeros(BITS, np.int64), 0
    for part in _slices((text or "").encode()):
        hashes = shingle_hashes(part)
        n += len(hashes)
        for k in range(0, len(hashes), 1 << 16):
            total += np.unpackbits(hashes[k : k + (1 << 16), None].view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view(np.uint64)[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in shared.regrouped(batches, "text"):
        one = chunk.combine_chunks().to_batches()[0]
        bits = np.array([fingerprint(t) for t in one.column("text").to_pylist()], np.uint64)
        yield pa.RecordBatch.from_arrays([one.column("doc_id"), one.column("text_hash"), pa.array(bits.view(np.int64))], names=["doc_id", "text_hash", "bits"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, xxhash64 of the text, and the fingerprint as a signed long."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("text_hash"), F.col("text").cast("string").alias("text")).mapInArrow(
        _fingerprints, "doc_id long, text_hash long, bits long"
    )


# --- partitions and thresholds --------------------------------------------------------------


def _bit_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    both, n = np.zeros((BITS, BITS)), 0
    for b in batches:
        x = np.unpackbits(b["bits"].to_numpy()[:, None].view(np.uint8), axis=1, bitorder="little").astype(np.float32)
        both += x.T @ x
        n += len(x)
    i, j = np.indices((BITS, BITS))
    yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "both": both.ravel().astype(np.int64), "n": n})


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """The number of fingerprints, and how many have both bits, for each pair of bits; counted over all of them."""
    rows = distinct.select("bits").mapInPandas(_bit_counts, "i int, j int, both long, n long").groupBy("i", "j").agg(F.sum("both").alias("both"), F.sum("n").alias("n")).collect()
    both = np.zeros((BITS, BITS))
    for r in rows:
        both[r["i"], r["j"]] = r["both"]
    return (int(rows[0]["n"]) if rows else 0), both


def grouped_bits(n: int, both: np.ndarray, parts: int) -> list[list[int]]:
    """Bits dealt to parts of nearly equal width; a part takes the bit most correlated with those it has."""
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    free, out = list(range(BITS)), []
    for k in range(parts):
        width = BITS // parts + (k < BITS % parts)
        part = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(part[0])
        while len(part) < width:
            best = max(free, key=lambda b: (corr[b, part].sum(), -b))
            part.append(best)
            free.remove(best)
        out.append(sorted(part))
    return out


def candidate_estimates(n: int, both: np.ndarray, part: list[int], radius: int) -> list[float]:
    """Estimated pairs that differ in at most t bits of the part, for t from 0, from each bit's share of ones, bits of
    the part taken as independent."""
    p = both.diagonal()[part] / max(n, 1)
    differ = 2 * p * (1 - p)
    dist = np.zeros(radius + 1)
    dist[0] = 1
    for d in differ:
        dist = dist * (1 - d) + np.concatenate([[0], dist[:-1]]) * d
    return (np.cumsum(dist) * n * (n - 1) / 2).tolist()


def thresholds(cost: list[list[float]], radius: int) -> list[int]:
    """One threshold for each part, -1 where it is not probed, with sum(t + 1) = radius + 1 and the least total cost.
    cost[k][t]: that of part k at threshold t."""
    best: list[dict[int, tuple[float, list[int]]]] = [{0: (0.0, [])}]
    for by_t in cost:
        row: dict[int, tuple[float, list[int]]] = {}
        for used, (c, ts) in best[-1].items():
            for t in range(-1, radius + 1 - used):
                more = c + (by_t[t] if t >= 0 else 0.0)
                if used + t + 1 not in row or more < row[used + t + 1][0]:
                    row[used + t + 1] = (more, [*ts, t])
        best.append(row)
    return best[-1][radius + 1][1]


def plan(distinct: DataFrame, radius: int) -> list[tuple[int, int]]:
    """(mask, threshold) of the probed partitions, for the number of partitions that is estimated to be cheapest."""
    n, both = bit_statistics(distinct)
    options = []
    for parts in range(radius + 1, radius + 4):
        groups = grouped_bits(n, both, parts)
        cost = [candidate_estimates(n, both, g, radius) for g in groups]
        # a threshold of t makes about width ** t more rows to deal out and sort, for each fingerprint
        cost = [[c + n * sum(len(list(combinations(range(len(g)), d))) for d in range(t + 1)) for t, c in enumerate(by_t)] for g, by_t in zip(groups, cost, strict=True)]
        ts = thresholds(cost, radius)
        options.append((sum(cost[k][t] for k, t in enumerate(ts) if t >= 0), [(sum(1 << b for b in g), t) for g, t in zip(groups, ts, strict=True) if t >= 0]))
    return min(options, key=lambda x: x[0])[1]


# --- links ----------------------------------------------------------------------------------


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def parts_outside(mask: int, radius: int) -> list[int]:
    """The bits outside the mask in radius + 1 parts of nearly equal width."""
    rest = [b for b in range(BITS) if not mask >> b & 1]
    return [sum(1 << b for b in rest[k :: radius + 1]) for k in range(radius + 1)]


def _keyed(probes: list[tuple[int, int]]):
    """For each fingerprint its own key and, at thresholds over 0, those near it, under each probed partition."""
    flips = [(mask, [sum(1 << b for b in c) for d in range(t + 1) for c in combinations([b for b in range(BITS) if mask >> b & 1], d)]) for mask, t in probes]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            bits = b["bits"].to_numpy()
            for mask, changes in flips:
                for c in changes:
                    yield pd.DataFrame({"mask": _signed(mask), "key": (bits & np.int64(_signed(mask))) ^ np.int64(_signed(c)), "bits": bits, "own": c == 0})

    return run


def forest(bits: np.ndarray, own: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what links of the rows connect: a spanning forest. Only pairs with an indexed row count."""
    x = bits.view(np.uint64)
    parent = list(range(len(x)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i in range(len(x) - 1):
        near = np.flatnonzero((np.bitwise_count(x[i + 1 :] ^ x[i]) <= radius) & (own[i + 1 :] | own[i])) + i + 1
        for j in near.tolist():
            if (a := root(i)) != (b := root(j)):
                parent[b] = a
                if x[i] != x[j]:
                    out.append((int(bits[i]), int(bits[j])))
    return out


def _links(radius: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for b in _with_end(batches):
            rows = held if b is None else b if held is None else pd.concat([held, b], ignore_index=True)
            if rows is None or not len(rows):
                continue
            mask, key = rows["mask"].to_numpy(), rows["key"].to_numpy()
            cut = np.flatnonzero((mask[1:] != mask[:-1]) | (key[1:] != key[:-1])) + 1
            cuts = np.concatenate([[0], cut, [len(rows)] if b is None else []]).astype(int)
            bits, own = rows["bits"].to_numpy(), rows["own"].to_numpy()
            out = [link for a, e in zip(cuts, cuts[1:], strict=False) if e - a > 1 for link in forest(bits[a:e], own[a:e], radius)]
            held = rows.iloc[cuts[-1] :]  # its group may go on
            if out:
                yield pd.DataFrame(out, columns=["a", "b"])

    return run


def _with_end(batches):
    yield from batches
    yield None


def links(distinct: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) between different fingerprints that connect all within the radius of each other."""
    spark = distinct.sparkSession
    n = shared.partitions(spark)
    waiting = shared.written(distinct.select("bits").mapInPandas(_keyed(plan(distinct, radius)), "mask long, key long, bits long, own boolean"), "simhash-keys")
    found: list[DataFrame] = []
    while True:
        full = waiting.groupBy("mask", "key").count().where(F.col("count") > LIMIT).select("mask", "key")
        masks = [r["mask"] for r in full.select("mask").distinct().collect()]  # parts, never more than (radius + 1) ** depth
        ready = waiting.join(full, ["mask", "key"], "left_anti") if masks else waiting
        found.append(ready.repartition(n, "mask", "key").sortWithinPartitions("mask", "key", "bits").mapInPandas(_links(radius), "a long, b long"))
        split = [(m, p) for m in masks for p in parts_outside(m & ((1 << 64) - 1), radius) if p]
        if not split:
            break
        finer = spark.createDataFrame([(m, _signed(p), _signed((m & ((1 << 64) - 1)) | p)) for m, p in split], "mask long, part long, both long")
        waiting = shared.written(
            waiting.join(full, ["mask", "key"], "left_semi")
            .join(F.broadcast(finer), "mask")  # radius + 1 rows for each mask
            .select(F.col("both").alias("mask"), F.col("key").bitwiseOR(F.col("bits").bitwiseAND(F.col("part"))).alias("key"), "bits", "own"),
            "simhash-keys",
        )
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return shared.written(out.distinct(), "simhash-links")


# --- components -----------------------------------------------------------------------------


def looked_up(rows: DataFrame, found: DataFrame, key: str, total: int) -> DataFrame:
    """rows joined with found, which has one row for each key and the number n of rows with it. Keys with many rows are broadcast: of
    total rows, 4 times as many such keys as there are partitions at most."""
    if total <= CROWD:
        return rows.join(found.drop("n"), key)
    limit = max(CROWD, total // (4 * shared.partitions(rows.sparkSession)))
    crowded = F.broadcast(found.where(F.col("n") > limit).drop("n"))
    rest = rows.join(F.broadcast(found.where(F.col("n") > limit).select(key)), key, "left_anti")
    return rows.join(crowded, key).unionByName(rest.join(found.where(F.col("n") <= limit).drop("n"), key))


def _with_least(edges: DataFrame, total: int) -> DataFrame:
    """Edges with the smallest b of each a (m). Few edges (total) are sorted by a, once; of many, smallest ones are aggregated before they
    are shuffled, and those of crowded nodes broadcast."""
    if total <= CROWD:
        return edges.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return looked_up(edges, edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")), "a", total)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b); root: the smallest node that it is connected with. Large-star and
    small-star rounds."""
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    state = [F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("sum")]
    before = edges.agg(*state).first()
    while before["n"]:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both, 2 * before["n"]).where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.least("m", "a").alias("b")).where(F.col("a") != F.col("b"))
        small = _with_least(large, 2 * before["n"]).select(F.explode(F.array(F.struct(F.col("a"), F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = shared.written(small.where(F.col("a") != F.col("b")).distinct(), "components")
        after = edges.agg(*state).first()
        if after == before:
            break
        before = after
    shared.release(edges.sparkSession)
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, radius: int = 2) -> DataFrame:
    """doc_id, text_hash, bits, root and component_id for each document. root: the same for all of a component;
    component_id: the smallest doc_id that links lead to."""
    with shared.small_batches(docs.sparkSession):
        marked = shared.written(fingerprints(docs), "fingerprints")
    distinct = shared.written(marked.groupBy("bits").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "fingerprints-distinct")
    roots = components(links(distinct, radius)).withColumnRenamed("node", "bits")
    rooted = distinct.join(roots, "bits", "left").select("bits", "first", "n", F.coalesce("root", "bits").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    found = looked_up(rooted.withColumnRenamed("n", "copies"), smallest, "root", distinct.count()).withColumnRenamed("copies", "n")
    found = shared.written(found, "fingerprints-rooted")
    return looked_up(marked, found, "bits", marked.count()).select("doc_id", "text_hash", "bits", "root", "component_id")


def deduplicated(docs: DataFrame, radius: int = 2) -> DataFrame:
    """One row of docs for each component: that of the smallest doc_id (null last), then of the smallest hash of the text."""
    found = near_duplicates(docs, radius)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))
    return shared.chosen_rows(docs, shared.written(first.select("first.doc_id", "first.text_hash"), "simhash-kept"), once=True)
