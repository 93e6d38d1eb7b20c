import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import sharding
from tests.llm import cases


def brute(counts, shard, capacity):
    """Row by row: rows of an arc walk on until a shard has room; arcs that have walked least ask first."""
    room, where = capacity.copy(), {}
    waiting = {a: list(range(c)) for a, c in enumerate(counts) if c}
    steps = dict.fromkeys(waiting, 0)
    while waiting:
        for a in sorted(waiting, key=lambda a: (steps[a], a)):
            s = shard[(a + steps[a]) % len(counts)]
            while waiting[a] and room[s]:
                where[a, waiting[a].pop(0)] = s
                room[s] -= 1
            if not waiting[a]:
                del waiting[a]
                continue
            steps[a] += 1
            while room[shard[(a + steps[a]) % len(counts)]] == 0:
                steps[a] += 1
    return where


def test_walk_of_arcs_is_that_of_rows():
    rng = np.random.default_rng(5)
    for _ in range(20):
        n_shards = int(rng.integers(1, 7))
        _, shard = sharding.ring(n_shards, 5)
        counts = rng.integers(0, 30, len(shard)) * rng.integers(0, 2, len(shard))
        capacity = sharding.capacities(int(counts.sum()), n_shards, float(rng.choice([0, 0.1])))
        got = {(a, r): s for a, lo, hi, s, _ in sharding.settle(counts, shard, capacity) for r in range(lo, hi)}
        assert got == brute(counts, shard, capacity)


def test_counts_slots_and_sizes(spark):
    docs = cases.documents(spark)
    got = sharding.sharded(docs, 7).collect()
    want = Counter((r["doc_id"], len((r["text"] or "").encode()) + 16, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    per = Counter(r["shard"] for r in got)
    assert max(per.values()) - min(per.values()) <= 1 and set(per) == set(range(7))
    assert all(sorted(r["slot"] for r in got if r["shard"] == s) == list(range(n)) for s, n in per.items())
    assert sharding.sharded(cases.empty(spark), 7).count() == 0


def test_one_key_with_a_third_of_the_rows(spark):
    docs = cases.documents(spark, [(7, "same", "en", "a")] * 300 + [(i, f"text {i}", "en", "a") for i in range(600)])
    per = sharding.sharded(docs, 8).groupBy("shard").count().agg(F.max("count"), F.min("count")).first()
    assert per[0] - per[1] <= 1


def test_movement_is_limited(spark):
    docs = cases.documents(spark, [(i, f"text {i}", "en", "a") for i in range(4000)])
    a, b = ({r["doc_id"]: r["shard"] for r in sharding.sharded(docs, n, slack=0.25).collect()} for n in (10, 11))
    assert sum(a[k] != b[k] for k in a) / len(a) < 0.35
