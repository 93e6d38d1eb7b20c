import math
import random

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import topk


def brute(rows, query, k):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for q in sorted({i for i, _ in usable if query(i)}):
        own = min(v for i, v in usable if i == q)
        scored = sorted((-max(min(sum(a * b for a, b in zip(own, v)), 2**63 - 1), -(2**63) + 1), i) for i, v in usable if i != q)[:k]
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)}
    return out


def run(spark, rows, query=lambda c: c % 5 == 0, k=5):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<double>, score string").repartition(3)
    got = topk.top_k(df, query(F.col("vec_id")), k)
    assert got.dtypes == [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint")]
    return {tuple(r) for r in got.collect()}


def test_against_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1.0, -0.5, 0.001, 0.25, 1.5]) for _ in range(6)]) for i in range(200)]
    rows += [(None, [1.0] * 6), (300, None), (301, [1.0, None, 1.0]), (302, [float("nan")] * 6), (303, [float("inf")] * 6), (305, []), (310, [2.0, 3.0]), (7, [9.0] * 6), (10, [9.0] * 6)]
    assert run(spark, rows) == brute(rows, lambda i: i % 5 == 0, 5)


def test_many_blocks_merge_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(topk, "GROUP", 1)
    monkeypatch.setattr(topk, "FAN_IN", 2)
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(5000)]
    assert run(spark, rows, lambda c: c % 500 == 0) == brute(rows, lambda i: i % 500 == 0, 5)


def test_few_rows_huge_values_and_empty(spark):
    rows = [(0, [1e30, -1e30]), (1, [1e30, 2.0]), (5, [1e9, 1e9])]
    assert run(spark, rows) == brute(rows, lambda i: i % 5 == 0, 5)
    assert run(spark, []) == set() and run(spark, [(1, [1.0])]) == set() and run(spark, [(5, [1.0])]) == set()


def test_blocks_are_not_broadcast_and_lists_merge_within_cells(spark, monkeypatch):
    """Copies of blocks must not pass through the driver, however small the table; a cell gives one list for each query block."""
    seen, written = {}, topk.shared.written

    def spied(df, tag):
        plan = df._jdf.queryExecution().executedPlan().toString()
        seen[tag] = (plan, written(df, tag))
        return seen[tag][1]

    monkeypatch.setattr(topk.shared, "written", spied)
    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = np.random.default_rng(2)
    rows = [(i, rng.integers(-3, 4, 4).astype(float).tolist()) for i in range(6000)]
    assert run(spark, rows, lambda c: c % 50 == 0) == brute(rows, lambda i: i % 50 == 0, 5)
    plan, lists = seen["topk-lists"]
    assert "Broadcast" not in plan
    assert lists.groupBy("query_id", "cell").count().where("count > 5").count() == 0


def test_lists_are_merged_exactly():
    rng = np.random.default_rng(4)
    lists = [(np.sort(rng.integers(0, 3, 20)), rng.integers(0, 50, 20), rng.integers(-5, 5, 20)) for _ in range(4)]
    lists.append((np.array([1, 2]), np.array([7, 8]), np.array([2**63 - 1, -(2**63)])))
    rows, ids, score = topk.merged(lists, 5)
    everything = [(int(r), -max(int(s), -(2**63) + 1), int(i)) for x in lists for r, i, s in zip(*x, strict=True)]
    want = [x for q in range(3) for x in sorted(e for e in everything if e[0] == q)[:5]]
    assert [(int(r), -int(s), int(i)) for r, i, s in zip(rows, ids, score, strict=True)] == want
