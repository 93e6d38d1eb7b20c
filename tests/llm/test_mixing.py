import warnings

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillon.llm import mixing, shared
from tests.llm import cases


def random_cells(seed):
    rng = np.random.default_rng(seed)
    rows = [(s, g, str(t), int(rng.integers(0, 500) * rng.choice([0, 1, 1, 20]))) for s in ("a", "b", "c", None) for g in ("en", "fr", None) for t in range(4) if rng.random() < 0.8]
    return pd.DataFrame(rows, columns=["source", "lang", "topic", "tokens"])


def brute_calibrated(cells, targets, keep):
    """Probabilities min(1, product of factors) with the given expected tokens by value: one factor at a time, by bisection."""
    rows = list(cells[["source", "lang", "topic", "tokens"]].itertuples(index=False, name=None))
    total = sum(r[3] for r in rows)
    factor = {(m, v): 1.0 for m, t in enumerate(targets) for v in t}
    p = [keep] * len(rows)
    for _ in range(300):
        for (m, v) in factor:
            goal = targets[m][v] * total * keep
            low, high = 0.0, 1e15
            mine = [(r[3], np.prod([factor[k, r[k]] for k in range(3) if k != m])) for r in rows if r[m] == v]
            for _ in range(100):
                mid = (low * high) ** 0.5 if low else high / 1e6 if high > 1e-9 else high / 2
                own = sum(n * min(1.0, mid * rate) for n, rate in mine)
                low, high = (mid, high) if own < goal * (1 - 1e-13) else (low, mid)
            factor[m, v] = high
        p = [min(1.0, float(np.prod([factor[k, r[k]] for k in range(3)]))) for r in rows]
        if all(abs(sum(r[3] * x for r, x in zip(rows, p) if r[m] == v) - targets[m][v] * total * keep) < 1e-9 * total for m, v in factor):
            break
    return p


@pytest.mark.parametrize("seed", range(40))
def test_expected_shares_are_the_targets(seed):
    got = mixing.calibrated(random_cells(seed))
    assert got.converged and abs(got.keep - mixing.KEEP) < 1e-6 and (got.cells["probability"] <= 1).all()
    assert np.abs(got.margins["target"] - got.margins["expected"]).max() < 1e-6
    assert np.allclose(got.margins.groupby("margin")["target"].sum(), 1)


def test_given_targets_are_met_with_the_largest_sample():
    cells = pd.DataFrame([(s, "en", str(t), n) for s, n in (("hot", 900), ("rare", 100)) for t in range(3)], columns=["source", "lang", "topic", "tokens"])
    got = mixing.calibrated(cells, {"source": {"hot": 0.5, "rare": 0.5}})
    assert got.converged and abs(got.keep - 0.2) < 1e-9
    assert got.cells.loc[got.cells["source"] == "rare", "probability"].tolist() == [1.0] * 3
    assert np.allclose(got.cells.loc[got.cells["source"] == "hot", "probability"], 1 / 9)
    part = mixing.calibrated(cells, {"topic": {"0": 0.2}}).margins.set_index(["margin", "value"])["expected"]
    assert abs(part["topic", "0"] - 0.2) < 1e-6 and abs(part["topic", "1"] - 0.4) < 1e-6
    with pytest.raises(ValueError):
        mixing.calibrated(cells, {"source": {"hot": 0.7, "rare": 0.5}})
    with pytest.raises(ValueError):
        mixing.calibrated(cells, {"sources": {"hot": 0.7}})


def test_targets_that_contradict_each_other_are_reported():
    cells = pd.DataFrame([("a", "en", "0", 10), ("b", "fr", "0", 10)], columns=["source", "lang", "topic", "tokens"])
    with pytest.warns(UserWarning):
        got = mixing.calibrated(cells, {"source": {"a": 0.9, "b": 0.1}, "lang": {"en": 0.1, "fr": 0.9}})
    assert not got.converged


def test_probabilities_against_bisection():
    for seed in (3, 8):
        cells = random_cells(seed)
        cells = cells[(cells["tokens"] > 0) & cells["topic"].isin(["0", "1"])].reset_index(drop=True)
        got = mixing.calibrated(cells)
        by = [dict(own[["value", "target"]].itertuples(index=False, name=None)) for _, own in got.margins.groupby("margin", sort=False)]
        want = brute_calibrated(cells, [{None if pd.isna(v) else v: t for v, t in b.items()} for b in by], got.keep)
        assert np.allclose(got.cells["probability"], want, atol=1e-6)


def brute_rows(data):
    """tokens and topic of each text, word by word."""
    out = []
    for _, text, _, _ in data:
        words = (text or "").encode().split()
        votes = [0] * mixing.TOPICS
        for w in words:
            votes[_hash(w) % mixing.TOPICS] += 1
        out.append((len(words), str(votes.index(max(votes)))))
    return out


def _hash(word):
    top = (1 << 64) - 1
    x = sum(int(shared._BYTE[b]) * pow(shared._BASE, k, 1 << 64) for k, b in enumerate(word)) + len(word) & top
    x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & top
    x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & top
    return x ^ x >> 32


def test_every_row_against_brute_force(spark):
    data = [r for r in cases.rows() if r[0] != 107]
    docs = cases.documents(spark, data)
    got = mixing.mixed(docs).collect()
    counts = brute_rows(data)
    rows = [(i, s, g, topic, n) for (i, _, g, s), (n, topic) in zip(data, counts)]
    assert sorted(map(str, rows)) == sorted(str((r["doc_id"], r["source"], r["lang"], r["topic"], r["tokens"])) for r in got)
    cells = pd.DataFrame([r[1:] for r in rows], columns=["source", "lang", "topic", "tokens"]).groupby(["source", "lang", "topic"], dropna=False, as_index=False)["tokens"].sum()
    plan = mixing.calibrated(cells)
    by = {tuple(None if pd.isna(v) else v for v in c[:3]): c[3:] for c in plan.cells[["source", "lang", "topic", "weight", "probability"]].itertuples(index=False, name=None)}
    draws = {(r["doc_id"], r["text_hash"]): r["d"] for r in spark.createDataFrame([(r["doc_id"], r["text_hash"]) for r in got], "doc_id long, text_hash long").selectExpr("*", "shiftrightunsigned(xxhash64(doc_id, text_hash, 4), 11) / 9007199254740992D AS d").collect()}
    for r in got:
        weight, probability = by[r["source"], r["lang"], r["topic"]]
        assert abs(r["weight"] - weight) < 1e-9 and abs(r["probability"] - probability) < 1e-9
        assert r["selected"] == (draws[r["doc_id"], r["text_hash"]] < r["probability"])


def test_small_values_are_raked_as_one(spark, monkeypatch):
    docs = cases.documents(spark, [(i, "some words here", "en", f"site{i}" if i % 2 else "hot") for i in range(400)])
    monkeypatch.setattr(mixing, "SMALL", 0.01)
    rows = mixing.counted(docs)
    plan, _ = mixing.calibration(rows)
    assert sorted(plan.cells["source"]) == ["*", "=hot"]
    named, _ = mixing.calibration(rows, {"source": {"site1": 1 / 400}})
    assert sorted(named.cells["source"]) == ["*", "=hot", "=site1"]
    assert mixing.mixed(docs, {"source": {"hot": 0.2}}).where("source = 'hot' AND probability > 0.26").count() == 0


def test_topics_can_be_given(spark):
    docs = cases.documents(spark)
    got = mixing.mixed(docs, topic=F.col("lang"))
    assert got.where(~F.col("topic").eqNullSafe(F.col("lang"))).count() == 0


def test_sampled_rows_come_back_whole(spark):
    docs = cases.documents(spark)
    got = mixing.sampled(docs)
    assert got.columns == docs.columns and got.exceptAll(docs).count() == 0
    want = mixing.mixed(docs).where("selected").count()
    assert got.count() == want == mixing.sampled(docs).count()
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert mixing.sampled(cases.empty(spark)).count() == 0


def test_draw_follows_the_probability(spark):
    docs = cases.documents(spark, [(i, f"word{i % 7} " * 20, "en", "hot" if i % 3 else "rare") for i in range(6000)])
    m = mixing.mixed(docs).groupBy("source").agg(F.avg(F.col("selected").cast("int")).alias("got"), F.avg("probability").alias("want")).collect()
    assert all(abs(r["got"] - r["want"]) < 0.03 for r in m)
