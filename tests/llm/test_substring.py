import random

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import shared, substring
from tests.llm import cases


def brute(rows, window):
    docs = [(-(1 << 63) if r[0] is None else r[0], (r[1] or "").encode().split()) for r in rows]
    first = {}
    for i, w in docs:
        for k in range(len(w) - window + 1):
            g = tuple(w[k : k + window])
            first[g] = min(first.get(g, i), i)
    out = []
    for i, w in docs:
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first[tuple(w[k : k + window])] < i:
                gone[k : k + window] = [True] * window
        out.append((None if i == -(1 << 63) else i, len(w), sum(gone), b" ".join(x for x, g in zip(w, gone) if not g).decode()))
    return sorted(out, key=str)


def check(spark, data, window=13):
    docs = cases.documents(spark, data)
    got = substring.without_repeats(docs, window)
    rows = got.collect()
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], " ".join((r["kept"] or "").encode().split()[0:0]) or b" ".join((r["kept"] or "").encode().split()).decode()) for r in rows), key=str) == brute(data, window)
    same = got.where("n_removed = 0").select(F.col("kept").alias("text"), *(F.col(f"row.{shared.quoted(c)}").alias(c) for c in docs.columns if c != "text")).select(*map(shared.quoted, docs.columns))
    assert same.exceptAll(docs).count() == 0  # untouched rows come back as they were
    assert got.select("row.*").columns == [c for c in docs.columns if c != "text"]


def test_edge_cases(spark):
    check(spark, cases.rows())
    assert substring.without_repeats(cases.empty(spark)).count() == 0


def test_few_words_many_repeats(spark):
    rng = random.Random(8)
    check(spark, [(i, cases.words(rng, rng.randrange(0, 60), 3), "en", "a") for i in range(150)], 5)
    check(spark, [(i, cases.words(rng, rng.randrange(0, 40), 2), "en", "a") for i in range(60)], 2)


def test_lengths_double(spark):
    assert substring.levels(13) == [7, 13] and substring.levels(50) == [7, 13, 25, 50] and substring.levels(3) == [3]
    rng = random.Random(10)
    long, short = cases.words(rng, 70), cases.words(rng, 30)
    check(spark, [(i, f"{cases.words(rng, 25)} {long if i % 2 else short} {cases.words(rng, 25)}", "en", "a") for i in range(40)], 50)


def test_a_third_of_all_rows_are_copies(spark):
    rng = random.Random(9)
    same = cases.words(rng, 50)
    check(spark, [(i, same if i % 3 == 0 else cases.words(rng, 40), "en", "a") for i in range(300)])


def test_packing_of_numbers():
    rng = np.random.default_rng(1)
    for top in (50, 10**6, 1 << 40):
        values = np.unique(rng.integers(0, top, 500).astype(np.uint64))
        for gap in (1.0, 5000.0, 1e6, 1e12):
            assert (substring.unpacked(substring.packed(values, gap)) == values).all()
    assert len(substring.unpacked(substring.packed(np.zeros(0, np.uint64), 5.0))) == 0


def test_a_doc_id_that_most_rows_have(spark, monkeypatch):
    monkeypatch.setattr(substring, "RANGE_BYTES", 3000)
    rng = random.Random(11)
    same = cases.words(rng, 30)
    for hot in (7, None):
        check(spark, [(i if i % 4 == 0 else hot, f"{cases.words(rng, 20)} {same if i % 5 == 0 else ''} {cases.words(rng, 9, 5)}", "en", "a") for i in range(200)])


def test_nothing_is_left_registered(spark):
    before = {t.name for t in spark.catalog.listTables()}
    assert substring.without_repeats(cases.documents(spark)).count() == len(cases.rows())
    assert {t.name for t in spark.catalog.listTables()} == before


def test_levels_end_with_the_candidates(spark, monkeypatch):
    levels = []
    written = shared.written
    monkeypatch.setattr(shared, "written", lambda df, tag: levels.append(tag) or written(df, tag))
    check(spark, [(i, " ".join(f"w{i}x{k}" for k in range(60)), "en", "a") for i in range(40)], 50)
    assert "windows-7" in levels and "windows-50" not in levels
