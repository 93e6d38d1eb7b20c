from pyspark.sql import functions as F

import corpus_pipeline
from quillon.llm import mixing, packing, queries, shared, toxicity
from tests.conftest import SF
from tests.llm import cases, test_nearcopies, test_packing, test_simhash, test_substring


def test_stages_on_edge_cases(spark, tmp_path):
    sf = str(tmp_path)
    spark.createDataFrame([(i, 1, i % 2) for i in range(50)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    for docs in (cases.documents(spark), cases.empty(spark)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES[:-1]:
            before, docs = docs, shared.written(stage(spark, docs, sf), name)
            assert docs.columns == columns and docs.count() <= before.count()
            if name != "substring_dedup":
                assert docs.exceptAll(before).count() == 0  # rows stay as they are
        corpus_pipeline.STAGES[-1][1](spark, docs, sf).count()


def test_substring_stage_against_brute_force(spark):
    data = [r for r in cases.rows() if r[0] != 108]
    got = corpus_pipeline.substring_dedup(spark, cases.documents(spark, data), "")
    want = [(i, kept) for i, n, gone, kept in test_substring.brute(data, 13) if gone == 0 or gone < n]
    assert sorted((str(r["doc_id"]), b" ".join((r["text"] or "").encode().split()).decode()) for r in got.collect()) == sorted((str(i), k) for i, k in want)
    assert got.where(F.length("text") != F.col("n_chars")).count() == 0


def test_whole_run(spark):
    docs = shared.table(spark, SF, "documents")
    clean = shared.written(corpus_pipeline.drop_toxic(spark, docs, SF), "clean")
    scores = {r["doc_id"]: r["score"] for r in toxicity.toxicity(docs, shared.table(spark, SF, "labels")).collect()}
    assert {r["doc_id"] for r in clean.collect()} == {i for i, s in scores.items() if s < toxicity.REJECT}
    kept = corpus_pipeline.near_dedup(spark, clean, SF).collect()
    rows = clean.collect()
    roots = test_simhash.brute_components([test_simhash.brute_bits(r["text"]) for r in rows])
    assert {r["doc_id"] for r in kept} == {min(r["doc_id"] for r, o in zip(rows, roots) if o == own) for own in set(roots)}
    whole = corpus_pipeline.run(spark, SF).collect()
    by_stage = {"toxicity": clean}
    for (before, _), (name, stage) in zip(corpus_pipeline.STAGES, corpus_pipeline.STAGES[1:]):
        by_stage[name] = shared.written(stage(spark, by_stage[before], SF), name)
    data = [(r["doc_id"], r["text"], None, None) for r in clean.collect()]
    assert sorted(r["doc_id"] for r in by_stage["near_dedup"].collect()) == test_nearcopies.brute_kept(data)
    drawn = mixing.mixed(by_stage["substring_dedup"]).where("selected").select("doc_id").collect()
    assert sorted(r["doc_id"] for r in by_stage["mixing"].collect()) == sorted(r["doc_id"] for r in drawn)
    texts = [r["text"] or "" for r in by_stage["mixing"].collect()]
    lengths = [n for ids in packing.Ids(queries.default_tokenizer()).encode(texts) for n in [2048] * ((len(ids) // 4 + 1) // 2048) + [(len(ids) // 4 + 1) % 2048] if n]
    assert sorted(r["length"] for r in whole) == sorted(lengths) == sorted(r["length"] for r in by_stage["packing"].collect())
    assert len({r["sequence_id"] for r in whole}) == test_packing.brute_best_fit(lengths, 2048)
