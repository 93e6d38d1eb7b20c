import random

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import fingerprint, mixing, nearcopies, quality, queries, sharding, shared, simhash, topk, toxicity
from tests.conftest import SF
from tests.llm import cases, test_simhash


def brute_hash(word):
    top = (1 << 64) - 1
    x = sum(int(shared._BYTE[b]) * pow(shared._BASE, k, 1 << 64) for k, b in enumerate(word)) + len(word) & top
    x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & top
    x = (x ^ x >> 32) * 0xD6E8FEB86659FD93 & top
    return x ^ x >> 32


@pytest.mark.parametrize("segment", [5, 64, 1 << 20])
def test_hashes_of_spans(monkeypatch, segment):
    monkeypatch.setattr(shared, "SEGMENT", segment)
    shared._powers.cache_clear()
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 300, dtype=np.uint8)
    starts = rng.integers(0, 290, 50)
    ends = np.minimum(starts + rng.integers(0, 100, 50), 300)
    assert shared.span_hash(data, starts, ends).tolist() == [brute_hash(data[a:e].tobytes()) for a, e in zip(starts, ends)]
    shared._powers.cache_clear()


@pytest.mark.parametrize("limit", [1, 10, 100, 10_000])
def test_words_of_texts_in_pieces(limit):
    rng = random.Random(2)
    texts = [None, "", " lead  and tail \n", *(cases.words(rng, n) for n in (1, 5, 200)), "x" * 300 + " y", "é\t" * 50]
    h, n = shared.word_hashes(pa.chunked_array([pa.array(texts[:4]), pa.array(texts[4:])]), limit)
    words = [(t or "").encode().split() for t in texts]
    assert n.tolist() == [len(w) for w in words] and h.tolist() == [brute_hash(w) for own in words for w in own]


def long_text(n_bytes):
    rng = random.Random(3)
    part = " ".join(f"word{rng.randrange(10**5)}" for _ in range(20_000))
    return (part + " ") * (n_bytes // len(part) + 1)


def test_long_texts_are_scored_as_whole(monkeypatch):
    text = long_text(30_000)
    texts = pa.array([text], pa.large_string())
    model = quality.Model(np.random.default_rng(1).standard_normal(1 << quality.BITS).astype(np.float32), 0.1)
    words = toxicity.Words(texts)
    net = toxicity.initial(*toxicity.vocabulary([words] * toxicity.KNOWN))
    want = (model.scores(texts)[0], toxicity.scores(net, texts)[0], simhash.fingerprint(text), mixing.TOPICS)
    for long in (1000, 5000):
        for m in (quality, toxicity, simhash):
            monkeypatch.setattr(m, "LONG", long)
        got = (model.scores(texts)[0], toxicity.scores(net, texts)[0], simhash.fingerprint(text), mixing.TOPICS)
        assert np.allclose(got[:2], want[:2], atol=1e-6) and got[2] == want[2] == test_simhash.brute_bits(text)


def test_long_texts_need_little_memory():
    """Of 24 MB, in a process of its own."""
    import subprocess
    import sys

    say = """
import resource, sys
import numpy as np, pyarrow as pa
from quillon.llm import fingerprint, mixing, nearcopies, quality, shared, simhash, toxicity
from tests.llm.test_shared import long_text
text = long_text(24 << 20)
batch = pa.RecordBatch.from_pydict({"text": pa.array([text], pa.string()), "doc_id": pa.array([1]), "text_hash": pa.array([2]), "source": pa.array(["a"]), "lang": pa.array(["b"])})
net = toxicity.initial(*toxicity.vocabulary([toxicity.Words(pa.array(["a b c d"] * 9, pa.large_string()))]))
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
jobs = {
    "mixing": lambda: list(mixing._counted(iter([batch]))),
    "quality": lambda: quality.Model(np.zeros(1 << quality.BITS, np.float32), 0.0).scores(pa.array([text], pa.large_string())),
    "toxicity": lambda: toxicity.scores(net, pa.array([text], pa.large_string())),
    "simhash": lambda: simhash.fingerprint(text),
    "words": lambda: shared.word_hashes(pa.chunked_array([pa.array([text])])),
    "fingerprint": lambda: fingerprint.Fingerprints([text]),
}
jobs[sys.argv[1]]()
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) >> 10)
"""
    for job in ("mixing", "quality", "toxicity", "simhash", "words", "fingerprint"):
        out = subprocess.run([sys.executable, "-c", say, job], capture_output=True, text=True, check=True).stdout
        print(job, out.strip())
        assert int(out) < 400, job


def test_settings_and_tables_are_left_alone(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, tables = spark.conf.get(key), {t.name for t in spark.catalog.listTables()}
    docs = cases.documents(spark)
    simhash.near_duplicates(docs), mixing.mixed(docs), fingerprint.fingerprinted(docs), toxicity.scored(docs, None), sharding.sharded(docs, 3), nearcopies.links(docs)
    queries.op2_exact_topk(spark, SF), topk.top_k(shared.table(spark, SF, "embeddings").limit(20), shared.F.col("vec_id") < 3)
    assert spark.conf.get(key) == before and {t.name for t in spark.catalog.listTables()} == tables


def test_columns_of_any_name_come_back(spark):
    rows = spark.createDataFrame([(1, "a b", "777", "x"), (None, None, "778", "y"), (1, "a b", "777", "x")], "doc_id long, text string, `id__` string, `a.b` string")
    rows = rows.withColumns({"__id": shared.F.lit(777), "__hash": shared.F.lit(5), "__n": shared.F.lit(6), "n__": shared.F.lit(9)})
    keys = rows.select("doc_id", shared.F.xxhash64("text").alias("text_hash"))
    assert sorted(map(str, shared.chosen_rows(rows, keys).collect())) == sorted(map(str, rows.collect()))
    assert sorted(map(str, shared.chosen_rows(rows, keys, once=True).collect())) == sorted({str(r) for r in rows.collect()})


def test_no_scratch_on_local_disks_of_a_cluster():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            get = staticmethod(lambda key, default=None: default)

    with pytest.raises(ValueError):
        shared.scratch_dir(Session())
    Context.master = "local-cluster[2,1,1024]"
    with pytest.raises(ValueError):
        shared.scratch_dir(Session())


def test_ranges_follow_bytes_and_split_hot_keys(spark):
    rng = random.Random(5)
    data = [(7 if i % 3 == 0 else i, rng.randrange(-(1 << 63), 1 << 63), "x" * (1000 if i > 500 else 10)) for i in range(600)]
    df = spark.createDataFrame(data, "key long, split long, text string")
    r = shared.ranges(df, 5000, 4)
    sizes = r.assigned(df).groupBy("range").agg(shared.F.sum(shared.F.octet_length("text") + 64).alias("b"), shared.F.min("key").alias("low"), shared.F.max("key").alias("high")).orderBy("range").collect()
    assert max(x["b"] for x in sizes) < 20_000 and len(r.order) > 10
    assert all(a["high"] < b["low"] or a["high"] == b["low"] == 7 for a, b in zip(sizes, sizes[1:]))
    assert len({r.order[x["range"]] for x in sizes if x["low"] == x["high"] == 7}) == 1 < sum(x["low"] == x["high"] == 7 for x in sizes)
    assert shared.ranges(df.limit(0), 5000, 4).assigned(df.limit(0)).count() == 0
