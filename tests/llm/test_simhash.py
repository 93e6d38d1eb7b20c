import random
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from quillon.llm import simhash
from tests.llm import cases


def brute_bits(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(bits, radius=2):
    parent = list(range(len(bits)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(bits)), 2):
        if (bits[i] ^ bits[j]).bit_count() <= radius:
            parent[root(i)] = root(j)
    return [root(i) for i in range(len(bits))]


def linked(spark, bits, radius=2):
    """The partition of fingerprints into components."""
    df = spark.createDataFrame([(simhash._signed(b),) for b in bits], "bits long").distinct()
    roots = {r["node"]: r["root"] for r in simhash.components(simhash.links(df, radius)).collect()}
    return [roots.get(simhash._signed(b), simhash._signed(b)) for b in bits]


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def test_documents_against_brute_force(spark):
    data = cases.rows() + [(200 + k, f"{cases.words(random.Random(5), 400)} extra{k}", "en", "a") for k in range(12)]
    docs = cases.documents(spark, data)
    got = simhash.near_duplicates(docs).collect()
    assert sorted((str(r["doc_id"]), r["bits"] & (1 << 64) - 1) for r in got) == sorted((str(r[0]), brute_bits(r[1])) for r in data)
    roots = brute_components([r["bits"] & (1 << 64) - 1 for r in got])
    for r, own in zip(got, roots):
        ids = [x["doc_id"] for x, o in zip(got, roots) if o == own and x["doc_id"] is not None]
        assert r["component_id"] == (min(ids) if ids else None)
    kept = simhash.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots)) and kept.exceptAll(docs).count() == 0
    assert simhash.near_duplicates(cases.empty(spark)).count() == simhash.deduplicated(cases.empty(spark)).count() == 0


def test_correlated_and_crowded_fingerprints(spark, monkeypatch):
    monkeypatch.setattr(simhash, "LIMIT", 16)  # keys are split again and again
    rng = random.Random(6)
    centres = [rng.getrandbits(64) & rng.getrandbits(64) for _ in range(40)]
    bits = [c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4))) for c in centres for _ in range(rng.randrange(1, 25))]
    bits += [0, 1, 3, 7, (1 << 64) - 1, 1 << 63]
    for radius in (1, 2, 3):
        assert same_partition(linked(spark, bits, radius), brute_components(bits, radius))


def test_thresholds_over_zero(spark, monkeypatch):
    rng = random.Random(7)
    bits = [c ^ sum(1 << b for b in rng.sample(range(64), k)) for c in (rng.getrandbits(64) for _ in range(60)) for k in (0, 1, 2, 2)]
    monkeypatch.setattr(simhash, "plan", lambda d, r: [((1 << 20) - 1, 0), (((1 << 64) - 1) ^ ((1 << 20) - 1), r - 1)])
    assert same_partition(linked(spark, bits), brute_components(bits))


def test_dynamic_programming_is_optimal():
    rng = np.random.default_rng(2)
    for _ in range(50):
        parts, radius = int(rng.integers(1, 5)), int(rng.integers(0, 4))
        cost = [np.sort(rng.random(radius + 1)).tolist() for _ in range(parts)]
        ts = simhash.thresholds(cost, radius)
        assert sum(t + 1 for t in ts) == radius + 1

        def total(ts):
            return sum(c[t] for c, t in zip(cost, ts) if t >= 0)

        import itertools

        assert np.isclose(total(ts), min(total(x) for x in itertools.product(range(-1, radius + 1), repeat=parts) if sum(t + 1 for t in x) == radius + 1))


def test_long_chains_meet(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(200)] + [(1000 + k, 1000) for k in range(1, 50)], "a long, b long")
    got = {r["node"]: r["root"] for r in simhash.components(edges).collect()}
    assert got == {**dict.fromkeys(range(201), 0), **dict.fromkeys(range(1000, 1050), 1000)}
    assert simhash.components(edges.where(F.lit(False))).count() == 0
