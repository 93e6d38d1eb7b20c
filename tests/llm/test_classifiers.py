import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from quillon.llm import quality, shared, toxicity
from tests.llm import cases
from tests.llm.test_shared import brute_hash

LABELS = "doc_id long, quality int, toxic int, text string"


def corpus(n=900, seed=2):
    """Clean prose; junk of repeated or shouted words; prose with one of a few rude stems, in changing forms."""
    rng = random.Random(seed)
    texts, good, toxic = [], [], []
    for _ in range(n):
        words = [f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('lnrst')}{rng.choice(['a', 'en', 'ing', 'or'])}" for _ in range(rng.randrange(20, 120))]
        kind = rng.random()
        good.append(int(kind > 0.3))
        toxic.append(int(kind > 0.7))
        if kind <= 0.3:
            words = [w.upper() + "!!" for w in words] if rng.random() < 0.5 else [words[0]] * len(words)
        if kind > 0.7:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["grubzak", "vilmox"]) + rng.choice(["", "en", "ar", "ist", "os"])
        texts.append(" ".join(words))
    return texts, np.array(good, float), np.array(toxic, float)


@pytest.mark.parametrize("which", ["quality", "toxicity"])
def test_held_out_accuracy(which):
    texts, good, toxic = corpus(2000)
    y = good if which == "quality" else toxic
    if which == "quality":
        got = quality.train(texts[:1600], y[:1600]).scores(pa.array(texts[1600:])) >= 0.5
    else:
        got = toxicity.scores(toxicity.train(texts[:1600], y[:1600]), pa.array(texts[1600:])) >= toxicity.REJECT
    assert (got == (y[1600:] > 0)).mean() > 0.95


def test_gradients_match_differences():
    texts, _, toxic = corpus(40)
    words = toxicity.Words(pa.array(texts))
    p = {k: v.astype(float) if v.dtype == np.float32 else v for k, v in toxicity.initial(*toxicity.vocabulary([words])).items()}
    pick = np.arange(len(words.windows))
    y, w = toxic[words.of_text], np.full(len(pick), 1 / len(pick))

    def loss(p):
        x = toxicity.logits(p, words).astype(float)
        return float((w * (np.logaddexp(0, x) - y * x)).sum())

    grad = toxicity.gradients(p, words, pick, y, w)
    rng = np.random.default_rng(0)
    for name in ("words", "chars", "w", "u", "b", "attend", "out", "bias"):
        at = np.unravel_index(np.argmax(np.abs(grad[name])) if name in ("words", "chars") else rng.integers(p[name].size), p[name].shape)
        moved = []
        for step in (1e-2, -1e-2):
            q = {k: v.copy() for k, v in p.items()}
            q[name][at] += step
            moved.append(loss(q))
        assert np.isclose((moved[0] - moved[1]) / 2e-2, grad[name][at], rtol=0.05, atol=2e-5), name


def test_batches_and_windows_do_not_matter():
    texts, _, toxic = corpus(300)
    p = toxicity.train(texts[:250], toxic[:250], warm=1, epochs=1)
    together = toxicity.scores(p, pa.array(texts[250:]))
    assert np.allclose(together, [toxicity.scores(p, pa.array([t]))[0] for t in texts[250:]], atol=1e-5)
    words = toxicity.Words(pa.array([texts[0], "", None, "one"]))
    n = len(texts[0].split())
    assert sorted(set(words.windows[words.of_text == 0].ravel().tolist())) == sorted(set(range(len(words.hashes) + 1)) & set(words.windows[words.of_text == 0].ravel().tolist()))
    covered = sum(words.of_text == 0) * toxicity.STRIDE + toxicity.WINDOW - toxicity.STRIDE
    assert covered >= n


@pytest.mark.parametrize("which", [quality.quality, toxicity.toxicity])
def test_edge_cases(spark, which):
    docs = cases.documents(spark)
    for labels in ([], [(1, 1, 1, "x"), (2, 0, 0, "x"), (None, 1, 1, "x"), (3, None, None, "x"), (1, 0, 0, "x")] + [(i, i % 2, i % 2, "x") for i in range(4, 50)]):
        got = which(docs, spark.createDataFrame(labels, LABELS)).collect()
        assert len(got) == len(cases.rows()) and all(0 <= r["score"] <= 1 for r in got)
        assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert which(cases.empty(spark), spark.createDataFrame([], LABELS)).count() == 0


def test_rows_are_carried_whole(spark):
    docs = cases.documents(spark)
    got = toxicity.scored(docs, None, carry=True).select("row.*")
    assert got.columns == docs.columns and got.exceptAll(docs).count() == docs.exceptAll(got).count() == 0


def test_labels_of_held_out_rows_are_not_read(spark):
    from quillon.llm import shared

    texts, good, _ = corpus(200)
    docs = cases.documents(spark, [(i, t, "en", "a") for i, t in enumerate(texts)])
    labels = spark.createDataFrame([(i, int(g), 0, "x") for i, g in enumerate(good)], LABELS)
    got, y = shared.labelled_sample(docs, labels, "quality", 1000, 10_000)
    assert set(got) == {t for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 3 != 1}
    assert all(good[texts.index(t)] == v for t, v in zip(got, y))


def brute_features(text):
    """Places of all features, word by word."""
    kinds = lambda b: "".join(chr(quality._CLASS[x]) for x in b)
    words = text.encode().split()
    raw = [brute_hash(w) for w in words]
    shape = []
    for w in words:
        k = kinds(w)
        shape.append(brute_hash("".join(c for i, c in enumerate(k) if i == 0 or c != k[i - 1]).encode()))
    pair = lambda a, b, salt: int(shared.pair(np.array([a], np.uint64), np.array([b], np.uint64), salt)[0])
    out = [pair(h, 0, 1) for h in raw] + [pair(h, 0, 2) for h in shape]
    out += [pair(a, b, 5) for a, b in zip(raw, raw[1:])] + [pair(a, b, 6) for a, b in zip(shape, shape[1:])]
    out += [pair(pair(a, b, 7), c, 7) for a, b, c in zip(shape, shape[1:], shape[2:])]
    for back, salt in ((1, 3), (2, 4)):
        out += [salt * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for a, b in zip(raw, raw[back:]) if a == b]
    return [h >> 64 - quality.BITS for h in out], len(words)


def test_quality_against_dictionaries():
    """Follow-the-regularised-leader over dictionaries, one coordinate at a time, and scores as sums over features."""
    texts, good, _ = corpus(30)
    texts = [" ".join(t.split()[:30]) for t in texts] + ["a  a\tb A b\n a B1!? b1!?", ""]
    y = np.append(good, [1.0, 0.0])
    alpha, beta, l1, l2 = 0.5, 1.0, 1e-4, 1e-3
    z, n = {}, {}

    def weight(k):
        zk = z.get(k, 0.0)
        return 0.0 if abs(zk) <= l1 else ((l1 if zk > 0 else -l1) - zk) / ((beta + n.get(k, 0.0) ** 0.5) / alpha + l2)

    docs = []
    for t in texts:
        places, words = brute_features(t)
        x = {}
        for k in places:
            x[k] = x.get(k, 0) + 1 / max(words, 1)
        docs.append(x | {"bias": 1.0})
    balance = [len(y) / (2 * y.sum()) if v else len(y) / (2 * (len(y) - y.sum())) for v in y]
    rng = np.random.Generator(np.random.PCG64(11))
    for _ in range(2):
        for i in rng.permutation(len(docs)):
            w = {k: weight(k) for k in docs[i]}
            p = 1 / (1 + math.exp(-sum(w[k] * v for k, v in docs[i].items())))
            for k, v in docs[i].items():
                g = (p - y[i]) * balance[i] * v
                z[k] = z.get(k, 0.0) + g - ((n.get(k, 0.0) + g * g) ** 0.5 - n.get(k, 0.0) ** 0.5) / alpha * w[k]
                n[k] = n.get(k, 0.0) + g * g
    want = [1 / (1 + math.exp(-sum(weight(k) * v for k, v in x.items()))) for x in docs]
    assert np.allclose(quality.train(texts, y, epochs=2).scores(pa.array(texts)), want, atol=1e-5)


def brute_toxicity(p, text):
    """The worst window, a word and a unit at a time."""
    lower = "".join(chr(b) for b in toxicity._LOWER[np.frombuffer(text.encode(), np.uint8)])
    words = [w.encode("latin-1") for w in lower.split(" ") if w]
    known = {int(h): i for i, h in enumerate(p["known"]) if i}
    vectors = []
    for w in words:
        framed, grams = b" " + w + b" ", []
        for g in toxicity.GRAMS:
            for k in range(max(len(framed) - g + 1, 1)):
                grams.append(p["chars"][p["gram_row"][brute_hash(framed[k : k + g]) >> 64 - toxicity.GRAM_BITS]])
        vectors.append(np.concatenate([p["words"][known.get(brute_hash(w), 0)], np.mean(grams, axis=0)]).astype(float))
    h, sigmoid = toxicity.HIDDEN, lambda v: 1 / (1 + np.exp(-v))
    worst = 0.0
    for k in range(0, max(len(words) - (toxicity.WINDOW - toxicity.STRIDE), 1 if words else 0), toxicity.STRIDE):
        window = vectors[k : k + toxicity.WINDOW]
        attend, value = np.zeros(len(window)), np.zeros(len(window))
        for d, order in enumerate((range(len(window)), reversed(range(len(window))))):
            state = np.zeros(h)
            for t in order:
                g, hu = window[t] @ p["w"][d] + p["b"][d], state @ p["u"][d]
                z, r = sigmoid(g[:h] + hu[:h]), sigmoid(g[h : 2 * h] + hu[h : 2 * h])
                state = (1 - z) * np.tanh(g[2 * h :] + r * hu[2 * h :]) + z * state
                attend[t] += state @ p["attend"][d]
                value[t] += state @ p["out"][d]
        weights = np.exp(attend - attend.max())
        worst = max(worst, sigmoid((weights * value).sum() / weights.sum() + p["bias"][0]))
    return worst


def test_toxicity_against_loops():
    texts, _, toxic = corpus(60)
    p = toxicity.train(texts, toxic, warm=1, epochs=1)
    some = [*texts[:6], "", "One", "naïve ÉTÉ, x-y 12 grubzaken!", " ".join(texts[:3]), "?! ..."]
    assert np.allclose(toxicity.scores(p, pa.array(some)), [brute_toxicity(p, t) for t in some], atol=1e-4)
