"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A text's words (letters and digits, ASCII in lower case) are cut into windows of ``WINDOW`` words that overlap by
``WINDOW - STRIDE``; all windows of the whole text are scored and the text has the score of its worst. A word enters as its
word embedding and, beside it, the mean embedding of its byte n-grams, which include its edges, so that unseen forms of
known stems are met. Words and n-grams of fewer than ``KNOWN`` training texts have no embedding of their own (zeros). Two
GRUs read the window in both directions; attention weighs their states.

Training: labels are of texts, not of windows. The network first learns from random windows of each text, then from the
worst-scored window of each text, chosen anew in each epoch. It takes a bounded sample of labelled rows (``max_rows``, none
longer than ``max_chars``).

Scoring: input projections are computed once for each distinct word of an Arrow batch, and all windows of the batch advance
together, a word of each at a time.

Nulls: a null text is empty; a text without words scores 0. With no labelled rows of both classes all texts score 0.
Repeated rows score alike. An empty table gives an empty result; other columns (labels, lang, source) are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import shared

WINDOW, STRIDE = 24, 16
WORD_DIM, CHAR_DIM, HIDDEN = 8, 8, 8
GRAMS, GRAM_BITS = (4, 6), 20
#: Training texts that a word or n-gram must be in to be known.
KNOWN = 5
#: Texts with this score or more are rejected.
REJECT = 0.7
#: Bounds of the training sample.
MAX_ROWS, MAX_CHARS = 4000, 20_000
#: Bytes beyond which a text is scored in slices of words.
LONG = 4 << 20
_LOWER = np.full(256, 32, np.uint8)
_LOWER[48:58] = np.arange(48, 58)
_LOWER[97:123] = np.arange(97, 123)
_LOWER[65:91] = np.arange(97, 123)
_LOWER[128:] = np.arange(128, 256)
_GAP = np.arange(256) == 32


class Words:
    """Distinct words of some texts with their hashes, and the windows of the texts."""

    def __init__(self, texts: pa.Array):
        data, starts, _ = shared.joined(texts)
        data = _LOWER[data]
        a, e = shared.word_spans(data, _GAP)
        text = np.searchsorted(starts, a, side="right") - 1
        self.text = text
        self.hashes, first, self.word = np.unique(shared.span_hash(data, a, e), return_index=True, return_inverse=True)
        self.gram_place, self.gram_word = self._grams(np.concatenate([[np.uint8(32)], data]), a[first], e[first] + 2)
        n = np.bincount(text, minlength=len(starts))
        begin = np.cumsum(n) - n
        windows = np.where(n > 0, -(-np.maximum(n - (WINDOW - STRIDE), 1) // STRIDE), 0)
        self.of_text = np.repeat(np.arange(len(starts)), windows)
        k = np.arange(len(self.of_text)) - np.repeat(np.cumsum(windows) - windows, windows)
        at = (begin[self.of_text] + k * STRIDE)[:, None] + np.arange(WINDOW)
        inside = at < (begin + n)[self.of_text][:, None]
        pad = len(self.hashes)
        self.windows = np.where(inside, self.word[np.minimum(at, max(len(self.word) - 1, 0))] if len(self.word) else pad, pad)

    @staticmethod
    def _grams(data: np.ndarray, a: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hashed n-grams of the words with a space on each side, in the order of words."""
        places, words = [], []
        for g in GRAMS:
            n = np.maximum(e - a - g + 1, 1)
            word = np.repeat(np.arange(len(a)), n)
            start = np.repeat(a - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
            places.append((shared.span_hash(data, start, np.minimum(start + g, e[word])) >> np.uint64(64 - GRAM_BITS)).astype(np.int64))
            words.append(word)
        place, word = np.concatenate(places), np.concatenate(words)
        order = np.argsort(word, kind="stable")
        return place[order], word[order]

    def rows(self, p: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the embedding tables for the distinct words and for the n-grams; row 0: not known."""
        at = np.minimum(np.searchsorted(p["known"], self.hashes), len(p["known"]) - 1)
        return np.where(p["known"][at] == self.hashes, at, 0), p["gram_row"][self.gram_place]

    def inputs(self, p: dict[str, np.ndarray]) -> np.ndarray:
        """Input vectors of the distinct words."""
        if not len(self.hashes):
            return np.zeros((0, WORD_DIM + CHAR_DIM), np.float32)
        word, gram = self.rows(p)
        at = np.searchsorted(self.gram_word, np.arange(len(self.hashes)))
        grams = np.add.reduceat(p["chars"][gram], at, axis=0) / np.bincount(self.gram_word)[:, None]
        return np.concatenate([p["words"][word], grams], axis=1).astype(np.float32)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def vocabulary(groups: list[Words]) -> tuple[np.ndarray, np.ndarray]:
    """The sorted hashes of known words (the first stands for none), and the row of each place of n-grams."""
    words = np.concatenate([g.hashes[np.unique(np.stack([g.text, g.word]), axis=1)[1]] for g in groups if len(g.word)] or [np.zeros(0, np.uint64)])
    found, n = np.unique(words, return_counts=True)
    known = np.concatenate([np.zeros(1, np.uint64), found[(n >= KNOWN) & (found > 0)]])
    texts = np.zeros(1 << GRAM_BITS, np.int64)
    for g in groups:
        if len(g.word):
            pairs = np.unique(np.stack([g.text, g.word]), axis=1)
            first, count = np.searchsorted(g.gram_word, pairs[1]), np.bincount(g.gram_word)[pairs[1]]
            at = np.repeat(first - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
            own = np.unique(np.repeat(pairs[0], count).astype(np.int64) << GRAM_BITS | g.gram_place[at])
            texts += np.bincount(own & ((1 << GRAM_BITS) - 1), minlength=1 << GRAM_BITS)
    row = np.zeros(1 << GRAM_BITS, np.int32)
    often = np.flatnonzero(texts >= KNOWN)
    row[often] = np.arange(1, len(often) + 1)
    return known, row


def initial(known: np.ndarray, gram_row: np.ndarray, seed: int = 5) -> dict[str, np.ndarray]:
    rng = np.random.Generator(np.random.PCG64(seed))
    d, h = WORD_DIM + CHAR_DIM, HIDDEN

    def normal(*shape: int, scale: float) -> np.ndarray:
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    p = {
        "words": normal(len(known), WORD_DIM, scale=0.1), "chars": normal(int(gram_row.max()) + 1, CHAR_DIM, scale=0.3),
        "w": normal(2, d, 3 * h, scale=d**-0.5), "u": normal(2, h, 3 * h, scale=h**-0.5), "b": np.zeros((2, 3 * h), np.float32),
        "attend": normal(2, h, scale=0.3), "out": normal(2, h, scale=0.3), "bias": np.zeros(1, np.float32),
    }
    p["words"][0] = p["chars"][0] = 0
    return p | {"known": known, "gram_row": gram_row}


def _pool(attend: np.ndarray, value: np.ndarray, pad: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    a = np.where(pad, -1e9, attend)
    a = np.exp(a - a.max(axis=1, keepdims=True))
    a /= a.sum(axis=1, keepdims=True)
    return (a * value).sum(axis=1), a


def logits(p: dict[str, np.ndarray], words: Words, limit: int = 8192) -> np.ndarray:
    """Of all windows."""
    h = HIDDEN
    x = words.inputs(p)
    rows = []
    for d in range(2):
        proj = np.concatenate([x @ p["w"][d] + p["b"][d], np.zeros((1, 3 * h), np.float32)])
        proj[-1, :h] = 60  # padding leaves the state as it is
        rows.append(proj)
    out = []
    for k in range(0, len(words.windows), limit):
        win = np.ascontiguousarray(words.windows[k : k + limit].T)
        attend, value = np.zeros((2, WINDOW, win.shape[1]), np.float32)
        for d in range(2):
            state = np.zeros((win.shape[1], h), np.float32)
            heads = np.stack([p["attend"][d], p["out"][d]], axis=1)
            for t in range(WINDOW) if d == 0 else range(WINDOW - 1, -1, -1):
                g = rows[d][win[t]]
                hu = state @ p["u"][d]
                gates = _sigmoid(g[:, : 2 * h] + hu[:, : 2 * h])
                new = np.tanh(g[:, 2 * h :] + gates[:, h:] * hu[:, 2 * h :])
                state = new + gates[:, :h] * (state - new)
                both = state @ heads
                attend[t] += both[:, 0]
                value[t] += both[:, 1]
        out.append(_pool(attend.T, value.T, win.T == len(x))[0] + p["bias"][0])
    return np.concatenate(out) if out else np.zeros(0, np.float32)


def gradients(p: dict[str, np.ndarray], words: Words, chosen: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Of the weighted log loss over the chosen windows."""
    h, win = HIDDEN, words.windows[chosen]
    x_all = np.concatenate([words.inputs(p), np.zeros((1, WORD_DIM + CHAR_DIM), np.float32)])
    x, pad = x_all[win], win == len(x_all) - 1
    n = len(win)
    attend, value = np.zeros((2, n, WINDOW), np.float32)
    kept: list[list[tuple]] = [[], []]
    order = [range(WINDOW), range(WINDOW - 1, -1, -1)]
    for d in range(2):
        g = x @ p["w"][d] + p["b"][d]
        g[..., :h] += 60 * pad[..., None]
        state = np.zeros((n, h), np.float32)
        for t in order[d]:
            hu = state @ p["u"][d]
            gates = _sigmoid(g[:, t, : 2 * h] + hu[:, : 2 * h])
            z, r = gates[:, :h], gates[:, h:]
            new = np.tanh(g[:, t, 2 * h :] + r * hu[:, 2 * h :])
            kept[d].append((t, state, z, r, new, hu[:, 2 * h :]))
            state = new + z * (state - new)
            attend[:, t] += state @ p["attend"][d]
            value[:, t] += state @ p["out"][d]
    pooled, a = _pool(attend, value, pad)
    dlogit = (_sigmoid(pooled + p["bias"][0]) - y) * weight
    dvalue = dlogit[:, None] * a
    dattend = dvalue * (value - pooled[:, None])
    out = {k: np.zeros_like(v) for k, v in p.items() if k not in ("known", "gram_row")}
    out["bias"][0] = dlogit.sum()
    dx = np.zeros_like(x)
    for d in range(2):
        dstate = np.zeros((n, h), np.float32)
        for t, before, z, r, new, hun in reversed(kept[d]):
            state = new + z * (before - new)
            out["attend"][d] += dattend[:, t] @ state
            out["out"][d] += dvalue[:, t] @ state
            dstate = dstate + dattend[:, t, None] * p["attend"][d] + dvalue[:, t, None] * p["out"][d]
            dn = dstate * (1 - z) * (1 - new * new)
            dz = dstate * (before - new) * z * (1 - z)
            dr = dn * hun * r * (1 - r)
            dg = np.concatenate([dz, dr, dn], axis=1)
            dhu = np.concatenate([dz, dr, dn * r], axis=1)
            out["u"][d] += before.T @ dhu
            out["b"][d] += dg.sum(axis=0)
            out["w"][d] += x[:, t].T @ dg
            dx[:, t] += dg @ p["w"][d].T
            dstate = dstate * z + dhu @ p["u"][d].T
    of_word = np.zeros_like(x_all)
    np.add.at(of_word, win.ravel(), dx.reshape(-1, dx.shape[-1]))
    used = np.unique(win[~pad])
    word, gram = words.rows(p)
    np.add.at(out["words"], word[used], of_word[used, :WORD_DIM])
    grams = np.bincount(words.gram_word, minlength=len(words.hashes))
    mine = np.isin(words.gram_word, used)
    w = words.gram_word[mine]
    np.add.at(out["chars"], gram[mine], of_word[w, WORD_DIM:] / grams[w][:, None])
    out["words"][0] = out["chars"][0] = 0
    return out


def train(texts: list[str], y: np.ndarray, warm: int = 4, epochs: int = 6, batch: int = 128, rate: float = 0.01) -> dict[str, np.ndarray] | None:
    """Adam over windows: random ones for warm epochs, then the worst of each text. None without both classes."""
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.Generator(np.random.PCG64(3))
    order = rng.permutation(len(texts))
    groups = [order[k : k + batch] for k in range(0, len(texts), batch)]
    words = [Words(pa.array([texts[i] for i in g], pa.large_string())) for g in groups]
    p = initial(*vocabulary(words))
    first, second = ({k: np.zeros_like(v) for k, v in p.items()} for _ in range(2))
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum()))).astype(np.float32)
    small = max(1, -(-24 // len(groups)))  # a small sample is gone through more often
    step = 0
    for epoch in range((warm + epochs) * small):
        for k in rng.permutation(len(groups)):
            own, g = words[k], groups[k]
            if not len(own.windows):
                continue
            if epoch < warm * small:
                pick = np.unique(rng.integers(0, len(own.windows), 3 * len(g)))
            else:
                rank = np.lexsort((-logits(p, own), own.of_text))
                pick = rank[np.concatenate([[True], np.diff(own.of_text[rank]) > 0])]
            t = own.of_text[pick]
            grad = gradients(p, own, pick, y[g[t]].astype(np.float32), weight[g[t]] / len(pick))
            step += 1
            for name, d in grad.items():
                d = d + 1e-5 * p[name]
                first[name] += 0.1 * (d - first[name])
                second[name] += 0.01 * (d * d - second[name])
                p[name] -= rate * (first[name] / (1 - 0.9**step)) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)
    return p


def _worst(p: dict[str, np.ndarray], texts: pa.Array) -> np.ndarray:
    out, words = np.zeros(len(texts)), Words(texts)
    if len(words.windows):
        np.maximum.at(out, words.of_text, _sigmoid(logits(p, words).astype(float)))
    return out


def scores(p: dict[str, np.ndarray] | None, texts: pa.Array) -> np.ndarray:
    """The worst window of each text."""
    if p is None or not len(texts):
        return np.zeros(len(texts))
    if len(texts) > 1 or not texts[0].is_valid or len(raw := texts[0].as_buffer()) <= LONG:
        return _worst(p, texts)
    out, step = np.zeros(1), LONG // 8 // STRIDE * STRIDE
    for k, (own, _) in enumerate(shared.word_slices(_LOWER[np.frombuffer(raw, np.uint8)], _GAP, step, after=WINDOW - STRIDE)):
        if k == 0 or len(own.split()) > WINDOW - STRIDE:  # else all its words are in windows of the slice before
            out = np.maximum(out, _worst(p, pa.array([own], pa.large_binary()).cast(pa.large_string())))
    return out


def scored(docs: DataFrame, p: dict[str, np.ndarray] | None, carry: bool = False) -> DataFrame:
    """doc_id, held_out and score of each row; with carry also row, a struct of all columns of docs."""
    shipped = docs.sparkSession.sparkContext.broadcast(p)  # bounded by the training sample
    names = ["doc_id", "held_out", *["row"] * carry]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in shared.regrouped(batches, "text", 1 << 20):
            one = chunk.combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([*(one.column(c) for c in names), pa.array(scores(shipped.value, one.column("text")))], names=[*names, "score"])

    held_out = F.coalesce(shared.id_hash("doc_id") % 3 == 1, F.lit(False)).alias("held_out")
    row = F.struct(*(F.col(shared.quoted(c)) for c in docs.columns)).alias("row")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out, *[row] * carry, F.col("text").cast("string").alias("text"))
    schema = T.StructType([*(f for f in rows.schema if f.name in names), T.StructField("score", T.DoubleType())])
    return rows.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, carry: bool = False) -> DataFrame:
    """Train on the labelled rows that may be learnt from, and score all documents: doc_id, held_out, (row,) score."""
    model = train(*shared.labelled_sample(docs, labels, "toxic", max_rows, max_chars))
    shared.trim()
    return scored(docs, model, carry)
