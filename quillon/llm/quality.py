"""Quality classifier: logistic regression over hashed word n-grams, trained with follow-the-regularised-leader.

Features of a text are hashed into ``2 ** BITS`` places: its words and pairs of words, the shapes of words (runs of upper
case, lower case, digits, and each mark) alone, in pairs and in triples, and whether a word repeats the one or two before it. A
feature's value is its count over the number of words. Training takes per-coordinate FTRL-proximal steps, document by
document, on a bounded sample of labelled rows (``max_rows``, none longer than ``max_chars``). A score is the logistic
function of a sparse dot product, computed for all texts of an Arrow batch at once. Every text is scored whole.

Nulls: a null text is empty; an empty text scores by the bias alone. With no labelled rows of both classes all score 0.5.
Repeated rows score alike. An empty table gives an empty result; other columns (labels, lang, source) are never inputs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import shared

BITS = 18
#: Bounds of the training sample.
MAX_ROWS, MAX_CHARS = 4000, 20_000
#: Bytes beyond which a text is scored in slices of words.
LONG = 4 << 20
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[48:58] = 48
_CLASS[65:91] = 65
_CLASS[97:123] = 97
_CLASS[128:] = 97
_CLASS[shared.SPACE] = 32


def features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place) of every feature occurrence, and the number of words of each text."""
    data, starts, ends = shared.joined(texts)
    a, e = shared.word_spans(data)
    text = np.searchsorted(starts, a, side="right") - 1
    words = np.bincount(text, minlength=len(starts))
    raw = shared.span_hash(data, a, e)
    kind = _CLASS[data]
    kind = kind[np.concatenate([[True], kind[1:] != kind[:-1]])]
    shape = shared.span_hash(kind, *shared.word_spans(kind))
    out: list[tuple[np.ndarray, np.ndarray]] = [(text, shared.pair(raw, np.uint64(0), 1)), (text, shared.pair(shape, np.uint64(0), 2))]
    for back, salt in ((1, 3), (2, 4)):
        same = text[back:] == text[:-back]
        at = text[back:][same]
        if back == 1:
            out.append((at, shared.pair(raw[:-1], raw[1:], 5)[same]))
            out.append((at, shared.pair(shape[:-1], shape[1:], 6)[same]))
        else:
            out.append((at, shared.pair(shared.pair(shape[:-2], shape[1:-1], 7), shape[2:], 7)[same]))
        repeats = (raw[back:] == raw[:-back])[same]
        out.append((at[repeats], np.full(int(repeats.sum()), salt, np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return np.concatenate([t for t, _ in out]), (np.concatenate([f for _, f in out]) >> np.uint64(64 - BITS)).astype(np.int64), words


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        if len(texts) == 1 and texts[0].is_valid and len(raw := texts[0].as_buffer()) > LONG:
            total, words = self._long(np.frombuffer(raw, np.uint8))
        else:
            total, words = self._sums(texts)
        return 1 / (1 + np.exp(-np.clip(total / np.maximum(words, 1) + self.bias, -35, 35)))

    def _sums(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        text, place, words = features(texts)
        return np.bincount(text, self.weights[place], len(words)), words

    def _long(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of one long text, slice by slice; a feature belongs to the slice that it ends in."""
        total, words = np.zeros(1), np.zeros(1, np.int64)
        for own, before in shared.word_slices(text, shared.SPACE, LONG // 8, before=2):
            (a, b), (n, m) = zip(*(self._sums(pa.array([x], pa.large_binary()).cast(pa.large_string())) for x in (own, before)), strict=True)
            total, words = total + a - b, words + n - m
        return total, words


def train(texts: list[str], y: np.ndarray, epochs: int = 4, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-4, l2: float = 1e-3) -> Model:
    """FTRL-proximal over the documents in a fixed shuffled order; classes weigh the same in all."""
    size = 1 << BITS
    if len(set(y.tolist())) < 2:
        return Model(np.zeros(size, np.float32), 0.0)
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    docs = []
    for k in range(0, len(texts), 256):
        text, place, words = features(pa.array(texts[k : k + 256], pa.large_string()))
        order = np.argsort(text, kind="stable")
        for i, own in enumerate(np.split(place[order], np.searchsorted(text[order], np.arange(1, len(words))))):
            at, count = np.unique(own, return_counts=True)
            docs.append((np.append(at, size), np.append(count / max(int(words[i]), 1), 1.0)))
    weight = np.where(y > 0, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    rng = np.random.Generator(np.random.PCG64(11))
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            at, x = docs[i]
            zi, ni = z[at], n[at]
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - y[i]) * weight[i] * x
            z[at] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            n[at] = ni + g * g
    w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))
    return Model(w[:-1].astype(np.float32), float(w[-1]))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score for each row."""
    weights = docs.sparkSession.sparkContext.broadcast(model)  # 2 ** BITS weights

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in shared.regrouped(batches, "text"):
            one = chunk.combine_chunks().to_batches()[0]
            yield pa.RecordBatch.from_arrays([one.column("doc_id"), one.column("held_out"), pa.array(weights.value.scores(one.column("text")))], names=["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(shared.id_hash("doc_id") % 3 == 1, F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double")


def quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS) -> DataFrame:
    """Train on the labelled rows that may be learnt from, and score all documents."""
    model = train(*shared.labelled_sample(docs, labels, "quality", max_rows, max_chars))
    shared.trim()
    return scored(docs, model)
