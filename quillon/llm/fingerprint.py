"""Document fingerprints by content-defined chunking.

A gear hash runs over the UTF-8 bytes, h = (h << 4) + gear[byte] in 32 bits, so that it sees the last eight bytes. A chunk
ends where its top bits are zero: seven of them while the chunk is shorter than ``NORMAL`` bytes, three from there on
(normalised chunking), never before ``LEAST`` bytes and at ``MOST`` bytes in any case. Boundaries depend on nearby bytes
only, so text that is shifted keeps its chunks. A fingerprint is the set of its chunks' digests, 40 bits each, with
their lengths: sorted, twelve hex digits a chunk. The likeness of one fingerprint to another is the share of its bytes whose
chunks the other has too (containment weighted by length); that of two empty ones is 1, of an empty and another 0.

All texts of an Arrow batch are hashed and cut together in numpy. To meet its next document, a row is dealt out by ranges of
doc_id of about equally many bytes (an id with more than that has several, by the first bytes of its texts); the first document of
each range also goes to the range before.

Nulls: a null text is empty; null ids come first. Ties of doc_id are ordered by text, and repeated rows are neighbours. A
single document is its own next one. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import shared

LEAST, NORMAL, MOST = 8, 32, 128
HARD, EASY = np.uint32(0xFE000000), np.uint32(0xE0000000)
GEAR = np.random.Generator(np.random.PCG64(1987)).integers(0, 1 << 32, 256, dtype=np.uint32)
DIGEST_BITS = 40
#: Bytes of text in a range at most, on average.
RANGE_BYTES = 64 << 20


def gear_hash(data: np.ndarray) -> np.ndarray:
    """The hash after each byte, by doubling: that of 2n bytes from two of n."""
    h = GEAR[data]
    for n in (1, 2, 4):
        h[n:] = h[n:] + (h[:-n] << np.uint32(4 * n))
    return h


def chunks(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, end) of all chunks; the texts advance together, a chunk of each at a time."""
    cuts: list[list[np.ndarray]] = [[], []]
    for k in range(0, len(data), shared.SEGMENT):
        lead = min(k, 7)
        h = gear_hash(data[k - lead : k + shared.SEGMENT])[lead:]
        for found, m in zip(cuts, (HARD, EASY), strict=True):
            found.append(np.flatnonzero((h & m) == 0) + (k + 1))
    hard, easy = (np.concatenate([*found, [len(data) + MOST]]) for found in cuts)
    at = starts.copy()
    live = np.flatnonzero(at < ends)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while len(live):
        a = at[live]
        cut = hard[np.searchsorted(hard, a + LEAST)]
        late = easy[np.searchsorted(easy, a + NORMAL)]
        cut = np.minimum(np.where(cut < a + NORMAL, cut, np.minimum(late, a + MOST)), ends[live])
        out.append((live, a, cut))
        at[live] = cut
        live = live[cut < ends[live]]
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


class Fingerprints:
    """Those of many texts: codes (digest and length), sorted by text and code, each once."""

    def __init__(self, texts: list[str]):
        data, starts, ends = shared.joined(pa.array(texts, pa.large_string()))
        text, a, e = chunks(data, starts, ends)
        digest = shared.span_hash(data, a, e) >> np.uint64(64 - DIGEST_BITS)
        code = (digest << np.uint64(8)) | (e - a).astype(np.uint64)
        order = np.lexsort((code, text))
        text, code = text[order], code[order]
        new = np.ones(len(text), bool)
        new[1:] = (text[1:] != text[:-1]) | (code[1:] != code[:-1])
        self.text, self.code = text[new], code[new]
        self.at = np.searchsorted(self.text, np.arange(len(texts) + 1))
        self.bytes = np.bincount(self.text, self.code & np.uint64(255), len(texts))

    def strings(self) -> list[str]:
        hexed = self.code.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 2:].tobytes().hex()
        cuts = (self.at * 12).tolist()
        return [hexed[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def likeness(self, n: int, other: Fingerprints, shift: int = 0) -> np.ndarray:
        """Of each of the first n texts to the text of other that stands shift places on."""
        key = self.text.astype(np.uint64) << np.uint64(48) | self.code
        held = (other.text - shift).astype(np.uint64) << np.uint64(48) | other.code
        both = np.bincount(self.text, (self.code & np.uint64(255)) * np.isin(key, held[other.text >= shift]), len(self.bytes))[:n]
        own, others = self.bytes[:n], other.bytes[shift : shift + n]
        return np.where(own > 0, both / np.maximum(own, 1), (others == 0).astype(float))


def edited(text: str, following: str) -> str:
    """The last half of the code points (rounded down) replaced by as many first ones, or all, of the following text."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: tuple | None = None  # the last row of the batch before
    for chunk in shared.regrouped(batches, "text", 1 << 20):
        rows = list(zip(*(chunk.column(c).to_pylist() for c in ("range", "guest", "doc_id", "text")), strict=True))
        if held:
            rows.insert(0, held)
        held = rows[-1]
        for k in range(0, len(rows) - 1, 1 << 14):
            part = rows[k : k + (1 << 14) + 1]
            texts = [r[3] or "" for r in part]
            last = len(part) - 1
            edits = [edited(a, b) for a, b in zip(texts, texts[1:], strict=False)]
            own, changed = Fingerprints(texts), Fingerprints(edits)
            prints = own.strings()
            keep = [i for i in range(last) if not part[i][1] and part[i][0] == part[i + 1][0]]
            columns = (
                [part[i][2] for i in keep],
                [len(texts[i]) for i in keep],
                [hashlib.sha256(edits[i].encode()).hexdigest() for i in keep],
                [prints[i] for i in keep],
                *([x[i] for i in keep] for x in (changed.strings(), own.likeness(last, changed).tolist(), own.likeness(last, own, 1).tolist())),
            )
            types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=SCHEMA.replace(",", "").split(" ")[::2])


def fingerprinted(docs: DataFrame, target: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of each document and of its edit with the next document, and their likeness. target: bytes in a range at most."""
    n = shared.partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("key", F.coalesce("doc_id", F.lit(shared.NO_ID)))
    # The first bytes of a text, as a number in the order of texts, cut an id that many rows have.
    docs = docs.withColumn("split", F.conv(F.rpad(F.hex(F.substring(F.coalesce("text", F.lit("")).cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("long"))
    docs = shared.ranges(docs, target, 4 * n).assigned(docs).withColumn("guest", F.lit(False))
    columns = ["range", "guest", "key", "doc_id", "text"]
    least = sorted((r["range"], r["key"]) for r in docs.groupBy("range").agg(F.min("key").alias("key")).collect())  # one row for each
    if least:
        size = least[-1][0] + 1
        key, before = [0] * size, [0] * size
        for (r, k), (b, _) in zip(least, [least[-1], *least], strict=False):  # after the last document comes the first
            key[r], before[r] = k, b
        mine = docs.where(F.col("key") == shared.at(key, "range")).withColumn("held", F.col("text").isNotNull())
        guests = mine.groupBy("range", "key", "doc_id").agg(F.min(F.struct("held", "text")).alias("first")).select(shared.at(before, "range").cast("int").alias("range"), F.lit(True).alias("guest"), "key", "doc_id", "first.text")
        docs = docs.select(*columns).unionByName(guests)
    return docs.select(*columns).repartition(n, "range").sortWithinPartitions("range", "guest", "key", "text").select("range", "guest", "doc_id", "text").mapInArrow(_pairs, SCHEMA)
