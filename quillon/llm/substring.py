"""Substring dedup: word windows that also start in a document with a smaller id are removed, found level by level.

A window of ``window`` words (13) can only repeat if its halves do. So the first level looks at all windows of a short
length, and each next one only at windows of twice that length (clipped to ``window``) whose two halves, which overlap where it
is clipped, both repeat: 7 and 13 words, or 7, 13, 25 and 50. A level is one exchange of hashes, cheap while it only
filters (a few bytes each, false alarms allowed) and wide (96 bits) in the last. A range without candidates sends nothing.

Documents are first dealt into ranges of doc_id, of about equally many bytes (an id with more than that has several), and written
to a table bucketed by range, so that the levels need not move texts again. In a level, each range sends each of its distinct
hashes once, packed by hash part; a part answers each range with one bit for each hash: seen in another range (filters), or in
a range of smaller ids (last level). Within a range, documents are compared directly. So what a hash costs does not depend on how
many rows share it. Where a level leaves no candidates, the levels after it are not run. A message holds ``MESSAGE`` hashes or
more on average as long as a part then stays within ``PART`` hashes, so that their number grows with the text, not with the square of
the partitions. Words are removed by the equality of 96-bit hashes; the words themselves are not compared.

Words are maximal runs of bytes other than 0x20 and 0x09 to 0x0D. Windows are judged on the input. Nulls: a null text has no
words; null ids count as smaller than all others. Documents of equal id don't remove from each other. Texts without a
repeated window stay as they are; others are joined by single spaces. Repeated rows stay, an empty table gives an empty
result, and further columns come back unchanged, whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm import shared

#: Bytes of text in a range, hashes in a message at least, and hashes in a part at most (all on average).
RANGE_BYTES, MESSAGE, PART = 8 << 20, 1024, 1 << 22
#: The first level's windows have at least this many words, and at most twice as many.
SEED = 6
MAX_BITS = 60


# --- packing of sorted numbers --------------------------------------------------------------


def packed(values: np.ndarray, mean_gap: float) -> bytes:
    """Strictly rising numbers as differences of 2, 3 or 4 bytes; the largest number of that width means: go on without an entry."""
    width = next(w for w in (2, 3, 4) if w == 4 or mean_gap < (1 << 8 * w) / 8)
    top = np.uint64((1 << 8 * width) - 1)
    gap = np.diff(values, prepend=values[:1] * np.uint64(0))
    skips = (gap // top).astype(np.int64)
    out = np.full(int(skips.sum()) + len(values), top, np.uint64)
    out[np.cumsum(skips + 1) - 1] = gap % top
    return bytes([width]) + out.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :width].tobytes()


def unpacked(blob: bytes) -> np.ndarray:
    width = blob[0]
    raw = np.frombuffer(blob, np.uint8, offset=1).reshape(-1, width)
    wide = np.zeros((len(raw), 4), np.uint8)
    wide[:, :width] = raw
    step = wide.view("<u4").ravel().astype(np.uint64)
    return np.cumsum(step)[step != (1 << 8 * width) - 1]


# --- one range of documents -----------------------------------------------------------------


def levels(window: int) -> list[int]:
    """Lengths from the first level to the window, each at most twice the one before."""
    out = [window]
    while out[0] > 2 * SEED:
        out.insert(0, (out[0] + 1) // 2)
    return out


class Range:
    """The documents of a range in the order of ids, and the hashes of their windows at each level."""

    def __init__(self, docs: pa.Table, lengths: list[int]):
        self.docs = docs.sort_by([("key", "ascending"), ("text", "ascending")])
        key = self.docs.column("key").to_numpy()
        self.rank = np.cumsum(np.diff(key, prepend=key[:1]) != 0)
        h, self.words = shared.word_hashes(self.docs.column("text"))
        self.doc = np.repeat(np.arange(len(key)), self.words)
        self.left = np.cumsum(self.words)[self.doc] - np.arange(len(h))  # words from here to the document's end
        self.lengths = lengths
        have, self.hash = 1, []
        for want in lengths:
            while have < want:  # two overlapping windows of one length make one of up to twice that
                step = min(have, want - have)
                longer = np.zeros_like(h)
                if step < len(h):
                    longer[:-step] = shared.pair(h[:-step], h[step:])
                h, have = longer, have + step
            self.hash.append(h)

    def _values(self, level: int, at: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct short hashes of windows (sorted) and each window's place among them."""
        return np.unique(self.hash[level][at] >> np.uint64(64 - bits), return_inverse=True)

    def candidates(self, level: int, bits: int, cuts, replies: pa.Table | None) -> np.ndarray:
        """Positions of the windows of a level whose halves both repeat, by the answers to the levels before."""
        n = len(self.doc)
        at = np.flatnonzero(self.left >= self.lengths[0])
        for k in range(level):
            values, place = self._values(k, at, bits)
            again = _answers(replies, k, cuts(values)) | (np.bincount(place, minlength=len(values)) > 1)
            step = self.lengths[k + 1] - self.lengths[k]
            repeats = np.zeros(n + step, bool)
            repeats[at] = again[place]
            at = np.flatnonzero((self.left >= self.lengths[k + 1]) & repeats[:n] & repeats[step:])
        return at

    def short(self, level: int, bits: int, cuts, replies: pa.Table | None) -> np.ndarray:
        return self._values(level, self.candidates(level, bits, cuts, replies), bits)[0]

    def wide(self, bits: int, cuts, replies: pa.Table | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Positions at the last level; distinct wide hashes (two parts, in order), each window's place among them, and the first
        document rank of each."""
        at = self.candidates(len(self.lengths) - 1, bits, cuts, replies)
        own = self.hash[-1][at]
        other = self.hash[-2][at] if len(self.lengths) > 1 else own
        high, low = shared.pair(own, other, 1), shared.pair(other, own, 2) >> np.uint64(32)
        order = np.lexsort((low, high))
        h, w = high[order], low[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
        place = np.empty(len(h), np.int64)
        place[order] = np.cumsum(new) - 1
        first = np.full(int(new.sum()), len(self.rank), np.int64)
        np.minimum.at(first, place, self.rank[self.doc[at]])
        return at, h[new], w[new], place, first


def _parts(high: np.ndarray, shift: int, count: int) -> np.ndarray:
    """Where each part of the sorted values begins, and where the last ends."""
    return np.searchsorted(high >> np.uint64(shift), np.arange(count + 1, dtype=np.uint64))


def _answers(replies: pa.Table, level: int, cuts: np.ndarray) -> np.ndarray:
    """The bits that the parts have sent back, in the order of the values that were sent."""
    out = np.zeros(int(cuts[-1]), bool)
    for at, part, bits in zip(replies.column("level").to_pylist(), replies.column("part").to_pylist(), replies.column("bits").to_pylist(), strict=True):
        if at == level:
            n = int(cuts[part + 1] - cuts[part])
            out[cuts[part] : cuts[part + 1]] = np.unpackbits(np.frombuffer(bits, np.uint8), count=n)
    return out


_SENT = pa.schema([("range", pa.int32()), ("part", pa.int32()), ("blob", pa.binary())])
_REPLY = pa.schema([("range", pa.int32()), ("level", pa.int32()), ("part", pa.int32()), ("bits", pa.binary())])
SENT, REPLY = "range int, part int, blob binary", "range int, level int, part int, bits binary"


def _sent(no: int, cuts: np.ndarray, blob) -> pa.Table:
    rows = [{"range": no, "part": p, "blob": blob(int(cuts[p]), int(cuts[p + 1]))} for p in range(len(cuts) - 1) if cuts[p + 1] > cuts[p]]
    return pa.Table.from_pylist(rows, _SENT)


def _replied(level: int, ranges: np.ndarray, source: np.ndarray, flags: np.ndarray, part: int) -> pa.Table:
    """Bits for each range, of those that have any set."""
    cuts = np.searchsorted(source, np.arange(len(ranges) + 1))
    rows = [{"range": int(r), "level": level, "part": part, "bits": np.packbits(own).tobytes()} for k, r in enumerate(ranges) if (own := flags[cuts[k] : cuts[k + 1]]).any()]
    return pa.Table.from_pylist(rows, _REPLY)


def _alone(f):
    """f of one argument: Spark counts a function's arguments."""
    return lambda docs: f(docs)


def without_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """The rows of docs with n_words, n_removed and the text that is left (kept): columns row (the input row without its text),
    doc_id, kept, n_words, n_removed. It is computed at once and read back from the shared folder."""
    spark, name = docs.sparkSession, f"quillon_ranges_{uuid.uuid4().hex}"
    try:
        return shared.written(_without_repeats(docs, window, name), "without-repeats")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        shared.drop_path(spark, f"{shared.scratch_dir(spark)}/{name}")


def _without_repeats(docs: DataFrame, window: int, name: str) -> DataFrame:
    spark = docs.sparkSession
    n = shared.partitions(spark)
    lengths = levels(window)
    rest = [F.col(shared.quoted(c)) for c in docs.columns if c != "text"]
    table = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(shared.NO_ID)).alias("key"), F.col("text").cast("string").alias("text"), F.struct(*rest).alias("row"))
    table = table.withColumn("split", F.xxhash64("text", F.monotonically_increasing_id()))
    ranges = shared.ranges(table.select("key", "split", "text"), RANGE_BYTES, 2 * n)
    table = ranges.assigned(table).drop("split").repartition(n, "range")
    table.write.bucketBy(n, "range").option("path", f"{shared.scratch_dir(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
    table, order = spark.table(name), ranges.order

    total = (table.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // 6 + 1
    in_range = max(1.0, total / max(1, len(order)))
    bits = min(MAX_BITS, total.bit_length() + 5)
    parts_log = max(1, min(n - 1, int(in_range / MESSAGE)).bit_length(), (total // PART).bit_length())
    count = 1 << parts_log
    mean_gap = float(1 << bits) / in_range

    def short_cuts(values: np.ndarray) -> np.ndarray:
        return _parts(values, bits - parts_log, count)

    def filtering(level: int):
        def send(docs: pa.Table, replies: pa.Table | None = None) -> pa.Table:
            if not docs.num_rows:
                return _SENT.empty_table()
            values = Range(docs, lengths).short(level, bits, short_cuts, replies)
            return _sent(docs.column("range")[0].as_py(), short_cuts(values), lambda a, b: packed(values[a:b] & np.uint64((1 << bits - parts_log) - 1), mean_gap))

        def answer(sent: pa.Table) -> pa.Table:
            sent = sent.sort_by("range")
            found = [unpacked(b) for b in sent.column("blob").to_pylist()]
            values, source = np.concatenate(found), np.repeat(np.arange(len(found)), [len(f) for f in found])
            order = np.argsort(values, kind="stable")
            same = values[order][1:] == values[order][:-1]
            flags = np.zeros(len(values), bool)
            flags[order[1:][same]] = flags[order[:-1][same]] = True
            return _replied(level, sent.column("range").to_numpy(), source, flags, sent.column("part")[0].as_py())

        return send, answer

    def last_level(docs: pa.Table, replies: pa.Table | None = None) -> pa.Table:
        if not docs.num_rows:
            return _SENT.empty_table()
        _, high, low, _, _ = Range(docs, lengths).wide(bits, short_cuts, replies)
        wide = np.empty(len(high), [("high", "<u8"), ("low", "<u4")])
        wide["high"], wide["low"] = high, low
        return _sent(docs.column("range")[0].as_py(), _parts(high, 64 - parts_log, count), lambda a, b: wide[a:b].tobytes())

    def before(sent: pa.Table) -> pa.Table:
        sent = sent.sort_by("range")
        found = [np.frombuffer(b, [("high", "<u8"), ("low", "<u4")]) for b in sent.column("blob").to_pylist()]
        wide, source = np.concatenate(found), np.repeat(np.arange(len(found)), [len(f) for f in found])
        place = order[sent.column("range").to_numpy()][source]
        at = np.lexsort((place, wide["low"], wide["high"]))
        h, w, place = wide["high"][at], wide["low"][at], place[at]
        new = np.ones(len(at), bool)
        new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
        flags = np.zeros(len(wide), bool)
        flags[at] = place > place[np.flatnonzero(new)][np.cumsum(new) - 1]  # ids of the first range of this hash are smaller
        return _replied(len(lengths) - 1, sent.column("range").to_numpy(), source, flags, sent.column("part")[0].as_py())

    row_type = next(f for f in table.schema if f.name == "row").dataType
    result = T.StructType([T.StructField("row", row_type), T.StructField("doc_id", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType())])

    def removed(docs: pa.Table, replies: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return pa.table({"row": docs.column("row"), "doc_id": docs.column("key"), "kept": docs.column("text"), "n_words": docs.column("key"), "n_removed": docs.column("key")})
        r = Range(docs, lengths)
        at, high, low, place, first = r.wide(bits, short_cuts, replies)
        gone = at[_answers(replies, len(lengths) - 1, _parts(high, 64 - parts_log, count))[place] | (r.rank[r.doc[at]] > first[place])]
        edge = np.zeros(len(r.doc) + window + 1, np.int64)
        np.add.at(edge, gone, 1)
        np.add.at(edge, gone + window, -1)
        covered = np.cumsum(edge)[: len(r.doc)] > 0
        lost = np.bincount(r.doc[covered], minlength=len(r.words))
        texts = r.docs.column("text").to_pylist()
        begin = np.cumsum(r.words) - r.words
        for k in np.flatnonzero(lost).tolist():
            keep = ~covered[begin[k] : begin[k] + r.words[k]]
            texts[k] = b" ".join([w for w, kept in zip(texts[k].encode().split(), keep.tolist(), strict=True) if kept]).decode()
        key = r.docs.column("key").to_numpy()
        return pa.table({"row": r.docs.column("row"), "doc_id": pa.array(key, mask=key == shared.NO_ID), "kept": pa.array(texts, pa.string()), "n_words": pa.array(r.words), "n_removed": pa.array(lost)})

    by_range, replies = table.groupBy("range"), None
    for level, length in enumerate(lengths):
        send, answer = filtering(level) if level < len(lengths) - 1 else (last_level, before)
        sent = by_range.applyInArrow(_alone(send), SENT) if replies is None else by_range.cogroup(replies.groupBy("range")).applyInArrow(send, SENT)
        found = shared.written(sent.groupBy("part").applyInArrow(answer, REPLY), f"windows-{length}")
        replies = found if replies is None else replies.unionAll(found)
        if not found.take(1):  # no window repeats in another range: what is left is compared within ranges
            break
    return by_range.cogroup(replies.groupBy("range")).applyInArrow(removed, result)
