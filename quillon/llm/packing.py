"""Best-fit packing of token sequences over a histogram of lengths.

Texts are tokenised, ended with id 0 and, where longer than a sequence, cut into full pieces with a shorter first one.
Pieces are sorted by length. As lengths are whole numbers up to the sequence length, the sorted pieces and the sorted
gaps (room left in open sequences) are kept as runs of equal length: a round sweeps both lists, gives each run of
pieces its successor run of gaps (the least room that suffices), in order of rank within the run, updates the
gaps, and repeats with what is left; pieces without a gap open new sequences. The rounds need one number for each
length, so they cost the same for any number of documents. Full pieces need no match. What a round decides is a range of ranks within a length,
a range of sequences and an offset; each piece finds its own by its rank, which is counted in parallel over salted
groups of equal length, so that a length that most pieces share is still dealt to many tasks.

Nulls: a null text is empty and has the one id 0; a null doc_id is kept. Repeated rows are packed each. An empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import shared

END = np.zeros(1, "<u4").tobytes()
#: Groups that pieces of the same length are dealt to: as many as there are partitions, between these bounds.
SALTS = (64, 1024)
#: Where byte-level BPE of this kind cuts texts before it merges bytes; fixed by the vocabulary.
CUTS = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""


class Ids:
    """Ids of texts as little-endian bytes. A byte-level BPE vocabulary whose ids are in the order of its merges is handed to the
    faster of the two libraries that take it, which gives the same ids; any other is used as it is. Added tokens that stand
    in a text have their own ids: texts with one go to the library that knows them."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast = self._fast()

    def _fast(self):
        import json

        try:
            import tiktoken
        except ImportError:  # the other library does all
            return None
        spec = json.loads(self.tokenizer.to_str())
        model, cut = spec["model"], spec.get("pre_tokenizer") or {}
        if model.get("type") != "BPE" or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or spec.get("normalizer"):
            return None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves; the others follow from 256 on
        byte = {chr(c): c for c in plain} | {chr(256 + k): c for k, c in enumerate(sorted({*range(256)} - {*plain}))}
        merges = [model["vocab"][a + b] for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        if merges != list(range(256, 256 + len(merges))):
            return None
        ranks = {bytes(byte[c] for c in w): i for w, i in model["vocab"].items() if i < 256 + len(merges)}
        return tiktoken.Encoding("ids", pat_str=CUTS, mergeable_ranks=ranks, special_tokens={})

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.fast:
            return [np.array(self.tokenizer.encode(t, add_special_tokens=False).ids if any(a in t for a in self.added) else self.fast.encode_ordinary(t), "<u4").tobytes() for t in texts]
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]


def _pieces(path: str, length: int, salts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks already fill the cores
        tokenizer, n = Ids(path), 0
        for chunk in shared.regrouped(batches, "text"):
            out: list[tuple] = []
            for doc, ids in zip(chunk.column("doc_id").to_pylist(), tokenizer.encode([t or "" for t in chunk.column("text").to_pylist()]), strict=True):
                ids += END
                total = len(ids) // 4
                start = 0
                for piece in range(-(-total // length)):
                    end = total - (-(-total // length) - 1 - piece) * length
                    out.append((doc, piece, start, end - start, zlib.crc32(ids[4 * start : 4 * end]), n % salts))
                    start = end
                    n += 1
            columns = list(zip(*out, strict=True))
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32", "salt"])

    return run


def best_fit(counts: np.ndarray, length: int) -> list[tuple[int, int, int, int, int]]:
    """Pack runs of pieces. counts[n]: pieces of length n. Returns (n, first rank, pieces, first sequence, offset): the
    pieces of these ranks go to as many sequences one after another, all at that offset."""
    gaps: list[list[tuple[int, int]]] = [[] for _ in range(length + 1)]  # by room: (first sequence, sequences)
    rooms: list[int] = []  # sorted rooms that have gaps
    opened = 0
    out: list[tuple[int, int, int, int, int]] = []

    def leave(room: int, run: tuple[int, int]) -> None:
        if room and run[1]:
            if not gaps[room]:
                rooms.insert(int(np.searchsorted(rooms, room)), room)
            gaps[room].append(run)

    for n in range(length, 0, -1):
        left, rank = int(counts[n]), 0
        while left:  # rounds: the successor run of gaps, or new sequences
            at = int(np.searchsorted(rooms, n))
            if at < len(rooms):
                room = rooms[at]
                first, size = gaps[room].pop()
                if not gaps[room]:
                    del rooms[at]
            else:
                room, first, size = length, opened, -(-left // (length // n))
                opened += size
            fit = room // n
            full, over = (size, 0) if left >= size * fit else divmod(left, fit)
            for k in range(fit if full else 0):  # a gap stays the successor until the next piece doesn't fit
                out.append((n, rank, full, first, length - room + k * n))
                rank += full
            for k in range(over):
                out.append((n, rank, 1, first + full, length - room + k * n))
                rank += 1
            left -= full * fit + over
            leave(room - fit * n, (first, full))
            leave(room - over * n, (first + full, 1 if over else 0))
            leave(room, (first + full + bool(over), size - full - bool(over)))
    return out


def packed(docs: DataFrame, tokenizer_path: str, length: int = 2048) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    spark = docs.sparkSession
    salts = int(np.clip(shared.partitions(spark), *SALTS))
    with shared.small_batches(spark):
        pieces = shared.written(
            docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pieces(tokenizer_path, length, salts), "doc_id long, piece int, start long, length long, ids_crc32 long, salt int"),
            "pieces",
        )
    # A full piece is a sequence of its own, numbered where it stands (below 0).
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.where(F.col("length") == length).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    pieces = pieces.where(F.col("length") < length)
    groups = np.zeros((length + 1, salts), np.int64)
    for r in pieces.groupBy("length", "salt").count().collect():  # at most lengths times salts
        groups[r["length"], r["salt"]] = r["count"]
    first = np.cumsum(groups, axis=1) - groups
    moves = np.array(best_fit(groups.sum(axis=1), length), np.int64).reshape(-1, 5)
    moves = moves[np.lexsort((moves[:, 1], moves[:, 0]))]
    total = int(groups.sum()) + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, seen = -1, 0  # the (length, salt) group that the sorted rows have come to
        key_of_move = moves[:, 0] * total + moves[:, 1]
        for b in batches:
            n, salt = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "salt"))
            if not len(n):
                continue
            group = n * salts + salt
            new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            within = np.arange(len(n)) - np.repeat(new, np.diff(np.append(new, len(n))))
            if group[0] == last:
                within[: new[1] if len(new) > 1 else len(n)] += seen
            last, seen = group[-1], int(within[-1]) + 1
            rank = first[n, salt] + within
            m = moves[np.searchsorted(key_of_move, n * total + rank, side="right") - 1]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(m[:, 3] + rank - m[:, 1]), pa.array(m[:, 4])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return (
        pieces.repartition(shared.partitions(spark), "length", "salt")
        .sortWithinPartitions("length", "salt", "doc_id", "piece", "ids_crc32")
        .mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
        .unionByName(full)
    )
