"""Helpers common to the operators: scratch tables, Arrow batches, word hashing, labelled samples."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows in one Arrow batch of documents, in jobs that run within small_batches().
ARROW_ROWS = 256
#: Bytes of text that vectorised functions work on at a time.
CHUNK_BYTES = 2 << 20


# --- tables ---------------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a temporary one in local mode, else an error."""
    if not (top := spark.conf.get("spark.checkpoint.dir", None)):
        top = spark.sparkContext.getCheckpointDir()
    if not top:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        top = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
        spark.sparkContext.setCheckpointDir(top)
    return f"{top.rstrip('/')}/quillon"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df written as Parquet to the shared folder and read again: a cut of the lineage that survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_path(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that are no longer used; it does so when the driver collects garbage, which else may be
    late: iterations then fill the executors' disks with what they have done with."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_scratch(spark: SparkSession) -> None:
    """Remove every scratch table of this application; frames that still read one of them can't be used any more."""
    drop_path(spark, scratch_dir(spark))


@contextmanager
def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> Iterator[None]:
    """Bound the rows of Arrow batches in the jobs that run meanwhile. Jobs that run later, of frames that are handed out, have the
    session's own bounds (64 MB a batch by default)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        out.append(n)
    return out


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def chosen_rows(docs: DataFrame, keys: DataFrame, once: bool = False) -> DataFrame:
    """The rows of docs whose doc_id and xxhash64 of the text are those of a row of keys (doc_id, text_hash); with once, of
    rows that agree in both only the smallest. Null ids match null ids."""
    no_id = F.lit(-(1 << 63))
    names = [quoted(c) for c in docs.columns]
    i, h, n = fresh(docs, "id__", "hash__", "n__")
    left = docs.withColumns({i: F.coalesce(docs["doc_id"].cast("long"), no_id), h: F.xxhash64(docs["text"].cast("string"))})
    right = keys.select(F.coalesce(F.col("doc_id"), no_id).alias(i), F.col("text_hash").alias(h))
    out = left.join(right, [i, h], "left_semi")
    if once:
        order = Window.partitionBy(i, h).orderBy(*(F.col(c) for c, f in zip(names, docs.schema, strict=True) if isinstance(f.dataType, T.AtomicType)))
        out = out.withColumn(n, F.row_number().over(order)).where(F.col(n) == 1)
    return out.select(*names)


def quoted(name: str) -> str:
    """A column's name as Spark takes it, whatever is in it."""
    return "`" + name.replace("`", "``") + "`"


def id_hash(col: str) -> Column:
    """crc32 of the id as text; null for a null id."""
    return F.crc32(F.col(col).cast("string").cast("binary"))


def trim() -> None:
    """Give memory that Python has freed back to the system, where its allocator can."""
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


# --- Arrow ----------------------------------------------------------------------------------


def regrouped(batches: Iterable[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.Table]:
    """Batches joined or cut so that each holds about limit bytes of text, one row at least."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            done = int(ends[at - 1]) if at else 0
            to = max(int(np.searchsorted(ends, done + limit - size, side="right")), at + (not held))
            if to > at:
                held.append(batch.slice(at, to - at))
                size += int(ends[to - 1]) - done
            if to < batch.num_rows or size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
            at = to
    if held:
        yield pa.Table.from_batches(held)
    held = []
    trim()


def joined(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts as one byte array with a space after each, and where each starts and ends (null: empty)."""
    arr = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if isinstance(arr, pa.ChunkedArray):
        arr = pa.concat_arrays(arr.chunks)
    arr = pc.fill_null(arr.cast(pa.large_string()), "")
    n = len(arr)
    lengths = pc.binary_length(arr).to_numpy(zero_copy_only=False).astype(np.int64)
    one = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, n], pa.int64()), arr), pa.scalar(" ", pa.large_string()))
    data = np.frombuffer(one.buffers()[2] or b"", dtype=np.uint8, count=int(lengths.sum()) + max(0, n - 1))
    data = np.concatenate([data, np.array([32], np.uint8)])
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    return data, starts, starts + lengths


# --- hashing --------------------------------------------------------------------------------

_SEED = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
#: Bytes that are hashed at a time. Powers are products of one within a segment and one of the segment.
SEGMENT = 1 << 20
#: White space between words: 0x20 and 0x09 to 0x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def pair(a: np.ndarray, b: np.ndarray, salt: int = 0) -> np.ndarray:
    """An order-sensitive hash of two hashes."""
    return mix(a * np.uint64(0xA0761D6478BD642F) + (b ^ (b >> np.uint64(29))) * np.uint64(0xE7037ED1A0B428DB) + np.uint64(salt))


def _power_table(base: int, n: int) -> np.ndarray:
    """base ** k for k below n, modulo 2 ** 64."""
    out, step = np.ones(1, np.uint64), base
    while len(out) < n:
        out = np.concatenate([out, out * np.uint64(step)])
        step = step * step % (1 << 64)
    return out[:n]


@lru_cache(None)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse within a segment."""
    return _power_table(_BASE, SEGMENT), _power_table(pow(_BASE, -1, 1 << 64), SEGMENT)


def _sums_at(data: np.ndarray, places: list[np.ndarray]) -> list[np.ndarray]:
    """Sums of the byte values times powers before each of the positions (ascending lists), a segment of the data at a time."""
    up, _ = _powers()
    out, total, scale = [np.zeros(len(at), np.uint64) for at in places], np.uint64(0), 1
    for k in range(0, len(data), SEGMENT):
        part = _BYTE[data[k : k + SEGMENT]]
        part *= up[: len(part)] * np.uint64(scale) if scale != 1 else up[: len(part)]
        np.cumsum(part, out=part)
        for at, sums in zip(places, out, strict=True):
            lo, hi = np.searchsorted(at, [k + 1, k + len(part) + 1])
            sums[lo:hi] = part[at[lo:hi] - (k + 1)] + total
        total += part[-1]
        scale = scale * pow(_BASE, SEGMENT, 1 << 64) % (1 << 64)
    return out


def span_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte spans, equal for equal bytes wherever they stand."""
    if len(starts) > 1 and ((starts[1:] < starts[:-1]).any() or (ends[1:] < ends[:-1]).any()):
        a, e = (np.argsort(x, kind="stable") for x in (starts, ends))
        low, high = np.empty(len(a), np.uint64), np.empty(len(e), np.uint64)
        low[a], high[e] = _sums_at(data, [starts[a], ends[e]])
    else:
        low, high = _sums_at(data, [starts, ends])
    _, down = _powers()
    with np.errstate(over="ignore"):
        sums = high - low
        sums *= down[starts % SEGMENT] if len(data) > SEGMENT else down[starts]
        if len(data) > SEGMENT:
            sums *= _power_table(pow(_BASE, -SEGMENT, 1 << 64), len(data) // SEGMENT + 1)[starts // SEGMENT]
        sums += (ends - starts).astype(np.uint64)
        return mix(sums)


def word_spans(data: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of an array that ends with a space."""
    gap = space[data]
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    if len(gap) and not gap[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]


def pieces(texts: pa.ChunkedArray | pa.Array, limit: int, space: np.ndarray = SPACE) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, starts of rows): all texts in order, about limit bytes at a time, with a space after each row and
    at the end. A longer text comes in several pieces, cut at white space (a word that is longer than the limit stays whole)."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) if len(texts) else np.zeros(0, np.int64)
    ends, at = np.cumsum(lengths), 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right")))
        if lengths[at] <= 2 * limit:
            data, starts, _ = joined(texts.slice(at, to - at))
            yield at, data, starts
        else:
            whole = np.frombuffer(texts[at].as_buffer(), np.uint8)
            k, to = 0, at + 1
            while k < len(whole):
                end = min(k + limit, len(whole))
                if end < len(whole):
                    gaps = np.flatnonzero(space[whole[k:end]])
                    if len(gaps):
                        end = k + int(gaps[-1]) + 1
                    else:  # one word: to its end
                        while end < len(whole) and not (found := space[whole[end : end + limit]]).any():
                            end = min(end + limit, len(whole))
                        end = end + int(found.argmax()) + 1 if end < len(whole) else end
                yield at, np.append(whole[k:end], np.uint8(32)), np.zeros(1, np.int64)
                k = end
        at = to


def word_hashes(texts: pa.ChunkedArray, limit: int = CHUNK_BYTES // 4) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts, in order, and the number of words of each text. Works on about limit bytes at a time, so
    that it needs little beside the hashes."""
    hashes, counts = [np.zeros(0, np.uint64)], np.zeros(len(texts), np.int64)
    for row, data, starts in pieces(texts, limit):
        a, e = word_spans(data)
        hashes.append(span_hash(data, a, e))
        counts[row : row + len(starts)] += np.bincount(np.searchsorted(starts, a, side="right") - 1, minlength=len(starts))
    return np.concatenate(hashes), counts


def word_slices(text: np.ndarray, gap: np.ndarray, step: int, before: int = 0, after: int = 0) -> Iterator[tuple[bytes, bytes]]:
    """A long text (bytes) in slices of step words, each with so many words before and after it; and the words before alone."""
    starts = [np.zeros(0, np.int64)]
    for k in range(0, len(text), SEGMENT):
        g = np.concatenate([[True] if k == 0 else gap[text[k - 1 : k]], gap[text[k : k + SEGMENT]]])
        starts.append(np.flatnonzero(g[:-1] & ~g[1:]) + k)
    at = np.append(np.concatenate(starts), len(text))
    n = len(at) - 1
    for k in range(0, n, step):
        low = max(k - before, 0)
        yield text[at[low] : at[min(k + step + after, n)]].tobytes(), text[at[low] : at[k]].tobytes()


# --- labelled samples -----------------------------------------------------------------------


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, max_rows: int, max_chars: int) -> tuple[list[str], np.ndarray]:
    """Texts and 0/1 labels to learn from: at most max_rows / 2 rows of each class in the order of a hash of the id,
    none longer than max_chars, and none whose crc32(doc_id as text) mod 3 is 1. A doc_id with several labels counts
    as 1 if their mean is at least 0.5. The ids are chosen on the labels alone; only their texts reach the driver."""
    known = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (id_hash("doc_id") % 3 != 1))
        .groupBy("doc_id")
        .agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    ids = [r for y in (1, 0) for r in known.where(F.col("y") == y).orderBy(*order).limit(max_rows // 2).collect()]
    if not ids:
        return [], np.zeros(0)
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r["doc_id"], r["y"]) for r in ids], "doc_id long, y int")
    rows = (
        docs.select("doc_id", "text")
        .where(F.length("text") <= max_chars)
        .join(F.broadcast(chosen), "doc_id")  # max_rows pairs of numbers
        .orderBy(*order, "text")
        .limit(max_rows)
        .collect()
    )
    return [r["text"] for r in rows], np.array([r["y"] for r in rows], float)


# --- ranges of ids --------------------------------------------------------------------------

NO_ID = -(1 << 63)


def long_sql(x: int) -> str:
    """A long as SQL; the least one can't be written as a literal."""
    return f"{x}L" if x > -(1 << 63) else "(-9223372036854775807L - 1L)"


def _array_sql(values: Iterable[int]) -> str:
    return f"array({','.join(map(long_sql, values))})"


def at(values: list[int], place: str) -> Column:
    """The value at a place (a column, from 0)."""
    return F.expr(f"get({_array_sql(values)}, {place})")


def range_of(key: str, bounds: list[int]) -> Column:
    """The number of bounds at or below the key, counted in two levels so that a row meets about 2 sqrt(n) of them."""
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    below = f"size(filter({_array_sql(bounds[step - 1 :: step])}, x -> x <= {key})) * {step}"
    return F.expr(f"{below} + size(filter(slice({_array_sql(bounds)}, {below} + 1, {step}), x -> x <= {key}))").cast("int")


@dataclass(frozen=True)
class Ranges:
    """Ranges of a key with about equally many bytes of text. A key with more than its share has several, by a second column (split).
    order[r]: the place of range r among the keys; ranges of one key share it."""

    bounds: list[int]
    first: list[int]
    cuts: dict[int, list[int]]
    order: np.ndarray

    def assigned(self, df: DataFrame, key: str = "key", split: str = "split") -> DataFrame:
        """df with a column range; key and split are longs."""
        df = df.withColumn("range", range_of(key, self.bounds))
        sub = "0"
        for fine, cuts in self.cuts.items():  # keys with more than their share: fewer than there are ranges
            sub = f"CASE WHEN range = {fine} THEN size(filter({_array_sql(cuts)}, x -> x <= {split})) ELSE {sub} END"
        return df.withColumn("range", F.expr(f"cast(get({_array_sql(self.first)}, range) + {sub} AS int)"))


def ranges(df: DataFrame, target: int, least: int) -> Ranges:
    """Ranges of df (key, split, text) of about target bytes, least of them if there are enough keys; from statistics of all rows. Rows
    are cut finely by their keys, which are then joined up by their bytes."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 64
    rows, total = df.agg(F.count("*"), F.sum(size)).first()
    target = max(1, min(target, (total or 0) // max(least, 1)))
    fine = int(min(max(2 * (total or 0) // target, 1), 100_000))
    cuts = [int(c) for c in df.agg(F.percentile_approx("key", [k / fine for k in range(1, fine)], max(10_000, 4 * fine))).first()[0] or []] if rows and fine > 1 else []
    often = {c for c, again in zip(cuts, cuts[1:], strict=False) if c == again}
    bounds = sorted({*cuts} | {c + 1 for c in often})
    sizes = {r["range"]: (r["bytes"], r["least"], r["most"], r["n"]) for r in df.withColumn("range", range_of("key", bounds)).groupBy("range").agg(F.sum(size).alias("bytes"), F.min("key").alias("least"), F.max("key").alias("most"), F.count("*").alias("n")).collect()}  # one row for each
    sizes = {f: (b, -(-b // target) if low == high and n > 1 and b > 2 * target else 1) for f, (b, low, high, n) in sizes.items()}
    split: dict[int, list[int]] = {}
    if (most := min(max((n for _, n in sizes.values()), default=1), 10_000)) > 1:
        hot = df.withColumn("range", range_of("key", bounds)).where(F.col("range").isin([f for f, (_, n) in sizes.items() if n > 1]))
        for r in hot.groupBy("range").agg(F.percentile_approx("split", [k / most for k in range(1, most)], 10 * most).alias("cuts")).collect():
            n = min(sizes[r["range"]][1], most)
            split[r["range"]] = sorted({int(r["cuts"][k * most // n - 1]) for k in range(1, n)})
    first, order, held = [], [], target
    for f in range(len(bounds) + 1):
        own = sizes.get(f, (0, 1))[0]
        if f in split:
            first.append(len(order))
            order += [f] * (len(split[f]) + 1)
            held = target
            continue
        if held + own > target:
            order.append(f)
            held = 0
        first.append(len(order) - 1)
        held += own
    return Ranges(bounds, first, split, np.array(order, np.int64))
