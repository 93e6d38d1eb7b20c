"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, all of them.

Words are those of SimHash: white space apart, ASCII letters in lower case; a text of fewer than five words is one shingle.

Candidates: shingles are put in one order for all texts (common ones last, then by hash; a sample of texts tells which are common). Two texts that are similar enough
share a shingle among the first n - ceil(0.8 n) + 1 of each (prefix filter), so texts meet under these. Texts that meet are
compared by their numbers of shingles and by parity bitmaps: shingles in one set only are at least as many as bits that
differ. Pairs that may be similar are reduced to a spanning forest under each shingle; its components, over all shingles,
hold every pair of near copies. Within a component the sets themselves are compared, but for pairs that are linked already.
Each step is exact; the order of shingles decides how many texts meet, not what is found.

A shingle that more than ``CROWD`` texts share makes one component of them, without a comparison. Components of more than ``CROWD`` texts
or ``UNIT_BYTES`` are cut into units, each compared in itself. Of copies, that links nearly all. Then one text of each label
(component of near copies so far) but for the most frequent one meets the first unit, and texts that still have another label
meet all units, in slices. So every pair of texts with different labels is compared, and no task holds more than two units.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import shared, simhash

WORDS = 5
#: One text in so many tells which shingles are common. Shingles in that sample from LEAST texts on are, MOST of them; their levels stand
#: in so many places.
SAMPLE, LEAST, MOST, PLACES = 16, 4, 1 << 20, 1 << 23
#: Widths of parity bitmaps: about a bit for each shingle.
NARROW, WIDE = 1 << 10, 1 << 14
#: Texts, and their bytes, that are compared in one task.
CROWD, UNIT_BYTES = 1024, 8 << 20
#: Groups with several units that are broadcast at most.
BROADCAST_GROUPS = 500_000


def least_common(n: int) -> int:
    """The least overlap of a set of n with one that is similar enough: 0.8 n, rounded up."""
    return (4 * n + 4) // 5


def similar(common: int, a: int, b: int) -> bool:
    return 5 * common >= 4 * (a + b - common) and common > 0


def shingle_sets(texts: pa.Array) -> Iterator[np.ndarray]:
    """The sorted hashes of each text's shingles."""
    words, counts = shared.word_hashes(pa.chunked_array([pc.ascii_lower(texts.cast(pa.large_string()))]))
    ends = np.cumsum(counts)
    span = words
    for k in range(1, WORDS):
        span = shared.pair(span[: max(len(words) - k, 0)], words[k:], k)
    for a, e in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        if e - a >= WORDS:
            yield np.unique(span[a : e - WORDS + 1])
        else:
            h = words[a : min(a + 1, e)]
            for k in range(1, e - a):
                h = shared.pair(h, words[a + k : a + k + 1], k)
            yield h


def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number of shingles and parity bitmap of each text."""
    for chunk in shared.regrouped(batches, "text"):
        sets = list(shingle_sets(chunk.column("text").combine_chunks()))
        yield pa.RecordBatch.from_arrays([chunk.column("text_hash").combine_chunks(), pa.array([len(s) for s in sets], pa.int64()), pa.array([parity(s).tobytes() for s in sets], pa.binary())], names=["text_hash", "n", "parity"])


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for chunk in shared.regrouped(batches, "text"):
        keys = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(chunk.column("text").combine_chunks())])
        yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64))], names=["key"])


def common_levels(texts: DataFrame) -> np.ndarray:
    """For each place (a shingle's last bits) the logarithm of how many texts of a sample have a shingle there; 0 where none is common.
    Shingles are counted apart, whatever their number, so that the many rare ones don't hide a common one."""
    counts = texts.where(F.pmod("text_hash", F.lit(SAMPLE)) == 0).mapInArrow(_shingles, "key long").groupBy("key").count().where(F.col("count") >= LEAST)
    counts = shared.written(counts.select(F.col("key").bitwiseAND(F.lit(PLACES - 1)).cast("int").alias("place"), F.floor(F.log2("count")).cast("byte").alias("level")), "near-common")
    least, n = 128, 0
    for r in counts.groupBy("level").count().orderBy(F.desc("level")).collect():  # at most 63
        if (n := n + r["count"]) > MOST:
            break
        least = r["level"]
    found = counts.where(F.col("level") >= least).toArrow()  # MOST pairs of numbers at most
    levels = np.zeros(PLACES, np.int8)
    np.maximum.at(levels, found.column("place").to_numpy(), found.column("level").to_numpy())
    return levels


def _prefixes(levels: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in shared.regrouped(batches, "text"):
            keys, sizes = [np.zeros(0, np.uint64)], []
            for s in shingle_sets(chunk.column("text").combine_chunks()):
                n = len(s) - least_common(len(s)) + 1 if len(s) else 0
                order = np.argsort(levels[(s & np.uint64(PLACES - 1)).astype(np.int64)], kind="stable")  # s is sorted by hash
                keys.append(s[order[:n]])
                sizes.append(n)
            h = np.repeat(chunk.column("text_hash").to_numpy(), sizes)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), pa.array(h)], names=["key", "text_hash"])

    return run


def _shared_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by key and text, each once, those whose key has several texts."""
    held_key, held_text, met = None, None, False
    for b in batches:
        if not b.num_rows:
            continue
        key, text = b.column("key").to_numpy(), b.column("text_hash").to_numpy()
        if held_key is not None:
            key, text = np.concatenate([[held_key], key]), np.concatenate([[held_text], text])
        new_key = np.concatenate([[True], key[1:] != key[:-1]])
        fresh = new_key | np.concatenate([[True], text[1:] != text[:-1]])
        key, text = key[fresh], text[fresh]
        # the last row waits for the next batch, as its key may go on
        same_before = np.concatenate([[met], key[1:] == key[:-1]])
        same_after = np.concatenate([key[:-1] == key[1:], [False]])
        keep = (same_before | same_after)[:-1]
        held_key, held_text, met = key[-1], text[-1], bool(same_before[-1])
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[:-1][keep]), pa.array(text[:-1][keep])], names=["key", "text_hash"])
    if met:
        yield pa.RecordBatch.from_arrays([pa.array([held_key], pa.int64()), pa.array([held_text], pa.int64())], names=["key", "text_hash"])


def parity(s: np.ndarray) -> np.ndarray:
    """The parity bitmap of a set, as 64-bit words."""
    width = min(max(NARROW, 1 << max(len(s) - 1, 1).bit_length()), WIDE)
    bits = np.bincount((s >> np.uint64(20)).astype(np.int64) % width, minlength=width) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def forest(n: np.ndarray, maps: list[np.ndarray], test=None) -> list[tuple[int, int]]:
    """Pairs of a spanning forest over the rows that may be similar and pass the test (none: all). n ascends."""
    label, parts = np.arange(len(n)), len(n)
    folded: dict[int, np.ndarray] = {}
    out = []
    for i in range(len(n) - 1):
        end = int(np.searchsorted(n, 5 * n[i] // 4, side="right"))
        if parts == 1:
            break
        if end <= i + 1:
            continue
        width = len(maps[i])
        if width not in folded:  # wider ones are folded; n ascends, so narrower ones stand before
            folded[width] = np.stack([np.bitwise_xor.reduce(m.reshape(-1, width), axis=0) if len(m) >= width else np.zeros(width, np.uint64) for m in maps])
        rows = np.flatnonzero(label[i + 1 : end] != label[i]) + i + 1
        differ = np.bitwise_count(folded[width][rows] ^ folded[width][i]).sum(axis=1, dtype=np.int64)
        for j in rows[9 * differ <= n[i] + n[rows]].tolist():
            if label[i] != label[j] and (test is None or test(i, j)):
                label[label == label[j]] = label[i]
                parts -= 1
                out.append((i, j))
    return out


def _by_parity(rows: list[tuple]) -> list[tuple[int, int]]:
    return forest(np.array([r[2] for r in rows], np.int64), [np.frombuffer(r[3], np.uint64) for r in rows])


def _by_sets(rows: list[tuple]) -> list[tuple[int, int]]:
    sets = list(shingle_sets(pa.array([r[3] for r in rows], pa.large_binary()).cast(pa.large_string())))
    return forest(np.array([r[2] for r in rows], np.int64), [parity(s) for s in sets], lambda i, j: similar(len(np.intersect1d(sets[i], sets[j], assume_unique=True)), len(sets[i]), len(sets[j])))


def _meeting(compare):
    """Links among the rows of each unit, from rows sorted by unit and n."""

    def linked(held: list[tuple]) -> pa.RecordBatch | None:
        found = compare(held) if len(held) > 1 else []
        links = [sorted((held[i][1], held[j][1])) for i, j in found if held[i][1] != held[j][1]]
        return pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"]) if links else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("unit", "text_hash", "n", "data")), strict=True):
                if held and held[0][0] != row[0]:
                    if (out := linked(held)) is not None:
                        yield out
                    held = []
                held.append(row)
        if held and (out := linked(held)) is not None:
            yield out
        shared.trim()

    return run


def connected(rows: DataFrame, compare, tag: str) -> DataFrame:
    """Links (a, b) that connect all rows (group, text_hash, n, data) of a group that compare() links, whatever the size of groups."""
    spark = rows.sparkSession
    parts = shared.partitions(spark)

    def met(units: DataFrame) -> DataFrame:
        units = units.select(F.xxhash64("group", "unit", "slice").alias("unit"), "text_hash", "n", "data")  # a clash only makes a unit larger
        with shared.small_batches(spark):
            return shared.written(units.repartition(parts, "unit").sortWithinPartitions("unit", "n", "text_hash").mapInArrow(_meeting(compare), "a long, b long").distinct(), tag)

    units = F.ceil(F.greatest(F.count("*") / CROWD, F.sum(F.octet_length("data")) / UNIT_BYTES)).cast("int")
    large = shared.written(rows.groupBy("group").agg(units.alias("units")).where("units > 1"), f"{tag}-large")
    n_large = large.count()
    none = F.lit(0)
    if not n_large:
        return met(rows.withColumns({"unit": none, "slice": none}))
    sized = F.broadcast(large) if n_large <= BROADCAST_GROUPS else large
    placed = rows.join(sized, "group", "left").withColumn("units", F.coalesce("units", F.lit(1))).withColumn("unit", F.pmod(F.xxhash64("text_hash", "group"), "units").cast("int"))
    links = met(placed.withColumn("slice", none))
    large_rows = placed.where("units > 1")
    for whole in (False, True):
        labels = simhash.components(links).select(F.col("node").alias("text_hash"), F.col("root").alias("label"))
        labelled = shared.written(large_rows.join(labels, "text_hash", "left").withColumn("label", F.coalesce("label", "text_hash")), f"{tag}-labelled")
        by_label = labelled.groupBy("group", "label").agg(F.count("*").alias("c"), F.min("text_hash").alias("first"))
        most = by_label.groupBy("group").agg(F.max_by("label", F.struct("c", "label")).alias("most"), F.count("*").alias("labels")).where("labels > 1")
        others = by_label.join(most, "group").where("label != most")
        open_ = others.groupBy("group").agg(F.sum("c" if whole else F.lit(1)).alias("asking")).withColumn("slices", F.ceil(F.col("asking") / CROWD).cast("int"))
        open_ = shared.written(open_.select("group", "slices"), f"{tag}-open")
        n_open = open_.count()
        if not n_open:
            break
        known = F.broadcast(open_) if n_open <= BROADCAST_GROUPS else open_
        keys = others.select("group", "label") if whole else others.select("group", F.col("first").alias("text_hash"))
        asking = labelled.join(keys, keys.columns, "left_semi").join(known, "group").withColumn("slice", F.pmod(F.xxhash64("text_hash"), "slices").cast("int"))
        asking = asking.withColumn("unit", F.explode(F.sequence(none, F.col("units") - 1)) if whole else none)
        asked = labelled.join(known, "group").where("true" if whole else "unit = 0").withColumn("slice", F.explode(F.sequence(none, F.col("slices") - 1)))
        columns = ["group", "unit", "slice", "text_hash", "n", "data"]
        links = shared.written(links.unionByName(met(asking.select(*columns).unionByName(asked.select(*columns)))).distinct(), tag)
    return links


def links(docs: DataFrame) -> DataFrame:
    """Links (a, b) between hashes of different texts that connect all near copies."""
    spark = docs.sparkSession
    n = shared.partitions(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    texts = docs.select(F.xxhash64(F.col("text").cast("string")).alias("text_hash"), text.alias("text"))
    with shared.small_batches(spark):
        made = shared.written(texts.mapInArrow(_sketches, "text_hash long, n long, parity binary"), "near-sketches")
    prefixes = texts.mapInArrow(_prefixes(common_levels(texts)), "key long, text_hash long")
    with shared.small_batches(spark):
        members = shared.written(prefixes.repartition(n, "key").sortWithinPartitions("key", "text_hash").mapInArrow(_shared_keys, "key long, text_hash long"), "near-members")
    shared.release(spark)
    sketches = made.groupBy("text_hash").agg(F.min("n").alias("n"), F.min("parity").alias("data"))
    large = shared.written(members.groupBy("key").agg(F.count("*").alias("n"), F.min("text_hash").alias("first")).where(F.col("n") > CROWD).drop("n"), "near-crowds")
    large = F.broadcast(large) if large.count() <= BROADCAST_GROUPS else large
    star = members.join(large, "key").select(F.col("text_hash").alias("a"), F.col("first").alias("b")).where("a != b")
    met = members.join(large.select("key"), "key", "left_anti").join(sketches, "text_hash").select(F.col("key").alias("unit"), "text_hash", "n", "data")
    with shared.small_batches(spark):
        met = met.repartition(n, "unit").sortWithinPartitions("unit", "n").mapInArrow(_meeting(_by_parity), "a long, b long")
        groups = simhash.components(shared.written(met.unionByName(star).distinct(), "near-candidates"))
    # Of equal texts one takes part; they are met by hashes before whole texts are moved.
    candidates = groups.select(F.col("node").alias("text_hash"), F.col("root").alias("group"))
    own = texts.join(candidates, "text_hash").groupBy("text_hash").agg(F.min("group").alias("group"), F.min("text").alias("text"))
    own = own.join(sketches.select("text_hash", "n"), "text_hash").select("group", "text_hash", "n", F.col("text").cast("binary").alias("data"))
    return connected(shared.written(own, "near-texts"), _by_sets, "near-links")


def deduplicated(docs: DataFrame, radius: int = 2) -> DataFrame:
    """As simhash.deduplicated(), of components whose links are those of fingerprints and those of near copies."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first")
    texts = shared.written(simhash.near_duplicates(docs, radius).groupBy("text_hash", "root").agg(first), "near-found")  # one row for each text
    alike = texts.groupBy("root").agg(F.min("text_hash").alias("b"), F.count("*").alias("n")).where("n > 1")
    alike = simhash.looked_up(texts, alike, "root", texts.count()).where(F.col("text_hash") != F.col("b")).select(F.col("text_hash").alias("a"), "b")
    roots = simhash.components(alike.unionByName(links(docs))).select(F.col("node").alias("text_hash"), F.col("root").alias("near"))
    rooted = texts.join(roots, "text_hash", "left").withColumn("near", F.coalesce("near", "text_hash"))
    kept = rooted.groupBy("near").agg(F.min("first").alias("first")).select("first.doc_id", "first.text_hash")
    return shared.chosen_rows(docs, shared.written(kept, "near-kept"), once=True)
