"""Pearson correlations of pairs of features over all samples, from stored cells only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import kernels as K
from quillon.operators.markers import bh, capped
from quillon.plans.matrix import SparseMatrix

#: Features whose pairs are all computed without a choice of pairs.
MAX_FEATURES = 1000
#: Samples that are multiplied at a time, rows of a product in one record, and partial products that are added at a time.
SAMPLES, ROWS, FAN_IN = 2048, 64, 32


def _gram(k: int):
    """Partial X'X of the cells (at: place of the feature, sample, value) of a partition, sorted by sample; by blocks of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held = np.zeros((k, k)), None
        for b in batches:
            part = pa.Table.from_batches([b]) if held is None else pa.concat_tables([held, pa.Table.from_batches([b])])
            code = pc.dictionary_encode(part.column("sample").combine_chunks()).indices.to_numpy()  # in the order of the rows
            last = int(np.searchsorted(code, code[-1])) if len(code) else 0
            held = part.slice(last)  # its sample may go on
            add(total, part.slice(0, last), code[:last])
        if held is not None and held.num_rows:
            add(total, held, np.zeros(held.num_rows, np.int64))
        if total.any():
            blocks = range(0, k, ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int32()), pa.array([total[i : i + ROWS].tobytes() for i in blocks], pa.binary())], names=["block", "data"])

    def add(total: np.ndarray, part: pa.Table, code: np.ndarray) -> None:
        at, value = part.column("at").to_numpy(), part.column("value").to_numpy()
        for low in range(0, int(code[-1]) + 1 if len(code) else 0, SAMPLES):
            a, e = np.searchsorted(code, [low, low + SAMPLES])
            x = np.zeros((int(code[e - 1]) - low + 1, k))
            x[code[a:e] - low, at[a:e]] = value[a:e]
            total += x.T @ x

    return run


def _added(key: tuple, parts: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(d, float) for d in parts.column("data").to_pylist())
    return pa.table({"block": parts.column("block")[:1], "part": pa.array([key[1].as_py()], pa.int32()), "data": pa.array([total.tobytes()], pa.binary())})


def products(cells: DataFrame, features: DataFrame, n_features: int) -> DataFrame:
    """(f1, f2, p) with f1 < f2: sums of products over all samples. Each partition of samples makes one product of matrices; these are
    added in a tree, by blocks of rows."""
    spark = cells.sparkSession
    names = [r["feature"] for r in features.orderBy("feature").collect()]  # MAX_FEATURES at most
    places = spark.createDataFrame(list(enumerate(names)), f"at int, feature {features.schema['feature'].dataType.simpleString()}")
    dealt = cells.join(F.broadcast(places), "feature").select("at", "sample", "value").repartition("sample").sortWithinPartitions("sample")
    parts = dealt.mapInArrow(_gram(n_features), "block int, data binary").withColumn("part", F.spark_partition_id())
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    while True:
        parts = parts.withColumn("part", F.expr(f"cast(part div {FAN_IN} AS int)")).groupBy("block", "part").applyInArrow(_added, "block int, part int, data binary")
        n = -(-n // FAN_IN)
        if n == 1:
            break

    def cells_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, data in zip(b.column("block").to_pylist(), b.column("data").to_pylist(), strict=True):
                rows = np.frombuffer(data, float).reshape(-1, n_features)
                i, j = np.nonzero(np.arange(n_features) > np.arange(block, block + len(rows))[:, None])
                yield pa.RecordBatch.from_arrays([pa.array((i + block).astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(rows[i, j])], names=["a1", "a2", "p"])

    out = parts.select("block", "data").mapInArrow(cells_of, "a1 int, a2 int, p double")
    for k in (1, 2):
        out = out.join(F.broadcast(places.select(F.col("at").alias(f"a{k}"), F.col("feature").alias(f"f{k}"))), f"a{k}")
    return out.select("f1", "f2", "p")


def correlate_pairs(m: SparseMatrix, pairs: DataFrame | None = None, significance: bool = False, sorted_: bool = False) -> DataFrame:
    """(feature1, feature2, rho) for all pairs of features (feature1 < feature2), or for the given (feature1, feature2). Products
    meet by sample: only cells stored in both count, as the fill value must be 0. A feature without variance has a null rho.
    With significance also p_value (t-test of rho) and fdr. sorted_: by feature1, then feature2."""
    if m.fill != 0:
        raise ValueError("correlations need a fill value of 0")
    n, n_features = float(m.n_samples), m.n_features
    if n_features < 2:
        raise ValueError("correlations need two features")
    ids = m.features.select("feature")
    if pairs is None:
        if n_features > MAX_FEATURES:
            raise ValueError(f"choose pairs, or a subset of at most {MAX_FEATURES} features")
        wanted = ids.select(F.col("feature").alias("feature1")).crossJoin(ids.select(F.col("feature").alias("feature2"))).where("feature1 < feature2")
    else:
        a, b = pairs.columns[:2]
        wanted = pairs.select(pairs[a].alias("feature1"), pairs[b].alias("feature2")).distinct()
    value = F.col("value").cast("double")
    sums = ids.join(m.cells.groupBy("feature").agg(F.sum(value).alias("s"), F.sum(value * value).alias("q")), "feature", "left").select("feature", F.coalesce("s", F.lit(0.0)).alias("s"), F.coalesce("q", F.lit(0.0)).alias("q"))
    least, most = F.least("feature1", "feature2").alias("f1"), F.greatest("feature1", "feature2").alias("f2")
    cells = m.cells.select("feature", "sample", value.alias("value")).where("value != 0")
    if pairs is None:
        sums_of_products = products(cells, ids, n_features)
    else:
        asked = wanted.select(least, most).distinct()
        one = cells.select(F.col("feature").alias("f1"), "sample", F.col("value").alias("v1"))
        two = cells.select(F.col("feature").alias("f2"), "sample", F.col("value").alias("v2"))
        sums_of_products = asked.join(one, "f1").join(two, ["f2", "sample"]).groupBy("f1", "f2").agg(F.sum(F.col("v1") * F.col("v2")).alias("p"))
    out = wanted.withColumns({"f1": F.least("feature1", "feature2"), "f2": F.greatest("feature1", "feature2")}).join(sums_of_products, ["f1", "f2"], "left")
    for i in (1, 2):
        out = out.join(sums.select(F.col("feature").alias(f"feature{i}"), F.col("s").alias(f"s{i}"), F.col("q").alias(f"q{i}")), f"feature{i}")
    spread = (F.col("q1") - F.col("s1") * F.col("s1") / n) * (F.col("q2") - F.col("s2") * F.col("s2") / n)
    rho = F.when(spread > 0, (F.coalesce("p", F.lit(0.0)) - F.col("s1") * F.col("s2") / n) / F.sqrt(F.when(spread > 0, spread)))
    out = out.select("feature1", "feature2", rho.alias("rho"))
    if significance:
        t = F.col("rho") * F.sqrt(F.try_divide(F.lit(n - 2), F.greatest(1 - F.col("rho") * F.col("rho"), F.lit(1e-300))))
        out = out.withColumn("log_p", capped(K.t_left(-F.abs(t), F.when(F.lit(n) > 2, F.lit(n - 2))) + K.LN2))
        out = bh(out.withColumn("feature", F.struct("feature1", "feature2")), [], "log_p", "log_fdr").select("feature1", "feature2", "rho", F.exp("log_p").alias("p_value"), F.exp("log_fdr").alias("fdr"))
    return out.orderBy("feature1", "feature2") if sorted_ else out
