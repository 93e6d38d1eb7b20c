"""Means, variances and detection counts by feature and group, in one pass over the stored cells.

With n cells in a group, k of them stored with mean m and sum of squares M about it, and f = n - k cells of the fill
value, the mean is (k m + f fill) / n and the sum of squares M + k f / n (m - fill)^2: the pairwise merge of two samples.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators import normalize
from quillon.plans.matrix import SparseMatrix

#: Values above it are detected.
THRESHOLD = 1e-8


def moments(m: SparseMatrix, groups: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(feature, <keys>, n, mean, var, detected) for every feature and group. groups: (sample, key, ...): any further columns
    are keys, e.g. group and block; samples with a null key drop out. Without groups all samples are one. The variance
    of fewer than two cells is null."""
    keys = [c for c in groups.columns if c != "sample"] if groups is not None else []
    value = F.col("value").cast("double")
    aggs = [F.count("*").alias("k"), F.avg(value).alias("m"), F.var_pop(value).alias("v"), F.count_if(value > threshold).alias("d")]
    if keys:
        groups = groups.dropna(subset=keys).join(m.samples.select("sample"), "sample", "left_semi")
        sizes = groups.groupBy(*keys).agg(F.count("*").alias("n"))
        got = m.beside(groups).groupBy("feature", *keys).agg(*aggs)
        grid = m.features.select("feature").crossJoin(sizes).join(got, ["feature", *keys], "left")
    else:
        got = m.cells.groupBy("feature").agg(*aggs)
        grid = m.features.select("feature").withColumn("n", F.lit(m.n_samples).cast("long")).join(got, "feature", "left")
    n, k = F.col("n").cast("double"), F.coalesce("k", F.lit(0)).cast("double")
    mean, f = F.coalesce("m", F.lit(0.0)), n - k
    squares = F.coalesce("v", F.lit(0.0)) * k + F.try_divide(k * f, n) * F.pow(mean - m.fill, F.lit(2.0))
    return grid.select(
        "feature", *keys, "n",
        F.try_divide(k * mean + f * m.fill, n).alias("mean"),
        F.when(F.col("n") > 1, squares / (n - 1)).alias("var"),
        (F.coalesce("d", F.lit(0)) + (F.col("n") - F.coalesce("k", F.lit(0))) * int(m.fill > threshold)).alias("detected"),
    )


def normalized_moments(m: SparseMatrix, size_factors: DataFrame | None = None, blocks: DataFrame | None = None, pseudo_count: float | None = None) -> DataFrame:
    """moments() of values over centred size factors, or of their logarithm where a pseudo count is given."""
    y = normalize.normalized(m, size_factors, log_transform=pseudo_count is not None, pseudo_count=pseudo_count or 1.0)
    return moments(y, blocks)
