"""Size factors, normalised values and averages."""

from __future__ import annotations

from math import asinh, log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.matrix import SparseMatrix, one_row


def centred(factors: DataFrame) -> DataFrame:
    """(sample, size_factor) divided by the mean."""
    return one_row(factors, factors.agg(F.avg("size_factor").alias("__mean"))).select("sample", F.try_divide("size_factor", "__mean").alias("size_factor"))


def library_size_factors(m: SparseMatrix) -> DataFrame:
    """Sums of samples over their mean."""
    return centred(m.sums("sample").select("sample", F.col("sum").alias("size_factor")))


def geometric_size_factors(m: SparseMatrix, pseudo_count: float = 1.0) -> DataFrame:
    """Geometric means of value + pseudo_count over all features, over their mean."""
    logs = m.map(lambda v: F.log2(v + pseudo_count), log(m.fill + pseudo_count, 2)).sums("sample")
    return centred(logs.select("sample", F.pow(F.lit(2.0), "mean").alias("size_factor")))


def _scaled(m: SparseMatrix, factors: DataFrame) -> SparseMatrix:
    """Values over their sample's factor (null where that is 0). A fill value other than 0 needs factors that are all equal."""
    fill = 0.0
    if m.fill != 0:
        ends = factors.join(m.samples.select("sample"), "sample", "left_semi").agg(F.min("size_factor").alias("low"), F.max("size_factor").alias("high"), F.count("size_factor").alias("n")).first()
        if not ends["n"] or ends["n"] < m.n_samples or ends["low"] <= 0 or ends["high"] - ends["low"] > 1e-12 * ends["high"]:
            raise ValueError("size factors that differ need a fill value of 0: other fill values would differ by sample")
        fill = m.fill / ends["low"]
    cells = m.beside(factors).select("feature", "sample", F.try_divide(F.col("value").cast("double"), F.col("size_factor")).alias("value"))
    return SparseMatrix(cells, m.features, m.samples, fill)


def normalized(m: SparseMatrix, size_factors: DataFrame | None = None, log_transform: bool = True, transform: str = "log", pseudo_count: float = 1.0, center: bool = True) -> SparseMatrix:
    """A lazy matrix of values over size factors: log2(y + pseudo_count), asinh(y) / ln 2, or y itself."""
    factors = library_size_factors(m) if size_factors is None else centred(size_factors) if center else size_factors
    y = _scaled(m, factors)
    if not log_transform or transform == "none":
        return y
    if transform == "asinh":
        return y.map(lambda v: F.asinh(v) / log(2), asinh(y.fill) / log(2))
    if transform != "log":
        raise ValueError(f"no transform {transform!r}")
    return y.map(lambda v: F.ln(v + pseudo_count) / log(2), log(y.fill + pseudo_count) / log(2))


def cpm(m: SparseMatrix, size_factors: DataFrame | None = None) -> SparseMatrix:
    """Counts per million of the sample's sum; with size factors, these take the place of sums, at the same mean."""
    sums = m.sums("sample").select("sample", (F.col("sum") / 1e6).alias("size_factor"))
    if size_factors is not None:
        sums = one_row(centred(size_factors), sums.agg(F.avg("size_factor").alias("__mean"))).select("sample", (F.col("size_factor") * F.col("__mean")).alias("size_factor"))
    return _scaled(m, sums)


def tpm(m: SparseMatrix, lengths: DataFrame, size_factors: DataFrame | None = None) -> SparseMatrix:
    """cpm() of values over the lengths (feature, length) of features."""
    cells = m.cells.join(lengths, "feature").select("feature", "sample", F.try_divide(F.col("value").cast("double"), F.col("length").cast("double")).alias("value"))
    return cpm(SparseMatrix(cells, m.features, m.samples, m.fill), size_factors)


def average(m: SparseMatrix, size_factors: DataFrame | None = None) -> DataFrame:
    """(feature, average): mean over samples of values over centred size factors."""
    factors = library_size_factors(m) if size_factors is None else centred(size_factors)
    return _scaled(m, factors).sums("feature").select("feature", F.col("mean").alias("average"))
