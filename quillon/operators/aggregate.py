"""Sums and counts over sets of features, and statistics over groups of samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.qc import membership
from quillon.plans.matrix import SparseMatrix, detected

STATISTICS = ("sum", "mean", "num_detected", "prop_detected")


def _across_sets(m: SparseMatrix, sets, count: bool, average: bool, threshold: float) -> DataFrame:
    pairs = membership(m, sets, "feature").join(m.features.select("feature"), "feature", "left_semi")
    sizes = pairs.groupBy("set").agg(F.count("*").alias("size"))
    value = F.count_if(detected(F.col("value"), threshold)) if count else F.sum("value")
    got = m.cells.join(pairs, "feature").groupBy("set", "sample").agg(value.alias("x"), F.count("*").alias("k"))
    grid = sizes.crossJoin(m.samples.select("sample")).join(got, ["set", "sample"], "left")
    missing = F.col("size") - F.coalesce("k", F.lit(0))
    total = F.coalesce("x", F.lit(0)) + missing * (int(threshold < m.fill) if count else m.fill)
    return grid.select("set", "sample", (total / F.col("size") if average else total.cast("long" if count else "double")).alias("value"))


def sum_across_features(m: SparseMatrix, sets, average: bool = False) -> DataFrame:
    """(set, sample, value): sum, or mean, of the features of each set. Sets may overlap; every pair has a row."""
    return _across_sets(m, sets, False, average, 0.0)


def detected_across_features(m: SparseMatrix, sets, average: bool = False, threshold: float = 0.0) -> DataFrame:
    """(set, sample, value): number, or share, of detected features of each set."""
    return _across_sets(m, sets, True, average, threshold)


def group_sizes(groups: DataFrame) -> DataFrame:
    return groups.where("group IS NOT NULL").groupBy("group").agg(F.count("*").alias("n"))


def summarize_by_group(m: SparseMatrix, groups: DataFrame, statistics: Sequence[str] = STATISTICS, threshold: float = 0.0) -> DataFrame:
    """(feature, group, ncells, statistics...) for every feature and used group. groups: (sample, group); null groups drop out."""
    if wrong := set(statistics) - set(STATISTICS):
        raise ValueError(f"no statistics {sorted(wrong)}")
    groups = groups.where("group IS NOT NULL").join(m.samples.select("sample"), "sample", "left_semi")
    sizes = groups.groupBy("group").agg(F.count("*").alias("n"))
    got = m.cells.join(groups, "sample").groupBy("feature", "group").agg(F.sum("value").alias("s"), F.count("*").alias("k"), F.count_if(detected(F.col("value"), threshold)).alias("d"))
    grid = m.features.select("feature").crossJoin(sizes).join(got, ["feature", "group"], "left")
    missing = F.col("n") - F.coalesce("k", F.lit(0))
    total = (F.coalesce("s", F.lit(0.0)) + missing * m.fill).cast("double")
    found = (F.coalesce("d", F.lit(0)) + missing * int(threshold < m.fill)).cast("long")
    made = {"sum": total, "mean": total / F.col("n"), "num_detected": found, "prop_detected": found / F.col("n")}
    return grid.select("feature", "group", F.col("n").alias("ncells"), *(made[s].alias(s) for s in statistics))


def to_wide(long: DataFrame, row: str, column: str, value: str, columns: Sequence | None = None, fill: float | None = None) -> DataFrame:
    """One column for each value of a key; give the values where they are known, to spare a pass."""
    wide = long.groupBy(row).pivot(column, list(columns) if columns else None).agg(F.first(value))
    return wide if fill is None else wide.na.fill(fill)
