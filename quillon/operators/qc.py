"""Quality metrics of samples and of features, over stored cells only, with the rest completed from the fill value."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.plans.matrix import SparseMatrix, detected


def membership(m: SparseMatrix, sets: DataFrame | dict[str, Sequence], axis: str) -> DataFrame:
    """(set, key) pairs, each once: from a frame (set, key), or from named lists of keys. A key may be in several sets."""
    if isinstance(sets, DataFrame):
        name, key = sets.columns[:2]
        return sets.select(sets[name].cast("string").alias("set"), sets[key].alias(axis)).where("set IS NOT NULL").distinct()
    if not all(sets):
        raise ValueError("sets must be named")
    kind = getattr(m, f"{axis}s").schema[axis].dataType.simpleString()
    return m.spark.createDataFrame([(s, k) for s, keys in sets.items() for k in sorted(set(keys))], f"set string, {axis} {kind}")


def _completed(total: str, stored: str, n, fill: float) -> Column:
    return (F.coalesce(F.col(total), F.lit(0.0)) + F.lit(fill) * (n - F.coalesce(F.col(stored), F.lit(0)))).cast("double")


def _completed_count(count: str, stored: str, n, fill: float, threshold: float) -> Column:
    return (F.coalesce(F.col(count), F.lit(0)) + (n - F.coalesce(F.col(stored), F.lit(0))) * int(threshold < fill)).cast("long")


def _set_names(sets: DataFrame | dict, pairs: DataFrame) -> list[str]:
    return list(sets) if isinstance(sets, dict) else [r[0] for r in pairs.select("set").distinct().orderBy("set").collect()]


def _basics(m: SparseMatrix, axis: str, sets, threshold: float) -> tuple[DataFrame, list[str]]:
    """For each key of the axis: sum, detected, and for each set of keys of the other axis the same (columns by place of the set)."""
    other, n = ("feature", m.n_features) if axis == "sample" else ("sample", m.n_samples)
    hit = detected(F.col("value"), threshold)
    got = m.cells.groupBy(axis).agg(F.sum("value").alias("s"), F.count("*").alias("k"), F.count_if(hit).alias("d"))
    out = getattr(m, f"{axis}s").select(axis).join(got, axis, "left")
    out = out.select(axis, _completed("s", "k", n, m.fill).alias("sum"), _completed_count("d", "k", n, m.fill, threshold).alias("detected"))
    if not sets:
        return out, []
    pairs = membership(m, sets, other).join(getattr(m, f"{other}s").select(other), other, "left_semi")
    names = _set_names(sets, pairs)
    sizes = {r["set"]: r["count"] for r in pairs.groupBy("set").count().collect()}
    inside = m.cells.join(pairs, other)
    mine = [F.col("set") == s for s in names]
    aggs = [a for i, c in enumerate(mine) for a in (F.sum(F.when(c, F.col("value"))).alias(f"s{i}"), F.count_if(c).alias(f"k{i}"), F.count_if(c & hit).alias(f"d{i}"))]
    out = out.join(inside.groupBy(axis).agg(*aggs), axis, "left")
    for i, s in enumerate(names):
        size = sizes.get(s, 0)
        out = out.withColumn(f"sum{i}", _completed(f"s{i}", f"k{i}", size, m.fill)).withColumn(f"detected{i}", _completed_count(f"d{i}", f"k{i}", size, m.fill, threshold)).withColumn(f"size{i}", F.lit(size))
    return out, names


def nested(flat: DataFrame, key: str, names: Sequence[str], fields: Sequence[str], tops: Sequence[int] = ()) -> DataFrame:
    """The flat columns as structs: percent_top (a field for each number), subsets (a struct for each set)."""
    top = [F.struct(*(F.col(f"percent_top_{n}").alias(str(n)) for n in tops)).alias("percent_top")] if tops else []
    sets = [F.struct(*(F.struct(*(F.col(f"`subsets_{s}_{f}`").alias(f) for f in fields)).alias(s) for s in names)).alias("subsets")] if names else []
    return flat.select(key, *(c for c in flat.columns if c in ("sum", "mean", "detected")), *top, *sets)


def per_sample_qc(m: SparseMatrix, subsets=None, percent_top: Sequence[int] = (), threshold: float = 0.0, flatten: bool = True) -> DataFrame:
    """sample, sum, detected, percent_top_<n>, subsets_<set>_sum, _detected and _percent. Shares of a zero total are null. Without
    flatten: structs percent_top and subsets."""
    out, names = _basics(m, "sample", subsets, threshold)
    columns = [F.col("sample"), F.col("sum"), F.col("detected")]
    if tops := sorted(set(percent_top)):
        if m.fill != 0:
            raise ValueError("shares of the largest values need a fill value of 0")
        rank = F.row_number().over(Window.partitionBy("sample").orderBy(F.desc("value"), "feature"))
        top = m.cells.withColumn("rank", rank).where(F.col("rank") <= tops[-1])
        top = top.groupBy("sample").agg(*(F.sum(F.when(F.col("rank") <= n, F.col("value"))).alias(f"top{n}") for n in tops))
        out = out.join(top, "sample", "left")
        columns += [(F.try_divide(F.coalesce(f"top{n}", F.lit(0.0)), F.col("sum")) * 100).alias(f"percent_top_{n}") for n in tops]
    for i, s in enumerate(names):
        columns += [F.col(f"sum{i}").alias(f"subsets_{s}_sum"), F.col(f"detected{i}").alias(f"subsets_{s}_detected"), (F.try_divide(f"sum{i}", "sum") * 100).alias(f"subsets_{s}_percent")]
    out = out.select(*columns)
    return out if flatten else nested(out, "sample", names, ("sum", "detected", "percent"), tops)


def per_feature_qc(m: SparseMatrix, subsets=None, threshold: float = 0.0, flatten: bool = True) -> DataFrame:
    """feature, mean, detected (percent), and for each set of samples subsets_<set>_mean, _detected (percent) and _ratio. Without
    flatten: a struct subsets."""
    out, names = _basics(m, "feature", subsets, threshold)
    n = F.lit(float(m.n_samples))
    mean = F.try_divide(F.col("sum"), n)
    columns = [F.col("feature"), mean.alias("mean"), (F.try_divide(F.col("detected"), n) * 100).alias("detected")]
    for i, s in enumerate(names):
        own = F.try_divide(F.col(f"sum{i}"), F.col(f"size{i}").cast("double"))
        columns += [own.alias(f"subsets_{s}_mean"), (F.try_divide(F.col(f"detected{i}"), F.col(f"size{i}").cast("double")) * 100).alias(f"subsets_{s}_detected"), F.try_divide(own, mean).alias(f"subsets_{s}_ratio")]
    out = out.select(*columns)
    return out if flatten else nested(out, "feature", names, ("mean", "detected", "ratio"))
