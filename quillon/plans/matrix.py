"""The sparse matrix: stored cells in long form, the universes of both axes, and the value of all other cells."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace
from functools import cached_property

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Samples in a block of a dense matrix.
BLOCK = 4096
#: Samples whose groups are sent to every executor.
SENT = 500_000
#: Cells that a driver takes.
REALIZED = 10_000_000


@dataclass(frozen=True)
class SparseMatrix:
    """cells: (feature, sample, value), each cell at most once. features, samples: one row per key, first column the key.
    fill: the value of cells that aren't stored."""

    cells: DataFrame
    features: DataFrame
    samples: DataFrame
    fill: float = 0.0

    @staticmethod
    def attach(df: DataFrame, features: DataFrame, samples: DataFrame, feature: str, sample: str, value: str, fill: float = 0.0) -> SparseMatrix:
        """A matrix over an existing table; columns are renamed, nothing is copied."""
        cells = df.select(F.col(feature).alias("feature"), F.col(sample).alias("sample"), F.col(value).alias("value"))
        return SparseMatrix(cells, _keyed(features, "feature"), _keyed(samples, "sample"), fill)

    @property
    def spark(self) -> SparkSession:
        return self.cells.sparkSession

    @cached_property
    def n_features(self) -> int:
        return self.features.count()

    @cached_property
    def n_samples(self) -> int:
        return self.samples.count()

    def subset(self, features: DataFrame | Iterable | Column | None = None, samples: DataFrame | Iterable | Column | None = None) -> SparseMatrix:
        """Only the chosen keys: a frame whose first column has them, a list, or a condition on the dimension table."""
        out = self
        for axis, chosen in (("feature", features), ("sample", samples)):
            if chosen is None:
                continue
            dim = getattr(out, f"{axis}s")
            if isinstance(chosen, Column):
                keys = dim.where(chosen).select(axis)
            elif isinstance(chosen, DataFrame):
                keys = chosen.select(chosen[chosen.columns[0]].alias(axis)).distinct()
            else:
                wanted = sorted(set(chosen))
                keys = out.spark.createDataFrame([(k,) for k in wanted], f"{axis} {dim.schema[axis].dataType.simpleString()}")
                if missing := keys.join(dim, axis, "left_anti").take(1):
                    raise KeyError(f"no {axis} {missing[0][0]!r}")
            out = replace(out, cells=out.cells.join(keys, axis, "left_semi"), **{f"{axis}s": dim.join(keys, axis, "left_semi")})
        return out

    def transpose(self) -> SparseMatrix:
        cells = self.cells.select(F.col("sample").alias("feature"), F.col("feature").alias("sample"), "value")
        return SparseMatrix(cells, self.samples.withColumnRenamed("sample", "feature"), self.features.withColumnRenamed("feature", "sample"), self.fill)

    def map(self, f: Callable[[Column], Column], filled: float) -> SparseMatrix:
        """f of every cell; filled: f of the fill value."""
        return replace(self, cells=self.cells.withColumn("value", f(F.col("value"))), fill=filled)

    def dense(self) -> DataFrame:
        """Every cell of the universe, stored or not: (feature, sample, value). As large as the product of both axes, but only the
        stored cells are shuffled: the others are listed for each feature and block of samples, by what is left of the block's keys."""
        block = F.pmod(F.xxhash64("sample"), F.lit(-(-max(self.n_samples, 1) // BLOCK))).alias("block")
        features, samples = self.features.select("feature"), self.samples.select("sample")
        keys = samples.groupBy(block).agg(F.collect_list("sample").alias("keys"))
        cells = self.cells.join(features, "feature", "left_semi").join(samples, "sample", "left_semi").select(*(F.col(c).cast(getattr(self, f"{c}s").schema[c].dataType).alias(c) for c in ("feature", "sample")), F.coalesce("value", F.lit(self.fill)).alias("value"))
        stored = cells.groupBy("feature", block).agg(F.collect_list("sample").alias("stored"))
        tiles = features.crossJoin(F.broadcast(keys.select("block"))).join(stored, ["feature", "block"], "left").join(F.broadcast(keys), "block")
        left = F.when(F.col("stored").isNull(), F.col("keys")).otherwise(F.array_except("keys", "stored"))
        return cells.unionAll(tiles.select("feature", F.explode(left).alias("sample")).select("feature", "sample", F.lit(self.fill).alias("value")))

    def realized(self, limit: int = REALIZED) -> pd.DataFrame:
        """The whole matrix on the driver, features by samples in the order of their keys; an error if it has more cells than limit."""
        if (size := self.n_features * self.n_samples) > limit:
            raise ValueError(f"the matrix has {size} cells, more than {limit}")
        wide = self.dense().toPandas().pivot(index="feature", columns="sample", values="value")
        return wide.sort_index(axis=0).sort_index(axis=1)

    def beside(self, groups: DataFrame) -> DataFrame:
        """The stored cells with the columns of groups (sample, ...); unless there are very many samples, no cell moves for it."""
        return self.cells.join(F.broadcast(groups) if self.n_samples <= SENT else groups, "sample")

    def in_order(self, frame: DataFrame, axis: str = "feature", index: str = "__index__") -> DataFrame:
        """A result sorted as the axis: by the row numbers of its table if it has them, else by key; further columns break ties."""
        dim = getattr(self, f"{axis}s")
        rest = [F.col(f"`{c}`") for c, t in frame.dtypes if c != axis and t.split("<")[0] not in ("map", "array", "struct")]
        if index not in dim.columns:
            return frame.orderBy(axis, *rest)
        return frame.join(dim.select(axis, F.col(index).alias("__place")), axis).orderBy("__place", *rest).select(*frame.columns)

    def sums(self, axis: str = "feature") -> DataFrame:
        """(key, sum, mean) for each key of the axis."""
        n = self.n_samples if axis == "feature" else self.n_features
        got = self.cells.groupBy(axis).agg(F.sum("value").alias("s"), F.count("*").alias("k"))
        total = (F.coalesce("s", F.lit(0.0)) + self.fill * (n - F.coalesce("k", F.lit(0)))).cast("double")
        return getattr(self, f"{axis}s").select(axis).join(got, axis, "left").select(axis, total.alias("sum"), (total / F.lit(float(n)) if n else F.lit(None).cast("double")).alias("mean"))


def _keyed(dim: DataFrame, name: str) -> DataFrame:
    first, *rest = dim.columns
    return dim.select(dim[first].alias(name), *(dim[c] for c in rest))


def detected(value: Column, threshold: float) -> Column:
    """At threshold 0 any value but 0 counts, also a negative one; else values above the threshold."""
    return value != 0 if threshold == 0 else value > threshold


def one_row(df: DataFrame, frame: DataFrame) -> DataFrame:
    """df with the columns of a frame of one row."""
    return df.crossJoin(frame)
