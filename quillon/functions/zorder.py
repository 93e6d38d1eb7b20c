"""Space-filling curves as column expressions, and tables sorted along them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 16


def scaled(df: DataFrame, columns: Sequence[str], bits: int = BITS) -> DataFrame:
    """Adds __0, __1, ...: the columns' places from 0 to 2^bits - 1 between their least and largest values; null: 0."""
    ends = df.agg(*(f(F.col(c).cast("double")).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("lo", F.min), ("hi", F.max)))).first()
    for i, c in enumerate(columns):
        lo, hi = ends[f"lo{i}"] or 0.0, ends[f"hi{i}"] or 0.0
        place = (F.col(c).cast("double") - lo) / (hi - lo) * ((1 << bits) - 1) if hi > lo else F.lit(0.0)
        df = df.withColumn(f"__{i}", F.coalesce(F.floor(place), F.lit(0)).cast("long"))
    return df


def morton(places: Sequence[Column], bits: int = BITS) -> Column:
    """The bits of all places in turn, highest first."""
    out, d = F.lit(0).cast("long"), len(places)
    for b in range(min(bits, 63 // d)):
        for i, p in enumerate(places):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(p, b).bitwiseAND(F.lit(1).cast("long")), b * d + d - 1 - i))
    return out


def hilbert_index(x: np.ndarray, y: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places along the Hilbert curve of a square of side 2^bits."""
    x, y = x.astype(np.int64).copy(), y.astype(np.int64).copy()
    out = np.zeros(len(x), np.int64)
    s = 1 << (bits - 1)
    while s:
        rx, ry = (x & s) > 0, (y & s) > 0
        out += s * s * ((3 * rx) ^ ry)
        turn = ~ry
        flip = turn & rx
        x[flip], y[flip] = s - 1 - (x[flip] & (s - 1)), s - 1 - (y[flip] & (s - 1))
        x[turn], y[turn] = y[turn], x[turn].copy()
        s >>= 1
    return out


def hilbert(x: Column, y: Column) -> Column:
    @F.pandas_udf("long")
    def place(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(a.to_numpy(), b.to_numpy()))

    return place(x, y)


def clustered(df: DataFrame, how: str | Sequence[str], columns: Sequence[str] = ()) -> DataFrame:
    """df range-partitioned and sorted along a curve over the columns (``zorder``, ``hilbert``), or by columns."""
    if how not in ("zorder", "hilbert"):
        by = [how] if isinstance(how, str) else list(how)
        return df.repartitionByRange(*by).sortWithinPartitions(*by)
    if how == "hilbert" and len(columns) != 2:
        raise ValueError("the Hilbert curve is over two columns")
    places = [F.col(f"__{i}") for i in range(len(columns))]
    out = scaled(df, columns).withColumn("__curve", morton(places) if how == "zorder" else hilbert(*places))
    return out.repartitionByRange("__curve").sortWithinPartitions("__curve").drop("__curve", *(f"__{i}" for i in range(len(columns))))
