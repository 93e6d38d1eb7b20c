"""Least squares of every feature on a few columns of the samples, from sums over the stored cells alone.

With X the design and y a feature's values, X'X is summed once over the samples and X'y, y'y in one pass over the cells; cells of the
fill value come in by the sums of X. Coefficients and residuals are then expressions over these sums.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.plans.matrix import SparseMatrix


def least_squares(m: SparseMatrix, design: DataFrame) -> tuple[DataFrame, np.ndarray, int, int]:
    """(feature, coef, rss) of each feature on the columns of design (sample, then numbers), over the samples that it has; the inverse
    of X'X, the number of samples and the residual degrees of freedom. Columns that depend on each other are an error."""
    names = [c for c in design.columns if c != "sample"]
    x = [f"__x{k}" for k in range(len(names))]
    design = design.select("sample", *(F.col(f"`{c}`").cast("double").alias(n) for c, n in zip(names, x, strict=True))).dropna().join(m.samples.select("sample"), "sample", "left_semi")
    pairs = [(i, j) for i in range(len(x)) for j in range(i + 1)]
    sums = design.agg(F.count("*").alias("n"), *(F.sum(c).alias(f"s{k}") for k, c in enumerate(x)), *(F.sum(F.col(x[i]) * F.col(x[j])).alias(f"p{i}_{j}") for i, j in pairs)).first()
    n, gram = sums["n"], np.zeros((len(x), len(x)))
    for i, j in pairs:
        gram[i, j] = gram[j, i] = sums[f"p{i}_{j}"] or 0.0
    scale = np.sqrt(np.maximum(gram.diagonal(), 1e-300))
    if n <= len(x) or np.linalg.matrix_rank(gram / np.outer(scale, scale), tol=1e-10) < len(x):
        raise ValueError("the design needs independent columns, and more samples than columns")
    inverse = np.linalg.inv(gram / np.outer(scale, scale)) / np.outer(scale, scale)
    value = F.col("value").cast("double")
    got = m.cells.join(design, "sample").groupBy("feature").agg(*(F.sum((value - m.fill) * F.col(c)).alias(f"c{k}") for k, c in enumerate(x)), F.sum(value * value - m.fill * m.fill).alias("q"))
    got = m.features.select("feature").join(got, "feature", "left")
    cross = [F.coalesce(f"c{k}", F.lit(0.0)) + m.fill * float(sums[f"s{k}"]) for k in range(len(x))]
    coef = [sum((c * float(inverse[i, j]) for j, c in enumerate(cross)), F.lit(0.0)) for i in range(len(x))]
    got = got.select("feature", F.array(*cross).alias("cross"), F.array(*coef).alias("coef"), (F.coalesce("q", F.lit(0.0)) + n * m.fill * m.fill).alias("q"))
    fitted = F.aggregate(F.zip_with("cross", "coef", lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    return got.select("feature", "coef", F.greatest(F.col("q") - fitted, F.lit(0.0)).alias("rss")), inverse, n, n - len(x)


def residual_variance(m: SparseMatrix, design: DataFrame) -> DataFrame:
    """(feature, n, mean, var): the mean, and the variance of what is left after a least-squares fit of an intercept and the columns of
    design (sample, then numbers)."""
    names = [c for c in design.columns if c != "sample"]
    design = design.dropna()
    ends = design.agg(*(f(f"`{c}`").alias(f"{n}{k}") for k, c in enumerate(names) for n, f in (("lo", F.min), ("hi", F.max)))).first() if names else {}
    varying = [c for k, c in enumerate(names) if ends[f"lo{k}"] != ends[f"hi{k}"]]  # an intercept is there anyway
    fit, _, n, df = least_squares(m, design.select("sample", *(f"`{c}`" for c in varying)).withColumn("__one", F.lit(1.0)))
    value = F.col("value").cast("double")
    total = m.cells.join(design.select("sample"), "sample", "left_semi").groupBy("feature").agg(F.sum(value - m.fill).alias("s"))
    return fit.join(total, "feature", "left").select("feature", F.lit(n).cast("long").alias("n"), (F.coalesce("s", F.lit(0.0)) / n + m.fill).alias("mean"), (F.col("rss") / df).alias("var"))
