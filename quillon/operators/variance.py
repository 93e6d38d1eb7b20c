"""Variance decomposition into a technical trend and the rest, for all samples or by block."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.functions import kernels as K
from quillon.functions.trend import NONE, Trend, fit_trend_cv2, fit_trend_var, poisson_means, poisson_moments
from quillon.operators import normalize
from quillon.operators.linear import residual_variance
from quillon.operators.markers import bh, capped
from quillon.operators.moments import moments
from quillon.plans.matrix import SparseMatrix
from quillon.sources import files

#: Size factors for which counts are simulated in one task.
GROUP = 10_000


def _fits(stats: DataFrame, blocked: bool, fit) -> dict:
    """A trend for each block (None: all), fitted on all its features: blocks are fitted in parallel, each from two numbers for a feature;
    the knots are collected."""
    rows = stats.where("n >= 2").select(*["block"] * blocked, "mean", "var")
    if not blocked:
        local = rows.toPandas().sort_values(["mean", "var"])
        return {None: fit(local["mean"].to_numpy(float), local["var"].to_numpy(float)) if len(local) else NONE}

    def one(own: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["mean", "var"])
        t = fit(own["mean"].to_numpy(float), own["var"].to_numpy(float))
        return pd.DataFrame({"block": own["block"].iloc[:1], "knots": [t.knots.tolist()], "values": [t.values.tolist()], "std_dev": [t.std_dev]})

    schema = f"block {stats.schema['block'].dataType.simpleString()}, knots array<double>, values array<double>, std_dev double"
    return {r["block"]: Trend(np.array(r["knots"], float), np.array(r["values"], float), r["std_dev"]) for r in rows.groupBy("block").applyInPandas(one, schema).collect()}


def _decomposed(stats: DataFrame, fits: dict, blocked: bool, ratio: bool) -> DataFrame:
    """Adds trend and log_p; rows of blocks without a trend drop out."""
    schema = "feature {f}, {b}n long, mean double, total double, trend double, log_p double".format(f=stats.schema["feature"].dataType.simpleString(), b=f"block {stats.schema['block'].dataType.simpleString()}, " * blocked if blocked else "")

    def run(batches):
        for b in batches:
            out = []
            for key, own in b.groupby("block", dropna=False) if blocked else [(None, b)]:
                fit: Trend = fits.get(key, NONE)
                if not len(fit.knots):
                    continue
                mean, total = own["mean"].to_numpy(float), own["total"].to_numpy(float)
                trend = fit(mean)
                with np.errstate(divide="ignore", invalid="ignore"):
                    z = ((total / trend - 1) if ratio else (total - trend) / trend) / fit.std_dev
                good = np.isfinite(z)
                log_p = np.full(len(own), np.nan)
                log_p[good] = K.log_pnorm(z[good], upper=True)
                out.append(own.assign(trend=trend, log_p=pd.array(np.where(good, log_p, np.nan))))
            if out:
                yield pd.concat(out)[[c.split(" ")[0] for c in schema.split(", ")]]

    columns = ["feature", *["block"] * blocked, "n", "mean", "total"]
    done = stats.where("n >= 2").select(*columns).mapInPandas(run, schema)
    return done.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in ("mean", "total", "trend", "log_p")})


def _over_blocks(done: DataFrame, blocked: bool, equiweight: bool, method: str, geometric: bool) -> DataFrame:
    """Averages over blocks and combined p-values."""
    if not blocked:
        return done
    w = F.lit(1.0) if equiweight else F.col("n").cast("double")

    def mean(c: str):
        x = F.ln(F.when(F.col(c) > 0, F.col(c))) if geometric else F.col(c)
        got = F.try_divide(F.sum(w * x), F.sum(F.when(x.isNotNull(), w)))
        return (F.exp(got) if geometric else got).alias(c)

    z = K.normal_quantile(F.col("log_p"))
    done = done.withColumn("z", z if method == "stouffer" else F.lit(0.0))
    got = done.groupBy("feature").agg(*(mean(c) for c in ("mean", "total", "trend")), F.sum("log_p").alias("s"), F.count("log_p").alias("k"), F.try_divide(F.sum(w * F.col("z")), F.sqrt(F.sum(F.when(F.col("log_p").isNotNull(), w * w)))).alias("z"), F.min("log_p").alias("least"))
    combined = {"fisher": K.fisher_log_p(F.col("s"), F.when(F.col("k") > 0, F.col("k"))), "stouffer": K.normal_left(F.col("z")), "bonferroni": capped(F.col("least") + F.ln(F.when(F.col("k") > 0, F.col("k"))))}
    if method not in combined:
        raise ValueError(f"no method {method!r}")
    return got.withColumn("log_p", combined[method]).select("feature", "mean", "total", "trend", "log_p")


def _finished(done: DataFrame, ratio: bool) -> DataFrame:
    done = bh(done, [], "log_p", "log_fdr")
    last = [F.col("trend"), F.try_divide("total", "trend").alias("ratio")] if ratio else [F.col("trend").alias("tech"), (F.col("total") - F.col("trend")).alias("bio")]
    return done.select("feature", "mean", "total", *last, F.exp("log_p").alias("p_value"), F.exp("log_fdr").alias("fdr"))


def _stats(m: SparseMatrix, blocks: DataFrame | None, design: DataFrame | None = None) -> DataFrame:
    """Means and variances, computed once."""
    if design is not None:
        if blocks is not None:
            raise ValueError("blocks and a design can't be used together")
        return files.written(residual_variance(m, design), "variance")
    return files.written(moments(m, None if blocks is None else blocks.select("sample", "block")), "variance")


def model_gene_var(m: SparseMatrix, blocks: DataFrame | None = None, subset_fit=None, equiweight: bool = True, method: str = "fisher", design: DataFrame | None = None) -> DataFrame:
    """(feature, mean, total, tech, bio, p_value, fdr) of log values: the trend of variance over mean, fitted on subset_fit. With design
    (sample, then numbers) variances are those left by a linear fit of its columns."""
    stats = _stats(m, blocks, design)
    fits = _fits(stats if subset_fit is None else _stats(m.subset(features=subset_fit), blocks, design), blocks is not None, fit_trend_var)
    done = _decomposed(stats.withColumnRenamed("var", "total"), fits, blocks is not None, False)
    return _finished(_over_blocks(done, blocks is not None, equiweight, method, False), False)


def _simulated(factors: DataFrame, means: np.ndarray, points: int, dispersion: float, pseudo_count: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and variances of log values of simulated counts: at each point one count for every size factor. Groups of about
    GROUP factors are simulated in parallel and their moments merged; groups go by hashes, so partitions don't matter."""
    mu = poisson_means(means, points, pseudo_count)
    if not len(mu):
        return mu, mu
    groups = -(-factors.count() // GROUP)

    def run(key, rows):
        sf = rows.sort_values(["hash", "size_factor"])["size_factor"].to_numpy(float)
        mean, m2 = poisson_moments(mu, sf, dispersion, pseudo_count, [seed, int(key[0])])
        return pd.DataFrame({"point": np.arange(len(mu)), "n": float(len(sf)), "mean": mean, "m2": m2})

    dealt = factors.select(F.xxhash64("sample").alias("hash"), "size_factor").withColumn("group", F.pmod("hash", F.lit(max(groups, 1))))
    parts = dealt.groupBy("group").applyInPandas(run, "point int, n double, mean double, m2 double")
    n, s = F.sum("n"), F.sum(F.col("n") * F.col("mean"))
    total = parts.groupBy("point").agg(F.try_divide(F.sum("m2") + F.sum(F.col("n") * F.col("mean") * F.col("mean")) - s * s / n, n - 1).alias("var"))
    var = np.full(len(mu), np.nan)
    for r in total.where("var IS NOT NULL").collect():  # one row for each point
        var[r["point"]] = r["var"]
    return np.log2(mu + pseudo_count), var


def model_gene_var_by_poisson(m: SparseMatrix, size_factors: DataFrame | None = None, blocks: DataFrame | None = None, points: int = 1000, dispersion: float = 0.0, pseudo_count: float = 1.0, equiweight: bool = True, method: str = "fisher", seed: int = 1, design: DataFrame | None = None) -> DataFrame:
    """As model_gene_var(), of counts: they are log-normalised, and the trend is that of simulated Poisson (or, with a
    dispersion, negative binomial) counts, one for all blocks. Size factors are centred for both."""
    factors = normalize.library_size_factors(m) if size_factors is None else normalize.centred(size_factors)
    stats = _stats(normalize.normalized(m, factors, pseudo_count=pseudo_count, center=False), blocks, design)
    ends = stats.where("mean > 0").agg(F.min("mean").alias("low"), F.max("mean").alias("high")).first()
    means = np.array([x for x in ends if x is not None], float)
    fit = fit_trend_var(*_simulated(factors.where("size_factor > 0"), means, points, dispersion, pseudo_count, seed), min_mean=0.0)
    blocked = blocks is not None
    fits = {b: fit for b in ([r["block"] for r in stats.select("block").distinct().collect()] if blocked else [None])}
    done = _decomposed(stats.withColumnRenamed("var", "total"), fits, blocked, False)
    return _finished(_over_blocks(done, blocked, equiweight, method, False), False)


def cv2(stats: DataFrame) -> DataFrame:
    """Adds total: the squared coefficient of variation."""
    return stats.withColumn("total", F.try_divide(F.col("var"), F.col("mean") * F.col("mean")))


def model_gene_cv2(m: SparseMatrix, size_factors: DataFrame | None = None, blocks: DataFrame | None = None, subset_fit=None, equiweight: bool = True, method: str = "fisher") -> DataFrame:
    """(feature, mean, total, trend, ratio, p_value, fdr) of counts over centred size factors. Blocks combine geometrically."""
    y = normalize.normalized(m, size_factors, log_transform=False)
    stats = cv2(_stats(y, blocks))
    chosen = stats if subset_fit is None else cv2(_stats(y.subset(features=subset_fit), blocks))
    fits = _fits(chosen.select(*[c for c in chosen.columns if c not in ("var", "total")], F.col("total").alias("var")), blocks is not None, fit_trend_cv2)
    done = _decomposed(stats, fits, blocks is not None, True)
    return _finished(_over_blocks(done, blocks is not None, equiweight, method, True), True)


def top_variable(decomposed: DataFrame, n: int) -> DataFrame:
    """The n features with the most biological variance."""
    return decomposed.orderBy(F.col("bio").desc_nulls_last(), "feature").limit(n).select("feature")
