"""Mean-variance trends, fitted in numpy on one row for each feature.

The published recipe: leave out low means, fit a parametric curve v = a m / (m^n + b) by weighted least squares on the log
scale, smooth the log residuals by local linear regression, and scale the result so that the median ratio of observed to
fitted variance is 1. The spread of those ratios (from their median absolute deviation) scales p-values.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Trend:
    """A piecewise linear trend: values at knots, proportional to the mean below the first, constant beyond the last."""

    knots: np.ndarray
    values: np.ndarray
    std_dev: float

    def __call__(self, mean: np.ndarray) -> np.ndarray:
        mean = np.asarray(mean, float)
        if not len(self.knots):
            return np.full_like(mean, np.nan)
        low = mean < self.knots[0]
        return np.where(low, mean / self.knots[0] * self.values[0] if self.knots[0] else self.values[0], np.interp(mean, self.knots, self.values))


NONE = Trend(np.zeros(0), np.zeros(0), float("nan"))


def density_weights(x: np.ndarray, bins: int = 64) -> np.ndarray:
    """The inverse of how many points are near, so that crowded means don't rule the fit."""
    counts, edges = np.histogram(x, bins)
    smooth = np.convolve(counts, [0.25, 0.5, 0.25], "same")
    return 1 / np.maximum(smooth[np.clip(np.searchsorted(edges, x, side="right") - 1, 0, bins - 1)], 1)


def local_linear(x: np.ndarray, y: np.ndarray, w: np.ndarray, at: np.ndarray, span: float = 0.3) -> np.ndarray:
    """Tricube-weighted local lines through the nearest span of points, at the given places. x is sorted."""
    k = max(3, min(len(x), int(span * len(x))))
    out = np.empty(len(at))
    for i, c in enumerate(at):
        lo = int(np.clip(np.searchsorted(x, c) - k // 2, 0, len(x) - k))
        while lo + k < len(x) and x[lo + k] - c < c - x[lo]:
            lo += 1
        xs, ys = x[lo : lo + k], y[lo : lo + k]
        far = max(np.abs(xs - c).max(), 1e-12)
        weight = w[lo : lo + k] * (1 - np.minimum(np.abs(xs - c) / (1.0001 * far), 1) ** 3) ** 3
        total = weight.sum()
        mx, my = (weight * xs).sum() / total, (weight * ys).sum() / total
        sxx = (weight * (xs - mx) ** 2).sum()
        out[i] = my + ((weight * (xs - mx) * (ys - my)).sum() / sxx * (c - mx) if sxx > 1e-12 else 0.0)
    return out


def _parametric(m: np.ndarray, v: np.ndarray, w: np.ndarray) -> tuple[float, float, float]:
    """a, b, n of a m / (m^n + b): a grid over n and b, where log a is a weighted mean, refined three times."""
    lm, lv = np.log(m), np.log(v)
    n_grid, b_grid = np.linspace(1, 4, 13), np.linspace(-4, 6, 21)
    for _ in range(4):
        best = min(((w * (r := lv - lm + np.log(np.exp(n * lm) + np.exp(b)) - (mean := (w * (lv - lm + np.log(np.exp(n * lm) + np.exp(b)))).sum() / w.sum())) ** 2).sum(), n, b, mean) for n in n_grid for b in b_grid)
        _, n, b, mean = best
        dn, db = n_grid[1] - n_grid[0], b_grid[1] - b_grid[0]
        n_grid, b_grid = np.linspace(max(1, n - dn), n + dn, 7), np.linspace(b - db, b + db, 7)
    return float(np.exp(mean)), float(np.exp(b)), float(n)


def fit_trend_var(mean: np.ndarray, var: np.ndarray, min_mean: float = 0.1, knots: int = 128) -> Trend:
    """A trend of variances over means of log values."""
    mean, var = np.asarray(mean, float), np.asarray(var, float)
    ok = np.isfinite(mean) & np.isfinite(var) & (var > 1e-8) & (mean >= min_mean)
    if ok.sum() < 4:
        ok = np.isfinite(mean) & np.isfinite(var) & (var > 1e-8) & (mean > 0)
    if ok.sum() < 2:
        return NONE
    order = np.argsort(mean[ok], kind="stable")
    m, v = mean[ok][order], var[ok][order]
    w = density_weights(m)
    a, b, n = _parametric(m, v, w)
    curve = lambda x: a * x / (x**n + b)
    at = np.unique(np.quantile(m, np.linspace(0, 1, min(knots, len(m)))))
    fitted = curve(at) * np.exp(local_linear(m, np.log(v) - np.log(curve(m)), w, at))
    rough = Trend(at, fitted, 1.0)
    scale = float(np.median(v / rough(m)))
    ratio = v / (rough(m) * scale)
    return Trend(at, fitted * scale, float(np.median(np.abs(ratio - 1)) * 1.4826) or 1e-8)


def fit_trend_cv2(mean: np.ndarray, cv2: np.ndarray, min_mean: float = 0.1, knots: int = 128) -> Trend:
    """A trend of squared coefficients of variation over means of values: 1/m and a constant by weighted least squares on the
    log scale, then the same smoothing."""
    mean, cv2 = np.asarray(mean, float), np.asarray(cv2, float)
    ok = np.isfinite(mean) & np.isfinite(cv2) & (cv2 > 1e-12) & (mean >= min_mean)
    if ok.sum() < 2:
        return NONE
    order = np.argsort(mean[ok], kind="stable")
    m, c = mean[ok][order], cv2[ok][order]
    lm, w = np.log(m), density_weights(np.log(m))
    best, grid = None, np.linspace(-12, 6, 73)
    for b in grid:
        base = np.logaddexp(-lm, b)
        a = (w * (np.log(c) - base)).sum() / w.sum()
        loss = (w * (np.log(c) - base - a) ** 2).sum()
        best = min(best or (loss, a, b), (loss, a, b))
    _, a, b = best
    curve = lambda x: np.logaddexp(-x, b) + a
    at = np.unique(np.quantile(lm, np.linspace(0, 1, min(knots, len(m)))))
    fitted = np.exp(curve(at) + local_linear(lm, np.log(c) - curve(lm), w, at))
    rough = Trend(np.exp(at), fitted, 1.0)
    scale = float(np.median(c / rough(m)))
    ratio = c / (rough(m) * scale)
    return Trend(np.exp(at), fitted * scale, float(np.median(np.abs(ratio - 1)) * 1.4826) or 1e-8)


def poisson_means(means: np.ndarray, points: int, pseudo_count: float) -> np.ndarray:
    """Log-spaced means of counts over the range of the given means of log values."""
    good = means[np.isfinite(means) & (means > 0)]
    if not len(good):
        return np.zeros(0)
    low, high = (float(np.clip(2.0**x - pseudo_count, 1e-8, 1e6)) for x in (good.min(), good.max()))
    return np.exp(np.linspace(np.log(low), np.log(high), points))


def poisson_moments(mu: np.ndarray, size_factors: np.ndarray, dispersion: float, pseudo_count: float, seed: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sum of squared deviations of log values of simulated counts, one for each size factor, at each mean."""
    rng = np.random.Generator(np.random.PCG64(seed))
    mean, m2 = np.empty(len(mu)), np.empty(len(mu))
    for i, x in enumerate(mu):
        rate = x * size_factors
        counts = rng.poisson(rate if dispersion <= 0 else rng.gamma(1 / dispersion, rate * dispersion))
        values = np.log2(counts / size_factors + pseudo_count)
        mean[i] = values.mean()
        m2[i] = ((values - mean[i]) ** 2).sum()
    return mean, m2
