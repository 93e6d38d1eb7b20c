import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillon.functions import kernels as K
from quillon.functions import trend, zorder
from quillon.functions.trend import fit_trend_cv2, fit_trend_var
from quillon.operators import aggregate, correlate, markers, moments, normalize, qc, variance
from quillon.plans.matrix import SparseMatrix

G, N = 12, 30


def dense(seed=1, fill=0.0):
    rng = np.random.default_rng(seed)
    x = rng.poisson(2.0, (G, N)).astype(float)
    x[3] = 0
    if fill:
        x[x == 0] = fill
    return x


def matrix(spark, x, fill=0.0):
    cells = [(int(i), int(j), float(x[i, j])) for i, j in itertools.product(range(G), range(N)) if x[i, j] != fill]
    return SparseMatrix(spark.createDataFrame(cells, "feature int, sample int, value double"), spark.range(G).select(F.col("id").cast("int").alias("feature")), spark.range(N).select(F.col("id").cast("int").alias("sample")), fill)


def groups(spark, labels=None):
    labels = [("a", "b", "c")[j % 3] for j in range(N)] if labels is None else labels
    return spark.createDataFrame(list(enumerate(labels)), "sample int, group string")


@pytest.mark.parametrize("fill", [0.0, 1.0, -2.0])
def test_fill_counts_in_every_statistic(spark, fill):
    x = dense(2, fill)
    m = matrix(spark, x, fill)
    got = {r["feature"]: r for r in qc.per_feature_qc(m, threshold=0.5).collect()}
    assert all(np.isclose(got[i]["mean"], x[i].mean()) and np.isclose(got[i]["detected"], 100 * (x[i] > 0.5).mean()) for i in range(G))
    got = {r["sample"]: r for r in qc.per_sample_qc(m, {"s": [0, 1, 5]}, threshold=0.5).collect()}
    assert all(np.isclose(got[j]["sum"], x[:, j].sum()) and np.isclose(got[j]["subsets_s_sum"], x[[0, 1, 5], j].sum()) and got[j]["subsets_s_detected"] == (x[[0, 1, 5], j] > 0.5).sum() for j in range(N))
    for r in moments.moments(m, groups(spark)).collect():
        own = x[r["feature"], [j for j in range(N) if ("a", "b", "c")[j % 3] == r["group"]]]
        assert np.isclose(r["mean"], own.mean()) and np.isclose(r["var"], own.var(ddof=1)) and r["detected"] == (own > 1e-8).sum()
    for r in aggregate.summarize_by_group(m, groups(spark)).collect():
        own = x[r["feature"], [j for j in range(N) if ("a", "b", "c")[j % 3] == r["group"]]]
        assert np.isclose(r["sum"], own.sum()) and r["ncells"] == len(own)
    for r in markers.exact_auc(m, groups(spark), lfc=0.5).collect():
        a, b = (x[r["feature"], [j for j in range(N) if ("a", "b", "c")[j % 3] == g]] for g in (r["first"], r["second"]))
        assert np.isclose(r["auc"], ((a[:, None] - 0.5 > b) + 0.5 * (a[:, None] - 0.5 == b)).mean())


def test_null_groups_small_groups_and_subsets(spark):
    x, labels = dense(), ["a"] * 10 + [None] * 10 + ["b"] * 9 + ["one"]
    m = matrix(spark, x)
    got = {(r["feature"], r["group"]): r for r in moments.moments(m, groups(spark, labels)).collect()}
    assert set(g for _, g in got) == {"a", "b", "one"} and got[0, "one"]["var"] is None and got[0, "one"]["n"] == 1
    sub = m.subset(features=[1, 2], samples=F.col("sample") < 5)
    assert sub.n_features == 2 and sub.n_samples == 5 and {r["feature"]: r["sum"] for r in sub.sums().collect()} == {i: x[i, :5].sum() for i in (1, 2)}
    with pytest.raises(KeyError):
        m.subset(features=[99])
    assert {r["feature"]: r["sum"] for r in m.transpose().sums().collect()} == {j: x[:, j].sum() for j in range(N)}
    with pytest.raises(ValueError):
        markers.chosen_groups(groups(spark, labels), restrict=["a"])


def test_normalisation(spark):
    x = dense() + np.eye(G, N)
    m = matrix(spark, x)
    sf = x.sum(axis=0) / x.sum(axis=0).mean()
    got = {(r["feature"], r["sample"]): r["value"] for r in normalize.normalized(m).dense().collect()}
    assert all(np.isclose(got[i, j], np.log2(x[i, j] / sf[j] + 1)) for i in range(G) for j in range(N))
    with pytest.raises(ValueError):
        normalize.normalized(matrix(spark, dense(1, 1.0), 1.0))
    with pytest.raises(ValueError):
        correlate.correlate_pairs(matrix(spark, dense(1, 1.0), 1.0))


def test_correlations(spark):
    x = dense()
    for r in correlate.correlate_pairs(matrix(spark, x), significance=True).collect():
        i, j = r["feature1"], r["feature2"]
        if 3 in (i, j):
            assert r["rho"] is None and r["p_value"] is None
        else:
            assert np.isclose(r["rho"], np.corrcoef(x[i], x[j])[0, 1], atol=1e-10) and 0 <= r["p_value"] <= 1


def test_kernels():
    assert np.isclose(np.exp(K.log_pt(np.array([2.0]), np.array([10.0])))[0], 0.9633059826)
    assert np.isclose(K.log_pt(np.array([-60.0]), np.array([9.0]))[0], -29.017, atol=1e-3)
    assert np.isclose(np.exp(K.log_pbinom(np.array([7]), np.array([25]), np.array([0.4])))[0], 0.1535517, atol=1e-7)
    z = np.array([-45.0, -8, -1, 0, 0.5, 4])
    assert np.allclose(K.log_qnorm(K.log_pnorm(z)), z, atol=1e-5)
    k = np.arange(0, 13)
    low, high = K.log_pbinom(k, 12, 0.3), K.log_pbinom(k + 1, 12, 0.3, upper=True)
    assert np.allclose(np.exp(low[:-1]) + np.exp(high[:-1]), 1)
    assert np.isclose(np.exp(K.fisher(np.log([0.005]), np.array([2])))[0], 0.005 * (1 - np.log(0.005)))


def test_blocked_tests_equal_plain_ones_for_one_block(spark):
    m, one = matrix(spark, dense()), spark.createDataFrame([(j, 0) for j in range(N)], "sample int, block int")
    for test in (markers.pairwise_t_tests, markers.pairwise_binom):
        a, b = ({(r["feature"], r["first"], r["second"]): r for r in test(m, groups(spark), blocks=x).collect()} for x in (None, one))
        assert set(a) == set(b)
        assert all((a[k]["p_value"] is None) == (b[k]["p_value"] is None) and (a[k]["p_value"] is None or np.isclose(a[k]["p_value"], b[k]["p_value"], atol=1e-6)) for k in a)


def test_groups_of_one_have_no_p_value(spark):
    m, g = matrix(spark, dense()), groups(spark, ["a"] * 20 + ["b"] * 9 + ["one"])
    for r in markers.pairwise_t_tests(m, g).collect():
        assert (r["p_value"] is None) == ("one" in (r["first"], r["second"]))


def test_directions_and_fold_changes(spark):
    m, g = matrix(spark, dense()), groups(spark)
    up, down, both = ({(r["feature"], r["first"], r["second"]): r["p_value"] for r in markers.pairwise_t_tests(m, g, direction=d).collect()} for d in ("up", "down", "any"))
    assert all(np.isclose(up[f, a, b], down[f, b, a]) and np.isclose(both[f, a, b], min(1, 2 * min(up[f, a, b], down[f, a, b]))) for f, a, b in up)
    strict = {(r["feature"], r["first"], r["second"]): r["p_value"] for r in markers.pairwise_t_tests(m, g, direction="up", lfc=1.0).collect()}
    assert all(strict[k] >= up[k] - 1e-12 for k in up)
    for test in ("t", "binom", "wilcox"):
        for kind in ("any", "some", "all"):
            p = [r["p_value"] for r in markers.find_markers(m, g, test, kind).collect()]
            assert len(p) == G * 3 and all(0 <= x <= 1 for x in p)
    with pytest.raises(ValueError):
        markers.with_row_data(markers.find_markers(m, g), spark.createDataFrame([(0, "x")], "feature int, note string"))


def test_approximate_auc_follows_the_exact_one(spark):
    m, g = matrix(spark, dense(5)), groups(spark)
    a, b = ({(r["feature"], r["first"], r["second"]): r["auc"] for r in markers.effects(m, g, true_auc=t).collect()} for t in (False, True))
    assert np.corrcoef([a[k] for k in a], [b[k] for k in a])[0, 1] > 0.8
    assert all(np.isclose(b[f, x, y] + b[f, y, x], 1) for f, x, y in b)


def test_trend_recovers_poisson_noise(spark):
    rng = np.random.default_rng(3)
    n, cells = 400, 200
    mu = np.exp(rng.uniform(-1, 3, n))
    x = rng.poisson(mu[:, None], (n, cells))
    logs = np.log2(x + 1)
    fit = trend.fit_trend_var(logs.mean(axis=1), logs.var(axis=1, ddof=1))
    ratio = logs.var(axis=1, ddof=1) / fit(logs.mean(axis=1))
    keep = logs.mean(axis=1) > 0.2
    assert 0.9 < np.median(ratio[keep]) < 1.1 and 0 < fit.std_dev < 0.5 and (fit(np.linspace(0, 5, 50)) >= 0).all()
    m = SparseMatrix(spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "feature int, sample int, value double"), spark.range(n).withColumnRenamed("id", "feature"), spark.range(cells).withColumnRenamed("id", "sample"))
    out = variance.model_gene_var_by_poisson(m, points=300).toPandas()
    assert len(out) == n and (out["p_value"] < 0.01).mean() < 0.2  # pure noise; simulated points stand at log2 of the mean, not at the mean of logs
    blocks = spark.createDataFrame([(j, j % 2) for j in range(cells)], "sample int, block int")
    for method in ("fisher", "stouffer", "bonferroni"):
        assert variance.model_gene_var(normalize.normalized(m), blocks, method=method).where("p_value IS NOT NULL").count() == n
    assert variance.model_gene_cv2(m, blocks=blocks).where("ratio > 0").count() > 0.9 * n


def test_curves():
    side = np.arange(16)
    x, y = (v.ravel() for v in np.meshgrid(side, side))
    order = np.argsort(zorder.hilbert_index(x, y, 4))
    assert (np.abs(np.diff(x[order])) + np.abs(np.diff(y[order])) == 1).all()  # each step goes to a neighbour


def test_scores_with_and_without_all_pairs(spark):
    m, g = matrix(spark, dense()), groups(spark)
    a = markers.score_markers(m, g, full_stats=True).toPandas().set_index(["group", "feature"])
    b = markers.score_markers(m, g, pairings=["a", "b", "c"]).toPandas().set_index(["group", "feature"]).loc[a.index]
    own = markers.summary_marker_stats(m, g).toPandas().set_index(["group", "feature"]).loc[a.index]
    middle = markers.summary_marker_stats(m, g, average="median").toPandas().set_index(["group", "feature"]).loc[a.index]
    for c in b.columns:
        assert np.allclose(a[c].astype(float), b[c].astype(float))
    for c in markers.SIDES:
        assert np.allclose(a[c], own[c]) and np.allclose(a[c], middle[c])  # two other groups: the median is the mean
    assert all(len(x) == 2 for x in a["full_auc"])
    blocks = spark.createDataFrame([(j, j % 2) for j in range(N)], "sample int, block int")
    c = markers.score_markers(m, g, blocks=blocks, true_auc=True).toPandas()
    assert len(c) == 3 * G and c["mean_auc"].between(0, 1).all()


def test_both_ways_to_the_exact_auc(spark, monkeypatch):
    for fill in (0.0, 1.0):
        m, g = matrix(spark, dense(4, fill), fill), groups(spark, ["a"] * 9 + ["b"] * 11 + [None] * 4 + ["c"] * 6)
        by_columns = sorted(map(tuple, markers.exact_auc(m, g, ties=True).collect()))
        with monkeypatch.context() as mp:
            mp.setattr(markers, "MAX_COLUMNS", 0)
            assert by_columns == sorted(map(tuple, markers.exact_auc(m, g, ties=True).collect()))


def test_poisson_trend_takes_every_size_factor(spark):
    ids = spark.range(12_000).select(F.col("id").alias("sample"))
    low = ids.orderBy(F.xxhash64("sample").desc()).limit(2000).withColumn("size_factor", F.lit(0.01))  # a sample by hash would leave them out
    factors = ids.join(low, "sample", "left").fillna(1.0, "size_factor").localCheckpoint()
    cells = ids.crossJoin(spark.range(4).select(F.col("id").alias("feature"))).withColumn("value", (F.col("feature") * 10 + 1 + F.col("sample") % 3).cast("double"))
    m = SparseMatrix.attach(cells, cells.select("feature").distinct(), ids, "feature", "sample", "value")
    out = variance.model_gene_var_by_poisson(m, factors, points=40).toPandas()
    sf = factors.toPandas()["size_factor"].to_numpy()
    sf = sf / sf.mean()
    r = np.random.default_rng(5)
    for mean, tech in zip(out["mean"], out["tech"]):
        want = np.log2(r.poisson((2.0**mean - 1) * sf) / sf + 1).var(ddof=1)
        assert abs(tech / want - 1) < 0.35, (mean, tech, want)


@pytest.mark.parametrize("fit", [trend.fit_trend_var, trend.fit_trend_cv2])
def test_trends_are_fitted_on_all_features(spark, fit):
    mean = F.col("id") % 997 / 125 + 0.2
    var = F.col("mean") * (1 + F.col("id") % 13 / 10) * F.when(F.xxhash64("id") > (1 << 62), 3).otherwise(1)  # a sample by hash would leave these out
    stats = spark.range(140_000).withColumn("mean", mean).select(F.col("id").alias("feature"), F.lit(10).alias("n"), "mean", var.alias("var")).localCheckpoint()
    rows = stats.toPandas()
    (got,) = variance._fits(stats, False, fit).values()
    want = fit(rows["mean"], rows["var"])
    assert len(got.knots) == len(want.knots) and np.allclose(got.values, want.values) and np.isclose(got.std_dev, want.std_dev)


def test_variance_models_against_the_dense_matrix(spark):
    """Moments, spread, tails, adjustment and blocks worked out again; the trend itself is the same function of the same numbers."""
    rng = np.random.default_rng(4)
    dense = np.log2(rng.poisson(rng.gamma(2, 2, 120)[:, None] * rng.uniform(0.5, 2, 40)[None, :]) + 1.0)
    cells = spark.createDataFrame([(int(i), int(j), float(dense[i, j])) for i, j in zip(*np.nonzero(dense))], "feature long, sample long, value double")
    m = SparseMatrix(cells, spark.range(120).toDF("feature"), spark.range(40).toDF("sample"))
    upper = np.vectorize(lambda z: 0.5 * math.erfc(z / math.sqrt(2)))

    def adjusted(p):
        order = np.argsort(p, kind="stable")
        out = np.empty(len(p))
        out[order] = np.minimum.accumulate((p[order] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1]
        return np.minimum(out, 1)

    def one(x, fit, ratio):
        mean, var = x.mean(axis=1), x.var(axis=1, ddof=1)
        total = var / mean**2 if ratio else var
        order = np.lexsort((total, mean))
        t = fit(mean[order], total[order])
        z = (total / t(mean) - 1) / t.std_dev if ratio else (total - t(mean)) / t(mean) / t.std_dev
        return mean, total, t(mean), upper(z)

    got = variance.model_gene_var(m).toPandas().sort_values("feature")
    mean, total, trend, p = one(dense, fit_trend_var, False)
    for c, want in (("mean", mean), ("total", total), ("tech", trend), ("bio", total - trend), ("p_value", p), ("fdr", adjusted(p))):
        assert np.allclose(got[c], want, atol=1e-8), c
    blocks = spark.range(40).select(F.col("id").alias("sample"), (F.col("id") % 2).alias("block"))
    got = variance.model_gene_var(m, blocks).toPandas().sort_values("feature")
    parts = [one(dense[:, k::2], fit_trend_var, False) for k in range(2)]
    mean, total, trend = (np.mean([q[k] for q in parts], axis=0) for k in range(3))
    x = -np.log(parts[0][3]) - np.log(parts[1][3])
    p = np.exp(-x) * (1 + x)  # the tail of chi-squared with four degrees of freedom
    for c, want in (("mean", mean), ("total", total), ("tech", trend), ("p_value", p), ("fdr", adjusted(p))):
        assert np.allclose(got[c], want, atol=1e-8), c
    counts = np.exp2(dense) - 1
    cv = SparseMatrix(cells.withColumn("value", F.pow(F.lit(2.0), "value") - 1), m.features, m.samples)
    got = variance.model_gene_cv2(cv).toPandas().sort_values("feature")
    scaled = counts / (counts.sum(axis=0) / counts.sum(axis=0).mean())
    mean, total, trend, p = one(scaled, fit_trend_cv2, True)
    for c, want in (("mean", mean), ("total", total), ("trend", trend), ("ratio", total / trend), ("p_value", p), ("fdr", adjusted(p))):
        assert np.allclose(got[c], want, atol=1e-6), c
    design = spark.range(40).select(F.col("id").alias("sample"), F.lit(1.0).alias("one"), (F.col("id") % 7).cast("double").alias("z"))
    got = variance.model_gene_var(m, design=design).toPandas().sort_values("feature")
    x = np.stack([np.ones(40), np.arange(40) % 7], axis=1)
    left = dense.T - x @ np.linalg.lstsq(x, dense.T, rcond=None)[0]
    assert np.allclose(got["total"], (left**2).sum(axis=0) / 38, atol=1e-9)


def test_adjustment_over_many_partitions(spark):
    rng = np.random.default_rng(5)
    log_p = np.where(rng.random(2000) < 0.05, np.nan, np.log(np.round(rng.random(2000), 2) + 1e-6))
    df = spark.createDataFrame([(i, None if np.isnan(v) else float(v)) for i, v in enumerate(log_p)], "feature int, log_p double")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        one = markers.bh(df, [], "log_p", "fdr").toPandas()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    two = markers.bh(df.withColumn("all", F.lit(1)), ["all"], "log_p", "fdr").toPandas()
    a, b = (x.sort_values("feature")["fdr"].to_numpy() for x in (one, two))
    assert np.allclose(a, b, equal_nan=True) and np.isnan(a).sum() == np.isnan(log_p).sum()
    assert markers.bh(df.limit(0), [], "log_p", "fdr").count() == 0


def test_products_of_many_features_and_samples(spark, monkeypatch):
    monkeypatch.setattr(correlate, "SAMPLES", 7)
    monkeypatch.setattr(correlate, "ROWS", 3)
    monkeypatch.setattr(correlate, "FAN_IN", 2)
    rng = np.random.default_rng(6)
    x = rng.poisson(1.0, (10, 200)).astype(float)
    cells = spark.createDataFrame([(f"f{i}", f"s{j}", float(x[i, j])) for i, j in zip(*np.nonzero(x))], "feature string, sample string, value double")
    m = SparseMatrix(cells, spark.createDataFrame([(f"f{i}",) for i in range(10)], "feature string"), spark.createDataFrame([(f"s{j}",) for j in range(200)], "sample string"))
    want = np.corrcoef(x)
    got = correlate.correlate_pairs(m).collect()
    assert len(got) == 45 and all(abs(r["rho"] - want[int(r["feature1"][1:]), int(r["feature2"][1:])]) < 1e-9 for r in got)


def test_least_squares_with_a_fill_value(spark):
    from quillon.operators import linear

    rng = np.random.default_rng(7)
    y = np.where(rng.random((5, 30)) < 0.5, 2.0, rng.random((5, 30)))
    cells = spark.createDataFrame([(i, j, float(y[i, j])) for i in range(5) for j in range(30) if y[i, j] != 2.0], "feature int, sample int, value double")
    m = SparseMatrix(cells, spark.range(5).select(F.col("id").cast("int").alias("feature")), spark.range(30).select(F.col("id").cast("int").alias("sample")), 2.0)
    design = spark.createDataFrame([(j, 1.0, float(j % 4), float(j * j)) for j in range(30)], "sample int, one double, a double, b double")
    fit, _, n, df = linear.least_squares(m, design)
    x = np.array([[1.0, j % 4, j * j] for j in range(30)])
    want, rss, *_ = np.linalg.lstsq(x, y.T, rcond=None)
    got = fit.orderBy("feature").collect()
    assert (n, df) == (30, 27) and np.allclose([r["coef"] for r in got], want.T) and np.allclose([r["rss"] for r in got], rss)
    with pytest.raises(ValueError):
        linear.least_squares(m, design.withColumn("c", F.col("a") * 2))
    with pytest.raises(ValueError):
        m.realized(10)


def test_dense_matrices_shuffle_no_empty_cells(spark, monkeypatch):
    from quillon import catalogue
    from quillon.plans import matrix as plans

    monkeypatch.setattr(plans, "BLOCK", 7)
    for fill in (0.0, 1.0):
        x = dense(3, fill)
        m = matrix(spark, x, fill)
        own = m.cells.where("feature < 11").unionAll(spark.createDataFrame([(11, 2, None), (99, 1, 5.0), (1, 99, 5.0)], m.cells.schema))  # unknown keys are not in the universe
        x[11] = fill
        wide = SparseMatrix(own, m.features, m.samples, fill).dense()
        assert sorted(map(tuple, wide.collect())) == [(i, j, x[i, j]) for i in range(G) for j in range(N)]
        grid = [line for line in wide._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join LeftOuter" in line]
        assert len(grid) == 1 and "block" in grid[0] and "sample" not in grid[0]
    monkeypatch.setattr(catalogue, "REALIZED", 10)
    assert sorted(map(tuple, catalogue._realized(m).collect())) == sorted(map(tuple, m.dense().collect()))


def test_ranks_tell_saturated_aucs_apart(spark):
    noise = np.array([0.1, -0.1, 0.2, -0.2])
    x = np.stack([(100 + i * i) * (np.arange(N) < N // 2) + noise[np.arange(N) % 4] for i in range(G)])
    out = markers.score_markers(matrix(spark, x), groups(spark, ["a"] * (N // 2) + ["b"] * (N - N // 2))).toPandas()
    got = {(r.group, r.feature): r.rank_auc for r in out.itertuples()}
    assert all(got["a", i] == G - i and got["b", i] == i + 1 for i in range(G)) and set(out["mean_auc"].round(12)) == {0.0, 1.0}


def test_exact_aucs_with_a_fold_change_by_columns(spark, monkeypatch):
    for fill, lfc in ((0.0, 1.0), (1.0, -2.0), (0.0, 0.5)):
        x = dense(8, fill)
        labels = ["a"] * 9 + ["b"] * 11 + ["c"] * 10
        m, g = matrix(spark, x, fill), groups(spark, labels)
        out = markers.exact_auc(m, g, lfc=lfc)
        assert "explode" in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "other" not in plan  # cells are not dealt to pairs
        by_columns = sorted(map(tuple, out.collect()))
        for f, a, b, n1, n2, auc in by_columns:
            u, v = (x[f, [j for j in range(N) if labels[j] == w]] for w in (a, b))
            assert (n1, n2) == (len(u), len(v)) and np.isclose(auc, ((u[:, None] - lfc > v) + 0.5 * (u[:, None] - lfc == v)).mean())
        with monkeypatch.context() as mp:
            mp.setattr(markers, "MAX_COLUMNS", 0)
            assert by_columns == sorted(map(tuple, markers.exact_auc(m, g, lfc=lfc).collect()))


def test_equal_tests_are_worked_out_once():
    import pandas as pd

    rng, seen = np.random.default_rng(9), []

    def f(k, n, p):
        seen.append(len(k))
        return K.log_pbinom(k, n, p)

    k, n, p = (rng.integers(0, 4, 5000), rng.integers(4, 7, 5000), rng.choice([0.25, 0.5], 5000))
    got = K._series(f, pd.Series(k).astype("Int64").mask(k == 3), pd.Series(n), pd.Series(p))
    assert seen == [3 * 3 * 2] and (got.isna() == (k == 3)).all()
    assert np.allclose(got[k < 3].astype(float), K.log_pbinom(k, n, p)[k < 3], rtol=1e-13)


def test_parts_grow_in_number_not_in_size(spark, monkeypatch):
    from quillon import catalogue, catalogue_io
    from quillon.sources import files
    from tests.conftest import SF

    monkeypatch.setattr(files, "PART", 500)
    for df in (catalogue.sales(spark, SF).cells, catalogue_io._sales(spark, SF).cells, catalogue_io._supplier_graph(spark, SF).edges):
        assert df.rdd.getNumPartitions() >= 12  # 6,000 lines
    plan = moments.moments(catalogue.sales(spark, SF), catalogue.regions(spark, SF))._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
