"""Pairwise tests between groups, marker rankings, and effect sizes. Long tables throughout: one row per feature and ordered
pair of groups. Pairs come from a join of the moments table with itself; nothing loops over pairs."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.functions import kernels as K
from quillon.operators.linear import least_squares
from quillon.operators.moments import THRESHOLD, moments
from quillon.plans.matrix import SparseMatrix
from quillon.sources import files

LEAST_VAR = 1e-8


def chosen_groups(groups: DataFrame, restrict: Iterable | None = None, exclude: Iterable | None = None) -> DataFrame:
    """groups without null or empty ones, with only those of restrict and none of exclude; fewer than two is an error."""
    out = groups.where(F.col("group").isNotNull() & (F.col("group").cast("string") != ""))
    if restrict is not None:
        out = out.where(F.col("group").isin(list(restrict)))
    if exclude is not None:
        out = out.where(~F.col("group").isin(list(exclude)))
    if out.select("group").distinct().limit(2).count() < 2:
        raise ValueError("at least two groups are needed")
    return out


def _pairs(stats: DataFrame, columns: Sequence[str], block: bool) -> DataFrame:
    """feature, first, second, (block,) and the statistics of both groups, numbered 1 and 2."""
    keys = ["feature", *["block"] * block]
    a, b = (stats.select(*keys, F.col("group").alias(g), *(F.col(c).alias(f"{c}{i}") for c in columns)) for g, i in (("first", 1), ("second", 2)))
    return a.join(b, keys).where(F.col("first") != F.col("second"))


def welch(pairs: DataFrame) -> DataFrame:
    """Adds delta, err2, df: difference of means, its squared standard error and Welch's degrees of freedom (null under two cells)."""
    v1, v2 = (F.greatest(F.col(f"var{i}"), F.lit(LEAST_VAR)) for i in (1, 2))
    e1, e2 = v1 / F.col("n1"), v2 / F.col("n2")
    ok = F.col("var1").isNotNull() & F.col("var2").isNotNull()
    df = F.pow(e1 + e2, F.lit(2.0)) / (F.try_divide(e1 * e1, F.col("n1") - 1) + F.try_divide(e2 * e2, F.col("n2") - 1))
    return pairs.withColumn("delta", F.col("mean1") - F.col("mean2")).withColumn("err2", F.when(ok, e1 + e2)).withColumn("df", F.when(ok, df))


def cohen(delta: Column) -> Column:
    """delta over the pooled standard deviation; 0 where delta is 0."""
    pooled = F.try_divide((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2"), F.col("n1") + F.col("n2") - 2)
    return F.when(delta == 0, F.lit(0.0)).otherwise(F.try_divide(delta, F.sqrt(pooled)))


def capped(log_p: Column) -> Column:
    """A log probability of 0 at most; null stays null."""
    return F.when(log_p > 0, F.lit(0.0)).otherwise(log_p)


def directed(left: Column, right: Column, direction: str) -> Column:
    if direction == "up":
        return right
    if direction == "down":
        return left
    if direction != "any":
        raise ValueError(f"no direction {direction!r}")
    return capped(F.least(left, right) + K.LN2)


def bh(df: DataFrame, keys: Sequence[str], log_p: str, out: str) -> DataFrame:
    """Adds Benjamini-Hochberg adjusted log p-values within the keys: a reverse running minimum of p + ln(n / rank)."""
    if not keys:
        return _bh_of_all(df, log_p, out)
    up = Window.partitionBy(*keys).orderBy(F.col(log_p).asc_nulls_last(), "feature")
    down = Window.partitionBy(*keys).orderBy(F.col(log_p).desc_nulls_first(), F.desc("feature")).rowsBetween(Window.unboundedPreceding, 0)
    n = F.count(log_p).over(Window.partitionBy(*keys))
    raw = F.when(F.col(log_p).isNotNull(), F.col(log_p) + F.ln(n / F.row_number().over(up)))
    return df.withColumn("__raw", raw).withColumn(out, F.when(F.col(log_p).isNotNull(), F.least(F.lit(0.0), F.min("__raw").over(down)))).drop("__raw")


def _bh_of_all(df: DataFrame, log_p: str, out: str) -> DataFrame:
    """bh() over all rows, in ranges of p: a range takes its ranks from the sizes of those before, and the minimum of those after it."""
    order = [F.col(log_p).asc_nulls_last(), F.col("feature")]
    held = files.written(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), "bh")
    sizes = {r["__part"]: r["n"] for r in held.groupBy("__part").agg(F.count(log_p).alias("n")).collect()}
    parts = range(max(sizes, default=-1) + 1)
    before = [sum(sizes.get(q, 0) for q in range(p)) for p in parts] or [0]

    def of(values: list) -> Column:
        return F.get(F.array(*map(F.lit, values)), F.col("__part"))

    up = Window.partitionBy("__part").orderBy(*order)
    rank = (F.row_number().over(up) + of(before)).cast("double")
    held = held.withColumn("__raw", F.when(F.col(log_p).isNotNull(), F.col(log_p) + F.ln(F.lit(float(sum(sizes.values()))) / rank)))
    least = {r["__part"]: r["least"] for r in held.groupBy("__part").agg(F.min("__raw").alias("least")).collect()} if len(parts) > 1 else {}
    after = [min((v for q, v in least.items() if q > p and v is not None), default=0.0) for p in parts] or [0.0]
    down = Window.partitionBy("__part").orderBy(F.col(log_p).desc_nulls_first(), F.desc("feature")).rowsBetween(Window.unboundedPreceding, 0)
    return held.withColumn(out, F.when(F.col(log_p).isNotNull(), F.least(F.lit(0.0), F.min("__raw").over(down), of(after)))).drop("__raw", "__part")


def _combined(tests: DataFrame, direction: str) -> DataFrame:
    """Blocks of a pair joined: Stouffer's method for each tail, weighted means of effects; null where no block is valid."""
    ok = F.col("left").isNotNull()
    tests = tests.where(ok & (F.col("weight") > 0)).withColumn("zl", K.normal_quantile(F.col("left"))).withColumn("zr", K.normal_quantile(F.col("right")))
    w = F.col("weight")
    root = F.sqrt(F.sum(w * w))
    out = tests.groupBy("feature", "first", "second").agg((F.sum(w * F.col("zl")) / root).alias("zl"), (F.sum(w * F.col("zr")) / root).alias("zr"), (F.sum(w * F.col("effect")) / F.sum(w)).alias("effect"))
    return out.withColumn("log_p", directed(K.normal_left(F.col("zl")), K.normal_left(F.col("zr")), direction)).drop("zl", "zr")


def _finished(tests: DataFrame, blocked: bool, direction: str, log_p: bool, all_pairs: DataFrame) -> DataFrame:
    if blocked:
        done = all_pairs.join(_combined(tests, direction), ["feature", "first", "second"], "left")
    else:
        done = tests.withColumn("log_p", directed(F.col("left"), F.col("right"), direction))
    done = bh(done.select("feature", "first", "second", "effect", "log_p"), ["first", "second"], "log_p", "log_fdr")
    if log_p:
        return done
    return done.select("feature", "first", "second", "effect", F.exp("log_p").alias("p_value"), F.exp("log_fdr").alias("fdr"))


def _stats(m: SparseMatrix, groups: DataFrame, blocks: DataFrame | None, threshold: float) -> DataFrame:
    keys = groups.select("sample", "group") if blocks is None else groups.select("sample", "group").join(blocks.select("sample", "block"), "sample")
    return moments(m, keys, threshold)


def in_order_of_pairs(tests: DataFrame, levels: Sequence | None = None) -> DataFrame:
    """Tests sorted by first and second group, in the order of levels if given (others last), then by feature."""
    place = [F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, levels)), F.col(c)), F.lit(0)), F.lit(1 << 30)) if levels else F.col(c) for c in ("first", "second")]
    return tests.orderBy(*place, "first", "second", "feature")


def _with_design(m: SparseMatrix, groups: DataFrame, design: DataFrame) -> DataFrame:
    """Pairs of groups with the difference of their coefficients beside those of design (delta), its squared error and the residual
    degrees of freedom; var: the residual variance."""
    groups = groups.join(m.samples.select("sample"), "sample", "left_semi").join(design.dropna().select("sample"), "sample", "left_semi")
    names = [r["group"] for r in groups.select("group").distinct().orderBy("group").collect()]  # a column each
    covariates = [c for c in design.columns if c != "sample"]
    ends = design.agg(*(f(f"`{c}`").alias(f"{n}{k}") for k, c in enumerate(covariates) for n, f in (("lo", F.min), ("hi", F.max)))).first() if covariates else {}
    varying = [c for k, c in enumerate(covariates) if ends[f"lo{k}"] != ends[f"hi{k}"]]  # an intercept is the sum of the groups
    x = groups.join(design.select("sample", *(f"`{c}`" for c in varying)), "sample").select("sample", *((F.col("group") == g).cast("double").alias(f"__g{k}") for k, g in enumerate(names)), *(f"`{c}`" for c in varying))
    fit, inverse, _, df = least_squares(m, x)
    sigma2 = F.greatest(F.col("rss") / float(df), F.lit(LEAST_VAR))
    rows = [
        F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), (F.col("coef")[i] - F.col("coef")[j]).alias("delta"), (sigma2 * float(inverse[i, i] + inverse[j, j] - 2 * inverse[i, j])).alias("err2"), sigma2.alias("var"))
        for i, a in enumerate(names) for j, b in enumerate(names) if i != j
    ]
    return fit.select("feature", F.explode(F.array(*rows)).alias("one")).select("feature", "one.*", F.lit(float(df)).alias("df"))


def pairwise_t_tests(m: SparseMatrix, groups: DataFrame, blocks: DataFrame | None = None, restrict=None, exclude=None, direction: str = "any", lfc: float = 0.0, std_lfc: bool = False, log_p: bool = False, design: DataFrame | None = None) -> DataFrame:
    """(feature, first, second, effect, p_value, fdr): Welch tests of each ordered pair. groups: (sample, group); blocks:
    (sample, block), tested apart and combined. With lfc the null hypothesis is a difference within it. With design (sample, then
    numbers) groups are compared by a linear model that has these columns too, with one residual variance for a feature."""
    blocked = blocks is not None
    if design is not None:
        if blocked:
            raise ValueError("blocks and a design can't be used together")
        tests = _with_design(m, chosen_groups(groups, restrict, exclude), design)
        err = F.sqrt("err2")
        tests = tests.withColumn("tails", K.t_tails((F.col("delta") + lfc) / err, (F.col("delta") - lfc) / err if lfc else None, F.col("df")))
        tests = tests.withColumns({"left": F.col("tails.left"), "right": F.col("tails.right")}).withColumn("effect", F.col("delta") / F.sqrt("var") if std_lfc else F.col("delta"))
        return _finished(tests, False, direction, log_p, tests)
    stats = _stats(m, chosen_groups(groups, restrict, exclude), blocks, THRESHOLD)
    tests = welch(_pairs(stats, ["n", "mean", "var"], blocked))
    err = F.sqrt("err2")
    tests = (
        tests.withColumn("tails", K.t_tails((F.col("delta") + lfc) / err, (F.col("delta") - lfc) / err if lfc else None, F.col("df")))
        .withColumns({"left": F.col("tails.left"), "right": F.col("tails.right")})
        .withColumn("effect", cohen(F.col("delta")) if std_lfc else F.col("delta"))
        .withColumn("weight", F.try_divide(F.lit(1.0), F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("n2"))))
    )
    return _finished(tests, blocked, direction, log_p, tests.select("feature", "first", "second").distinct())


def binom_effect() -> Column:
    """log2 ratio of detected shares with pseudo counts in proportion to the group sizes."""
    mean = (F.col("n1") + F.col("n2")) / 2.0
    share = [(F.col(f"detected{i}") + F.col(f"n{i}") / mean) / (F.col(f"n{i}") + 2 * F.col(f"n{i}") / mean) for i in (1, 2)]
    return F.log2(share[0]) - F.log2(share[1])


def pairwise_binom(m: SparseMatrix, groups: DataFrame, blocks: DataFrame | None = None, restrict=None, exclude=None, direction: str = "any", threshold: float = THRESHOLD, lfc: float = 0.0, log_p: bool = False) -> DataFrame:
    """(feature, first, second, effect, p_value, fdr): binomial tests of detected counts of each ordered pair."""
    blocked = blocks is not None
    tests = _pairs(_stats(m, chosen_groups(groups, restrict, exclude), blocks, threshold), ["n", "detected"], blocked).where("n1 > 0 AND n2 > 0")
    size, fold = F.col("detected1") + F.col("detected2"), 2.0**lfc
    low, high = (F.col("n1") * f / (F.col("n2") + F.col("n1") * f) for f in (1 / fold, fold))
    tests = (
        tests.withColumn("left", K.binom_left(F.col("detected1"), size, low))
        .withColumn("right", K.binom_right(F.col("detected1"), size, high))
        .withColumn("effect", binom_effect())
        .withColumn("weight", (F.col("n1") + F.col("n2")).cast("double"))
    )
    return _finished(tests, blocked, direction, log_p, tests.select("feature", "first", "second").distinct())


def pairwise_wilcox(m: SparseMatrix, groups: DataFrame, restrict=None, exclude=None, direction: str = "any", log_p: bool = False) -> DataFrame:
    """(feature, first, second, effect, p_value, fdr): rank-sum tests by the normal approximation with tie and continuity
    corrections; the effect is the probability that a value of the first group is larger."""
    groups = chosen_groups(groups, restrict, exclude)
    auc = exact_auc(m, groups, ties=True)
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    var = n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("ties"), n * (n - 1)))
    shift = (F.col("auc") - 0.5) * n1 * n2
    tests = auc.withColumn("sd", F.when(var > 0, F.sqrt(var))).withColumn("left", K.normal_left((shift + 0.5) / F.col("sd"))).withColumn("right", K.normal_right((shift - 0.5) / F.col("sd"))).withColumn("effect", F.col("auc"))
    none = F.col("sd").isNull()  # all values equal
    tests = tests.withColumn("left", F.when(none, 0.0).otherwise(F.col("left"))).withColumn("right", F.when(none, 0.0).otherwise(F.col("right")))
    return _finished(tests, False, direction, log_p, tests)


# --- combined markers -----------------------------------------------------------------------


def combine_markers(pairwise: DataFrame, pval_type: str = "any", min_prop: float | None = None, log_p: bool = False) -> DataFrame:
    """For each group (first) and feature, p-values over its comparisons: ``any`` by Simes (top: the least rank of the feature
    in a comparison), ``all`` by the largest, ``some`` by the middle of Holm-adjusted ones. pairwise: feature, first, second,
    effect, log_p. Result: group, feature, top, log_p or p_value, fdr, summary_effect: that of the comparison that gave p."""
    share = {"any": 0.0, "some": 0.5, "all": 1.0}[pval_type] if min_prop is None else min_prop
    by_p = Window.partitionBy("first", "feature").orderBy(F.col("log_p").asc_nulls_last(), "second")
    in_pair = Window.partitionBy("first", "second").orderBy(F.col("log_p").asc_nulls_last(), "feature")
    k = F.count("log_p").over(Window.partitionBy("first", "feature"))
    r = pairwise.withColumn("order", F.row_number().over(by_p)).withColumn("k", k).withColumn("rank", F.row_number().over(in_pair)).where("log_p IS NOT NULL")
    if pval_type == "any":
        r = r.withColumn("adjusted", F.col("log_p") + F.ln(F.col("k") / F.col("order")))
        picked = F.min_by(F.struct("log_p", "effect"), F.struct("adjusted", "order"))
        value = F.min("adjusted")
    elif pval_type == "all":
        picked, value = F.max_by(F.struct("log_p", "effect"), F.struct("log_p", "order")), F.max("log_p")
    elif pval_type == "some":
        running = Window.partitionBy("first", "feature").orderBy("order").rowsBetween(Window.unboundedPreceding, 0)
        r = r.withColumn("adjusted", F.max(F.col("log_p") + F.ln(F.col("k") - F.col("order") + F.lit(1.0))).over(running))
        mine = F.col("order") == F.greatest(F.lit(1), F.ceil(F.col("k") * share))
        picked, value = F.max(F.when(mine, F.struct("log_p", "effect"))), F.max(F.when(mine, F.col("adjusted")))
    else:
        raise ValueError(f"no pval_type {pval_type!r}")
    need = F.greatest(F.lit(1), F.ceil(F.col("k") * share))
    ranks = F.element_at(F.array_sort(F.collect_list("rank")), F.max(need).cast("int"))  # one for each other group
    out = r.groupBy("first", "feature").agg(capped(value).alias("log_p"), picked.alias("picked"), ranks.alias("top"))
    out = bh(out.withColumnRenamed("first", "group"), ["group"], "log_p", "log_fdr")
    out = out.select("group", "feature", F.col("top").cast("long").alias("top"), "log_p", "log_fdr", F.col("picked.effect").alias("summary_effect"))
    return out if log_p else out.select("group", "feature", "top", F.exp("log_p").alias("p_value"), F.exp("log_fdr").alias("fdr"), "summary_effect")


def with_row_data(table: DataFrame, row_data: DataFrame) -> DataFrame:
    """Columns of row_data (first column: feature) beside those of the table; it's an error if features differ."""
    key = row_data.columns[0]
    row_data = row_data.withColumnRenamed(key, "feature")
    ours, theirs = table.select("feature").distinct(), row_data.select("feature")
    if ours.join(theirs, "feature", "left_anti").take(1) or theirs.join(ours, "feature", "left_anti").take(1):
        raise ValueError("row data is for other features")
    return table.join(row_data, "feature")


def find_markers(m: SparseMatrix, groups: DataFrame, test_type: str = "t", pval_type: str = "any", min_prop: float | None = None, log_p: bool = False, row_data: DataFrame | None = None, add_summary: bool = False, sorted_: bool = True, **options) -> DataFrame:
    """combine_markers() of a pairwise test: ``t``, ``binom`` or ``wilcox``."""
    test = {"t": pairwise_t_tests, "binom": pairwise_binom, "wilcox": pairwise_wilcox}[test_type]
    out = combine_markers(test(m, groups, log_p=True, **options), pval_type, min_prop, log_p)
    if add_summary:
        out = out.join(summary_marker_stats(m, groups), ["group", "feature"])
    if row_data is not None:
        out = with_row_data(out, row_data)
    p = "log_p" if log_p else "p_value"
    return out.orderBy("group", *(["top", p] if pval_type == "any" else [p]), "feature") if sorted_ else out


# --- effect sizes ---------------------------------------------------------------------------


#: Groups that are counted in a column each.
MAX_COLUMNS = 20


def exact_auc(m: SparseMatrix, groups: DataFrame, lfc: float = 0.0, ties: bool = False) -> DataFrame:
    """(feature, first, second, n1, n2, auc): the probability that a value of the first group, less lfc, is above one of the
    second, ties by half, over stored and filled cells (null values count as filled). From counts of distinct values, those of
    filled cells by difference, and their running sums in the order of values: no cell meets another one. With ties also the
    sum of t^3 - t over the tied values of both groups (needs lfc 0)."""
    groups = groups.dropna(subset=["group"]).join(m.samples.select("sample"), "sample", "left_semi").select("sample", "group")
    sizes = groups.groupBy("group").agg(F.count("*").alias("n"))
    m = replace(m, cells=m.cells.where(F.col("value").isNotNull()))
    if isinstance(groups.schema["group"].dataType, T.AtomicType):
        some = sizes.limit(MAX_COLUMNS + 1).collect()
        if 1 < len(some) <= MAX_COLUMNS:
            return _auc_by_columns(m, groups, [(r["group"], r["n"]) for r in some], ties, lfc)
    stored = m.beside(groups).groupBy("feature", "group", F.col("value").cast("double").alias("value")).agg(F.count("*").alias("c"))
    held = stored.groupBy("feature", "group").agg(F.sum("c").alias("k"))
    rest = m.features.select("feature").crossJoin(sizes).join(held, ["feature", "group"], "left").select("feature", "group", F.lit(float(m.fill)).alias("value"), (F.col("n") - F.coalesce("k", F.lit(0))).alias("c"))
    counts = stored.unionAll(rest.where("c > 0")).groupBy("feature", "group", "value").agg(F.sum("c").alias("c"))
    # Both groups' values of a pair in one sorted list; below: cells of the second group under this value.
    other = sizes.select(F.col("group").alias("other"))
    pairs = counts.crossJoin(other).where("group != other")
    first = pairs.select("feature", F.col("group").alias("first"), F.col("other").alias("second"), (F.col("value") - lfc).alias("value"), F.col("c").alias("c1"), F.lit(0).cast("long").alias("c2"))
    second = pairs.select("feature", F.col("other").alias("first"), F.col("group").alias("second"), "value", F.lit(0).cast("long").alias("c1"), F.col("c").alias("c2"))
    keys = ["feature", "first", "second"]
    at = first.unionAll(second).groupBy(*keys, "value").agg(F.sum("c1").alias("c1"), F.sum("c2").alias("c2"))
    below = F.coalesce(F.sum("c2").over(Window.partitionBy(*keys).orderBy("value").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = (F.col("c1") + F.col("c2")).cast("double")
    out = at.withColumn("u", F.col("c1") * (below + F.col("c2") / 2.0)).groupBy(*keys).agg(F.sum("u").alias("u"), F.sum("c1").alias("n1"), F.sum("c2").alias("n2"), F.sum(t * t * t - t).alias("ties"))
    return out.select(*keys, "n1", "n2", F.try_divide(F.col("u"), (F.col("n1") * F.col("n2")).cast("double")).alias("auc"), *["ties"] * ties)


def _auc_by_columns(m: SparseMatrix, groups: DataFrame, sizes: list[tuple], ties: bool, lfc: float = 0.0) -> DataFrame:
    """exact_auc() with a column of counts for each group: one sorted pass over the distinct values of a feature serves all pairs. With
    lfc the first group's cells (a) stand beside the second group's (c) once more, at their value less lfc."""
    k = range(len(sizes))
    value = F.col("value").cast("double").alias("value")
    stored = m.beside(groups).where(F.col("value") != m.fill).groupBy("feature", value).agg(*(F.count_if(F.col("group") == g).alias(f"c{i}") for i, (g, _) in enumerate(sizes)))
    held = stored.groupBy("feature").agg(*(F.sum(f"c{i}").alias(f"h{i}") for i in k))
    rest = m.features.select("feature").join(held, "feature", "left").select("feature", F.lit(float(m.fill)).alias("value"), *((F.lit(n) - F.coalesce(f"h{i}", F.lit(0))).alias(f"c{i}") for i, (_, n) in enumerate(sizes)))
    at, first = stored.unionByName(rest), "c"
    if lfc:
        first, none = "a", F.lit(0).cast("long")
        sides = F.array(
            F.struct(F.col("value").alias("value"), *(F.col(f"c{i}").alias(f"c{i}") for i in k), *(none.alias(f"a{i}") for i in k)),
            F.struct((F.col("value") - lfc).alias("value"), *(none.alias(f"c{i}") for i in k), *(F.col(f"c{i}").alias(f"a{i}") for i in k)),
        )
        at = at.select("feature", F.explode(sides).alias("one")).select("feature", "one.*")
    # Equal values are peers of one another: below are the cells before them all, beside (c + same) those among them.
    below = Window.partitionBy("feature").orderBy("value")
    if lfc:
        at = at.withColumns({f"e{i}": F.sum(f"c{i}").over(Window.partitionBy("feature", "value")) for i in k})
        at = at.withColumns({f"b{i}": F.sum(f"c{i}").over(below.rangeBetween(Window.unboundedPreceding, 0)) - F.col(f"e{i}") for i in k})
    else:
        at = at.withColumns({f"b{i}": F.coalesce(F.sum(f"c{i}").over(below.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) for i in k})
    equal = "e" if lfc else "c"
    pairs = [(i, j) for i in k for j in k if i != j]
    t = {(i, j): (F.col(f"c{i}") + F.col(f"c{j}")).cast("double") for i, j in pairs}
    sums = [F.sum(F.col(f"{first}{i}") * (F.col(f"b{j}") + F.col(f"{equal}{j}") / 2.0)).alias(f"u{i}_{j}") for i, j in pairs]
    sums += [F.sum(t[i, j] * t[i, j] * t[i, j] - t[i, j]).alias(f"t{i}_{j}") for i, j in pairs if ties and i < j]
    rows = [
        F.struct(
            F.lit(sizes[i][0]).alias("first"), F.lit(sizes[j][0]).alias("second"), F.lit(sizes[i][1]).cast("long").alias("n1"), F.lit(sizes[j][1]).cast("long").alias("n2"),
            (F.col(f"u{i}_{j}") / float(sizes[i][1] * sizes[j][1])).alias("auc"), *[F.col(f"t{min(i, j)}_{max(i, j)}").alias("ties")] * ties,
        )
        for i, j in pairs
    ]
    return at.groupBy("feature").agg(*sums).select("feature", F.explode(F.array(*rows)).alias("one")).select("feature", "one.*")


def pairing_frame(m: SparseMatrix, pairings) -> DataFrame:
    """(first, second): ordered pairs of a list of groups, of two lists (each of the first with each of the second), or of a
    frame or list of pairs."""
    if isinstance(pairings, DataFrame):
        a, b = pairings.columns[:2]
        return pairings.select(pairings[a].alias("first"), pairings[b].alias("second"))
    pairings = list(pairings)
    if len(pairings) == 2 and all(isinstance(p, list) for p in pairings):
        chosen = [(a, b) for a in pairings[0] for b in pairings[1] if a != b]
    elif pairings and all(isinstance(p, tuple) for p in pairings):
        chosen = pairings
    else:
        chosen = [(a, b) for a in pairings for b in pairings if a != b]
    return m.spark.createDataFrame(chosen, ["first", "second"])


#: Effects that agree to so many decimals have the same rank, so that ties don't hang on the last bits of logarithms.
DIGITS = 12
SIDES = ("self_average", "other_average", "self_detected", "other_detected")


def effects(m: SparseMatrix, groups: DataFrame, blocks: DataFrame | None = None, pairings=None, lfc: float = 0.0, true_auc: bool = False, sides: bool = False, z: bool = False) -> DataFrame:
    """(feature, first, second, cohen, auc, delta_mean, lfc_detected). The AUC is a normal approximation unless true_auc is
    set. With blocks, effects of blocks are averaged with weights n1 n2. With sides (and no blocks) also the means and detected shares of both groups.
    With z (and no blocks) also the statistic of the approximate AUC, which tells apart what the AUC rounds to 1 or 0."""
    blocked = blocks is not None
    stats = _stats(m, groups.where("group IS NOT NULL"), blocks, THRESHOLD)
    p = _pairs(stats, ["n", "mean", "var", "detected"], blocked)
    if pairings is not None:
        p = p.join(pairing_frame(m, pairings), ["first", "second"], "left_semi")
    delta = F.col("mean1") - F.col("mean2") - lfc
    p = p.select(
        "feature", "first", "second", *["block"] * blocked, (F.col("n1") * F.col("n2")).cast("double").alias("w"),
        (delta / F.sqrt(F.greatest((F.col("var1") + F.col("var2")) / 2, F.when(F.col("var1").isNotNull() & F.col("var2").isNotNull(), F.lit(LEAST_VAR))))).alias("cohen"),
        F.when(F.col("var1").isNotNull() & F.col("var2").isNotNull(), delta / F.sqrt(F.greatest(F.col("var1") / F.col("n1") + F.col("var2") / F.col("n2"), F.lit(LEAST_VAR)))).alias("z"),
        delta.alias("delta_mean"),
        (F.log2((F.col("detected1") + 0.5) / (F.col("n1") + 1)) - F.log2((F.col("detected2") + 0.5) / (F.col("n2") + 1))).alias("lfc_detected"),
        *(c for i, who in ((1, "self"), (2, "other")) for c in (F.col(f"mean{i}").alias(f"{who}_average"), F.try_divide(F.col(f"detected{i}"), F.col(f"n{i}")).alias(f"{who}_detected"))),
    )
    p = p.withColumn("cohen", F.when(F.col("z").isNotNull(), F.col("cohen")))
    if true_auc:
        own = groups.select("sample", "group")
        if blocked:
            joint = own.join(blocks.select("sample", "block"), "sample")
            auc = exact_auc(m, joint.select("sample", F.struct("group", "block").alias("group")), lfc).where(F.col("first.block") == F.col("second.block"))
            auc = auc.select("feature", F.col("first.block").alias("block"), F.col("first.group").alias("first"), F.col("second.group").alias("second"), "auc")
        else:
            auc = exact_auc(m, own, lfc).select("feature", "first", "second", "auc")
        p = p.join(auc, ["feature", "first", "second", *["block"] * blocked], "left")
    else:
        p = p.withColumn("auc", F.exp(K.normal_left(F.col("z"))))
    out = ["cohen", "auc", "delta_mean", "lfc_detected"]
    if blocked:
        p = p.groupBy("feature", "first", "second").agg(*(F.try_divide(F.sum(F.col("w") * F.col(c)), F.sum(F.when(F.col(c).isNotNull(), F.col("w")))).alias(c) for c in out))
    return p.select("feature", "first", "second", *out, *([] if blocked else SIDES) if sides else [], *["z"] * (z and not blocked))


def _median(sorted_values: str) -> Column:
    """Of a sorted array; null if it is empty."""
    n = F.size(sorted_values)
    low, high = (F.get(sorted_values, F.floor(k / 2).cast("int")) for k in (n - 1, n))
    return F.when(n > 0, (low + high) / 2)


def score_markers(m: SparseMatrix, groups: DataFrame, blocks: DataFrame | None = None, pairings=None, lfc: float = 0.0, row_data: DataFrame | None = None, full_stats: bool = False, true_auc: bool = False) -> DataFrame:
    """For each group and feature: self and other averages and detected shares, and of each effect its mean, median, min and
    max over comparisons and the least rank (largest effect first) that the feature has in one of them. With full_stats also
    the effects by other group, as maps."""
    whole = blocks is None and pairings is None  # then the pairs have all that averages of the other groups need
    by_z = not true_auc and blocks is None
    e = effects(m, groups, blocks, pairings, lfc, true_auc, sides=whole, z=by_z).withColumnRenamed("first", "group")
    names = ("cohen", "auc", "lfc_detected")
    for c in names:
        # Of z by its logarithm, as it may have many digits before the point.
        by = F.signum("z") * F.log1p(F.abs("z")) if c == "auc" and by_z else F.col(c)
        e = e.withColumn(f"rank_{c}", F.when(F.col(c).isNotNull(), F.rank().over(Window.partitionBy("group", "second").orderBy(F.round(by, DIGITS).desc_nulls_last()))))
    # Lists of one entry for each other group.
    aggs = [a for c in names for a in (F.avg(c).alias(f"mean_{c}"), F.array_sort(F.collect_list(c)).alias(f"all_{c}"), F.min(f"rank_{c}").cast("long").alias(f"rank_{c}"))]
    if whole:
        aggs += [F.any_value(c).alias(c) if c.startswith("self") else F.avg(c).alias(c) for c in SIDES]
    if full_stats:
        aggs += [F.map_from_entries(F.collect_list(F.struct("second", c))).alias(f"full_{c}") for c in names]
    got = e.groupBy("group", "feature").agg(*aggs)
    made = [x for c in names for x in (F.col(f"mean_{c}"), _median(f"all_{c}").alias(f"median_{c}"), F.array_min(f"all_{c}").alias(f"min_{c}"), F.array_max(f"all_{c}").alias(f"max_{c}"), F.col(f"rank_{c}"))]
    made += [F.col(f"full_{c}") for c in names] if full_stats else []
    out = got if whole else summary_marker_stats(m, groups).join(got, ["group", "feature"], "left")
    out = out.select("group", "feature", *SIDES, *made)
    return out if row_data is None else with_row_data(out, row_data)


def summary_marker_stats(m: SparseMatrix, groups: DataFrame, average: str = "mean") -> DataFrame:
    """(group, feature, self_average, other_average, self_detected, other_detected): a group's mean and detected share, and the
    unweighted mean, or the median, of those of the other groups."""
    s = moments(m, groups.select("sample", "group")).select("feature", "group", "mean", F.try_divide(F.col("detected"), F.col("n")).alias("share"))
    if average == "median":
        others = s.alias("a").join(s.select("feature", F.col("group").alias("g2"), F.col("mean").alias("m2"), F.col("share").alias("s2")), "feature").where("group != g2")
        other = others.groupBy("feature", "group").agg(F.median("m2").alias("other_average"), F.median("s2").alias("other_detected"))
        out = s.join(other, ["feature", "group"], "left")
    elif average == "mean":
        w = Window.partitionBy("feature")
        rest = F.count("*").over(w) - 1
        out = s.withColumn("other_average", F.try_divide(F.sum("mean").over(w) - F.col("mean"), rest)).withColumn("other_detected", F.try_divide(F.sum("share").over(w) - F.col("share"), rest))
    else:
        raise ValueError(f"no average {average!r}")
    return out.select("group", "feature", F.col("mean").alias("self_average"), "other_average", F.col("share").alias("self_detected"), "other_detected")
