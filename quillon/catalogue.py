"""Registered queries of the matrix engine and the SQL that checks them.

Matrices on the test tables: *sales* (part by supplier, sums of quantity; groups: the supplier's region; blocks: key mod 2; feature
sets: brands), *embed* (place in the vector by vec_id; groups: label), *activity* (event type by user). The SQL computes on
the dense product of both axes. Doubles are rounded on both sides.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon import catalogue_io
from quillon.operators import aggregate, correlate, linear, markers, moments, normalize, qc, variance
from quillon.plans.matrix import REALIZED, SparseMatrix
from quillon.sources import files, writer

DIGITS = 6


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int = DIGITS) -> DataFrame:
    """Doubles rounded, and without negative zeros."""
    return df.select(*((F.round(F.col(f"`{n}`"), digits) + 0.0).alias(n) if t == "double" else F.col(f"`{n}`") for n, t in df.dtypes))


# --- the matrices ---------------------------------------------------------------------------


def sales(spark: SparkSession, d: str) -> SparseMatrix:
    lines = table(spark, d, "lineitem")
    cells = files.dealt(lines.select("l_partkey", "l_suppkey", "l_quantity"), lines.count(), "l_partkey", "l_suppkey").groupBy("l_partkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    return SparseMatrix.attach(cells, table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey"), "l_partkey", "l_suppkey", "q")


def regions(spark: SparkSession, d: str) -> DataFrame:
    nations = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("sample"), F.col("r_name").alias("group"))


def blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample"), (F.col("s_suppkey") % 2).alias("block"))


def brands(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_brand", "p_partkey")


def overlapping(spark: SparkSession, d: str) -> DataFrame:
    """Sets by brand and by type: each part is in two."""
    return brands(spark, d).unionAll(table(spark, d, "part").select("p_type", "p_partkey"))


def set_of(spark: SparkSession, d: str, axis: str) -> DataFrame:
    """Two overlapping sets, of parts or of suppliers."""
    if axis == "feature":
        dim = table(spark, d, "part")
        sets = {"large": dim.where("p_size >= 25").select("p_partkey"), "dear": dim.where("p_retailprice >= 905").select("p_partkey")}
    else:
        dim = table(spark, d, "supplier")
        sets = {"rich": dim.where("s_acctbal >= 0").select("s_suppkey"), "early": dim.where("s_nationkey < 12").select("s_suppkey")}
    first, second = (keys.select(F.lit(name).alias("set"), keys.columns[0]) for name, keys in sets.items())
    return first.unionAll(second)


def factors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("sample"), (F.col("s_suppkey") % 7 + 1).cast("double").alias("size_factor"))


def embed(spark: SparkSession, d: str) -> SparseMatrix:
    rows = table(spark, d, "embeddings")
    cells = rows.select("vec_id", F.posexplode("embedding").alias("pos", "x")).select("pos", "vec_id", F.col("x").cast("double").alias("x"))
    width = rows.agg(F.max(F.size("embedding"))).first()[0] or 0
    return SparseMatrix.attach(cells, spark.range(width).select(F.col("id").cast("int").alias("pos")), rows.select("vec_id"), "pos", "vec_id", "x")


def labels_of(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("sample"), F.col("label").alias("group"))


def vec_blocks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("sample"), (F.col("vec_id") % 2).alias("block"))


def covariate(spark: SparkSession, d: str) -> DataFrame:
    """An intercept and a number for each vector."""
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("sample"), F.lit(1.0).alias("one"), (F.col("vec_id") % 5).cast("double").alias("z"))


def activity(spark: SparkSession, d: str) -> SparseMatrix:
    events = table(spark, d, "events")
    cells = events.groupBy("event_type", "user_id").agg(F.count("*").cast("double").alias("n"))
    return SparseMatrix.attach(cells, events.select("event_type").distinct(), events.select("user_id").distinct(), "event_type", "user_id", "n")


# --- SQL of the matrices --------------------------------------------------------------------

SALES = """WITH coo AS (SELECT l_partkey AS feature, l_suppkey AS sample, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2),
dense AS (SELECT p_partkey AS feature, s_suppkey AS sample, coalesce(v, 0::DOUBLE) AS v FROM part CROSS JOIN supplier
  LEFT JOIN coo ON feature = p_partkey AND sample = s_suppkey),
reg AS (SELECT s_suppkey AS sample, r_name AS g FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
lib AS (SELECT sample, sum(v) AS total FROM dense GROUP BY 1),
lsf AS (SELECT sample, total / (SELECT avg(total) FROM lib) AS sf FROM lib),
usf0 AS (SELECT s_suppkey AS sample, (s_suppkey % 7 + 1)::DOUBLE AS sf FROM supplier),
usf AS (SELECT sample, sf / (SELECT avg(sf) FROM usf0) AS sf FROM usf0)
"""
EMBED = """WITH dense AS (SELECT CAST(generate_subscripts(embedding, 1) - 1 AS INTEGER) AS feature, vec_id AS sample, unnest(embedding)::DOUBLE AS v, label AS g FROM embeddings)
"""


def R(x: str, digits: int = DIGITS) -> str:  # noqa: N802
    return f"round({x}, {digits}) + 0::DOUBLE"


def _moments_sql(keys: str, where: str = "") -> str:
    k = ", ".join(keys.split()) if keys else ""
    pre = f", {k}" if k else ""
    return f"""SELECT feature{pre}, count(*) AS n, {R('avg(v)')} AS mean, {R('CASE WHEN count(*) > 1 THEN var_samp(v) END')} AS var,
  CAST(sum(CASE WHEN v > 1e-8 THEN 1 ELSE 0 END) AS BIGINT) AS detected FROM x {where} GROUP BY feature{pre}"""


_GROUPED = """, x AS (SELECT feature, sample, v, g AS "group" FROM dense JOIN reg USING (sample))"""
_PAIRS = """, m AS (SELECT feature, "group", count(*)::DOUBLE AS n, avg(v) AS mean, var_samp(v) AS var, sum(CASE WHEN v > 1e-8 THEN 1 ELSE 0 END)::DOUBLE AS det FROM x GROUP BY 1, 2),
p AS (SELECT a.feature, a."group" AS first, b."group" AS second, a.n AS n1, b.n AS n2, a.mean AS mean1, b.mean AS mean2, a.var AS var1, b.var AS var2, a.det AS det1, b.det AS det2
  FROM m a JOIN m b ON a.feature = b.feature AND a."group" <> b."group")"""
_EMBED_X = """, x AS (SELECT feature, sample, v, g AS "group" FROM dense)"""
#: Tail probabilities by Simpson's rule on 201 nodes, and binomial tails as sums.
_NODES = ", nodes AS (SELECT i, CASE WHEN i = 0 OR i = 200 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END AS w FROM range(0, 201) AS t(i))"
_T = """, t AS (SELECT *, mean1 - mean2 AS delta, greatest(var1, 1e-8) / n1 AS e1, greatest(var2, 1e-8) / n2 AS e2 FROM p),
tt AS (SELECT feature, first, second, delta, e1 + e2 AS err2, (e1 + e2) * (e1 + e2) / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)) AS df FROM t)"""
_T_P = """, q AS (SELECT feature, first, second, delta, df, atan(abs(delta) / sqrt(err2) / sqrt(df)) AS a FROM tt),
u AS (SELECT feature, first, second, delta, any_value(df) AS df, any_value(a) / 600 * sum(w * pow(cos(i * a / 200), df - 1)) AS area FROM q CROSS JOIN nodes GROUP BY 1, 2, 3, 4),
pv AS (SELECT feature, first, second, delta AS effect, greatest(0::DOUBLE, least(1::DOUBLE, 2 * (0.5::DOUBLE - exp(lgamma((df + 1) / 2) - lgamma(df / 2)) / sqrt(pi()) * area))) AS p FROM u)"""
_BH = """SELECT feature, first, second, {e} AS effect, {p} AS p_value, {f} AS fdr FROM (
  SELECT *, least(1::DOUBLE, min(raw) OVER (PARTITION BY first, second ORDER BY p DESC, feature DESC ROWS UNBOUNDED PRECEDING)) AS fdr FROM (
    SELECT *, p * count(*) OVER (PARTITION BY first, second) / row_number() OVER (PARTITION BY first, second ORDER BY p, feature) AS raw FROM pv))"""
_BH_SQL = _BH.format(e=R("effect"), p=R("p"), f=R("fdr"))


#: Sets are listed in the order of their names, as the columns are.
_PART_SETS = {"dear": "feature IN (SELECT p_partkey FROM part WHERE p_retailprice >= 905)", "large": "feature IN (SELECT p_partkey FROM part WHERE p_size >= 25)"}
_SUPPLIER_SETS = {"early": "sample IN (SELECT s_suppkey FROM supplier WHERE s_nationkey < 12)", "rich": "sample IN (SELECT s_suppkey FROM supplier WHERE s_acctbal >= 0)"}


def _cell_qc(t: str, subsets: bool = False) -> str:
    hit = "v <> 0" if t == "0" else f"v > {t}"
    sql = f"{SALES} SELECT sample, {R('sum(v)')} AS sum, CAST(sum(CASE WHEN {hit} THEN 1 ELSE 0 END) AS BIGINT) AS detected"
    for s, c in _PART_SETS.items() if subsets else ():
        sql += f", {R(f'sum(CASE WHEN {c} THEN v ELSE 0 END)')} AS subsets_{s}_sum, CAST(sum(CASE WHEN {c} AND {hit} THEN 1 ELSE 0 END) AS BIGINT) AS subsets_{s}_detected, {R(f'100 * sum(CASE WHEN {c} THEN v ELSE 0 END) / nullif(sum(v), 0)')} AS subsets_{s}_percent"
    return sql + " FROM dense GROUP BY sample"


def _feature_qc(t: str, subsets: bool = False) -> str:
    hit = "v <> 0" if t == "0" else f"v > {t}"
    sql = f"{SALES} SELECT feature, {R('avg(v)')} AS mean, {R(f'100 * avg(CASE WHEN {hit} THEN 1.0::DOUBLE ELSE 0 END)')} AS detected"
    for s, c in _SUPPLIER_SETS.items() if subsets else ():
        sql += f", {R(f'avg(CASE WHEN {c} THEN v END)')} AS subsets_{s}_mean, {R(f'100 * avg(CASE WHEN {c} THEN CASE WHEN {hit} THEN 1.0::DOUBLE ELSE 0 END END)')} AS subsets_{s}_detected, {R(f'avg(CASE WHEN {c} THEN v END) / nullif(avg(v), 0)')} AS subsets_{s}_ratio"
    return sql + " FROM dense GROUP BY feature"


def _cells_sql(value: str, frm: str = "coo JOIN lsf USING (sample)") -> str:
    return f"{SALES} SELECT feature, sample, {R(value)} AS value FROM {frm}"


def _sets_sql(value: str, sets: str = "SELECT p_brand AS set, p_partkey AS feature FROM part") -> str:
    return f"{SALES}, sets AS ({sets}) SELECT set, sample, {value} AS value FROM dense JOIN sets USING (feature) GROUP BY set, sample"


_OVERLAP = "SELECT p_brand AS set, p_partkey AS feature FROM part UNION ALL SELECT p_type, p_partkey FROM part"


def _group_sql(column: str, name: str) -> str:
    return f'{SALES} SELECT feature, g AS "group", count(*) AS ncells, {column} AS {name} FROM dense JOIN reg USING (sample) GROUP BY 1, 2'


_GROUP_WIDE = f"""{SALES} SELECT feature, round(sum(CASE WHEN g = 'ASIA' THEN v END), 6) + 0::DOUBLE AS "ASIA",
  round(sum(CASE WHEN g = 'EUROPE' THEN v END), 6) + 0::DOUBLE AS "EUROPE" FROM dense JOIN reg USING (sample) GROUP BY 1"""


# --- tails and combined tests as SQL --------------------------------------------------------


def _upper_t(t: str) -> str:
    """P(T > t), from a column half of _HALF."""
    return f"(0.5::DOUBLE - sign({t}) * half)"


def _half(source: str, keys: str) -> str:
    """Of rows (keys, t, df), the probability between 0 and |t| (half), by Simpson's rule over the angle atan(t / sqrt(df))."""
    return f"""SELECT {keys}, any_value(t) AS t, any_value(df) AS df, exp(lgamma((any_value(df) + 1) / 2) - lgamma(any_value(df) / 2)) / sqrt(pi()) * any_value(a) / 600 * sum(w * pow(cos(i * a / 200), df - 1)) AS half
  FROM (SELECT *, atan(abs(t) / sqrt(df)) AS a FROM {source}) CROSS JOIN nodes GROUP BY {keys}"""


def _phi(z: str, keys: str, source: str, rest: str = "") -> str:
    """Of rows (keys, z), the normal distribution function (phi)."""
    return f"SELECT {keys}, CASE WHEN any_value({z}) = 'Infinity' THEN 1::DOUBLE ELSE 0.5::DOUBLE + any_value({z}) / 600 * sum(w * exp(-({z} * i / 200) * ({z} * i / 200) / 2)) / sqrt(2 * pi()) END AS phi{rest} FROM {source} CROSS JOIN nodes GROUP BY {keys}"


def _qnorm(p: str) -> str:
    """The normal quantile, by a published rational approximation (relative error 1e-9)."""

    def poly(x: str, *c: str) -> str:
        out = c[0]
        for k in c[1:]:
            out = f"({out} * {x} + {k})"
        return out

    # Fixed values of the approximation.
    a = ("-39.69683028665376", "220.9460984245205", "-275.9285104469687", "138.3577518672690", "-30.66479806614716", "2.506628277459239")
    b = ("-54.47609879822406", "161.5858368580409", "-155.6989798598866", "66.80131188771972", "-13.28068155288572", "1")
    c = ("-0.007784894002430293", "-0.3223964580411365", "-2.400758277161838", "-2.549732539343734", "4.374664141464968", "2.938163982698783")
    d = ("0.007784695709041462", "0.3224671290700398", "2.445134137142996", "3.754408661907416", "1")
    mid, low, high = f"({p} - 0.5::DOUBLE)", f"sqrt(-2 * ln({p}))", f"sqrt(-2 * ln(1 - {p}))"
    square = f"({mid} * {mid})"
    return (
        f"CASE WHEN {p} >= 1 THEN 'Infinity'::DOUBLE WHEN {p} < 0.02425 THEN {poly(low, *c)} / {poly(low, *d)} WHEN {p} > 0.97575 THEN -{poly(high, *c)} / {poly(high, *d)} "
        f"ELSE {mid} * {poly(square, *a)} / {poly(square, *b)} END"
    )


def _t_direction(shift: str, p: str) -> str:
    """pv of Welch tests whose statistic is delta less shift."""
    keys = "feature, first, second, delta"
    return f", q AS (SELECT {keys}, df, (delta - {shift}) / sqrt(err2) AS t FROM tt), h AS ({_half('q', keys)}), pv AS (SELECT feature, first, second, delta AS effect, {p} AS p FROM h)"


_STOUFFER = f""", z AS (SELECT feature, first, second, sum(w * ({_qnorm('l')})) / sqrt(sum(w * w)) AS zl, sum(w * ({_qnorm('r')})) / sqrt(sum(w * w)) AS zr, sum(w * effect) / sum(w) AS effect FROM tails GROUP BY 1, 2, 3),
zz AS (SELECT feature, first, second, effect, least(zl, zr) AS z FROM z), ph AS ({_phi('z', 'feature, first, second, effect', 'zz')}), pv AS (SELECT feature, first, second, effect, least(1::DOUBLE, 2 * phi) AS p FROM ph)"""
_BLOCK_PAIRS = """, m AS (SELECT feature, "group", block, count(*)::DOUBLE AS n, avg(v) AS mean, var_samp(v) AS var, sum(CASE WHEN v > 1e-8 THEN 1 ELSE 0 END)::DOUBLE AS det FROM x GROUP BY 1, 2, 3),
p AS (SELECT a.feature, a."group" AS first, b."group" AS second, a.block, a.n AS n1, b.n AS n2, a.mean AS mean1, b.mean AS mean2, a.var AS var1, b.var AS var2, a.det AS det1, b.det AS det2
  FROM m a JOIN m b ON a.feature = b.feature AND a.block = b.block AND a."group" <> b."group")"""
_T_BLOCKED = f"""{_BLOCK_PAIRS}, t0 AS (SELECT *, mean1 - mean2 AS delta, greatest(var1, 1e-8) / n1 AS e1, greatest(var2, 1e-8) / n2 AS e2 FROM p WHERE n1 > 1 AND n2 > 1),
q AS (SELECT feature, first, second, block, delta, 1 / (1 / n1 + 1 / n2) AS wt, (e1 + e2) * (e1 + e2) / (e1 * e1 / (n1 - 1) + e2 * e2 / (n2 - 1)) AS df, delta / sqrt(e1 + e2) AS t FROM t0),
h AS ({_half('q', 'feature, first, second, block, delta, wt')}),
tails AS (SELECT feature, first, second, wt AS w, delta AS effect, 1 - {_upper_t('t')} AS l, {_upper_t('t')} AS r FROM h){_STOUFFER}"""
_BINOM_EFFECT = "log2((det1 + n1 / m0) / (n1 + 2 * n1 / m0)) - log2((det2 + n2 / m0) / (n2 + 2 * n2 / m0))"
#: Groups compared beside one covariate, by what is left of it within groups.
_T_DESIGN = f""", y AS (SELECT *, CAST(sample % 5 AS DOUBLE) AS z FROM x),
gm AS (SELECT feature, "group", count(*)::DOUBLE AS n, avg(v) AS mv, avg(z) AS mz FROM y GROUP BY 1, 2),
ss AS (SELECT feature, sum((v - mv) * (z - mz)) AS svz, sum((z - mz) * (z - mz)) AS szz, sum((v - mv) * (v - mv)) AS svv, count(*) - count(DISTINCT "group") - 1 AS df FROM y JOIN gm USING (feature, "group") GROUP BY 1),
q AS (SELECT a.feature, a."group" AS first, b."group" AS second, a.mv - b.mv - svz / szz * (a.mz - b.mz) AS delta, df::DOUBLE AS df,
  (a.mv - b.mv - svz / szz * (a.mz - b.mz)) / sqrt((svv - svz * svz / szz) / df * (1 / a.n + 1 / b.n + (a.mz - b.mz) * (a.mz - b.mz) / szz)) AS t
  FROM gm a JOIN gm b ON a.feature = b.feature AND a."group" <> b."group" JOIN ss ON ss.feature = a.feature),
h AS ({_half('q', 'feature, first, second, delta')}), pv AS (SELECT feature, first, second, delta AS effect, least(1::DOUBLE, 1 - 2 * half) AS p FROM h)"""
#: Comparisons of a group in the order of p (r of k), and the rank of a feature within each (rk).
_COMPARED = """, o AS (SELECT *, row_number() OVER (PARTITION BY first, feature ORDER BY p, second) AS r, count(*) OVER (PARTITION BY first, feature) AS k, row_number() OVER (PARTITION BY first, second ORDER BY p, feature) AS rk FROM pv)"""
_MARKERS = f"""SELECT "group", feature, CAST(top AS BIGINT) AS top, {R('p')} AS p_value, {R('e')} AS summary_effect, {R('least(1::DOUBLE, min(raw) OVER (PARTITION BY "group" ORDER BY p DESC, feature DESC ROWS UNBOUNDED PRECEDING))')} AS fdr
  FROM (SELECT *, p * count(*) OVER (PARTITION BY "group") / row_number() OVER (PARTITION BY "group" ORDER BY p, feature) AS raw FROM b)"""
_BINOM_BLOCKED = f"""{_BLOCK_PAIRS}, k AS (SELECT *, det1 + det2 AS size, n1 / (n1 + n2) AS p0, (n1 + n2) / 2 AS m0 FROM p),
bt AS (SELECT feature, first, second, block, n1, n2, m0, det1, det2, size, i, exp(lgamma(size + 1) - (CASE WHEN i < 1 THEN 0 ELSE lgamma(i + 1) END) - (CASE WHEN size - i < 1 THEN 0 ELSE lgamma(size - i + 1) END) + i * ln(p0) + (size - i) * ln(1 - p0)) AS d FROM k CROSS JOIN range(0, 2000) AS t(i) WHERE i <= size),
tails AS (SELECT feature, first, second, n1 + n2 AS w, log2((det1 + n1 / m0) / (n1 + 2 * n1 / m0)) - log2((det2 + n2 / m0) / (n2 + 2 * n2 / m0)) AS effect,
  CASE WHEN det1 = size THEN 1::DOUBLE ELSE least(1::DOUBLE, sum(CASE WHEN i <= det1 THEN d ELSE 0 END)) END AS l, CASE WHEN det1 = 0 THEN 1::DOUBLE ELSE least(1::DOUBLE, sum(CASE WHEN i >= det1 THEN d ELSE 0 END)) END AS r
  FROM bt GROUP BY feature, first, second, block, n1, n2, m0, det1, det2, size){_STOUFFER}"""
_WILCOX = f"""{SALES}, x AS (SELECT feature, g, v FROM dense JOIN reg USING (sample)), c AS (SELECT feature, g, v, count(*)::DOUBLE AS c FROM x GROUP BY 1, 2, 3),
n AS (SELECT g, count(*)::DOUBLE AS n FROM reg GROUP BY 1), pr AS (SELECT a.g AS first, b.g AS second, a.n AS n1, b.n AS n2 FROM n a JOIN n b ON a.g <> b.g),
u AS (SELECT a.feature, a.g AS first, b.g AS second, sum(a.c * b.c * CASE WHEN a.v > b.v THEN 1 WHEN a.v = b.v THEN 0.5::DOUBLE ELSE 0 END) AS u FROM c a JOIN c b ON a.feature = b.feature AND a.g <> b.g GROUP BY 1, 2, 3),
ti AS (SELECT feature, first, second, sum(t * t * t - t) AS ties FROM (SELECT feature, first, second, v, sum(c) AS t FROM c JOIN pr ON g = first OR g = second GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
s AS (SELECT feature, first, second, u / (n1 * n2) AS effect, u - n1 * n2 / 2 AS shift, n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1))) AS var FROM u JOIN ti USING (feature, first, second) JOIN pr USING (first, second)),
z AS (SELECT feature, first, second, effect, var, CASE WHEN var > 0 THEN least((shift + 0.5::DOUBLE) / sqrt(var), -(shift - 0.5::DOUBLE) / sqrt(var)) ELSE 0::DOUBLE END AS z FROM s){_NODES},
ph AS ({_phi('z', 'feature, first, second, effect, var', 'z')}), pv AS (SELECT feature, first, second, effect, CASE WHEN var > 0 THEN least(1::DOUBLE, 2 * phi) ELSE 1::DOUBLE END AS p FROM ph) {_BH_SQL}"""


def _realized(m: SparseMatrix) -> DataFrame:
    """All cells by way of the driver, or, where they are too many for it, left where they are made."""
    if m.n_features * m.n_samples > REALIZED:
        return m.dense()
    return m.spark.createDataFrame(m.realized().stack().rename("value").reset_index())


def _pairs_of_embed(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(0, 1), (5, 3), (10, 63), (7, 7)], "feature1 int, feature2 int")


_CORR = """, s AS (SELECT feature, sum(v) AS s, sum(v * v) AS q, count(*)::DOUBLE AS n FROM dense GROUP BY 1),
c AS (SELECT a.feature AS f1, b.feature AS f2, sum(a.v * b.v) AS p FROM dense a JOIN dense b ON a.sample = b.sample {on} GROUP BY 1, 2)
SELECT f1 AS feature1, f2 AS feature2, {r} AS rho FROM c JOIN s x ON x.feature = f1 JOIN s y ON y.feature = f2"""
_RHO = R("CASE WHEN (x.q - x.s * x.s / x.n) * (y.q - y.s * y.s / y.n) > 0 THEN (p - x.s * y.s / x.n) / sqrt((x.q - x.s * x.s / x.n) * (y.q - y.s * y.s / y.n)) END")

#: The t-test of a correlation, with fdr over all pairs.
_CORR_P = f"""{_NODES}{_CORR.format(on='AND a.feature < b.feature', r=_RHO.replace('round(', '(').replace(', 6) + 0::DOUBLE', ')')).replace('SELECT f1 AS feature1', ', co AS (SELECT f1 AS feature1').replace('FROM c JOIN', 'FROM c JOIN')}),
q AS (SELECT feature1, feature2, rho, (SELECT count(*) FROM (SELECT DISTINCT sample FROM dense)) - 2::DOUBLE AS df, abs(rho) * sqrt(((SELECT count(*) FROM (SELECT DISTINCT sample FROM dense)) - 2) / (1 - rho * rho)) AS t FROM co),
h AS ({_half('q', 'feature1, feature2, rho')}), pv AS (SELECT feature1, feature2, rho, greatest(0::DOUBLE, 1 - 2 * half) AS p FROM h),
b AS (SELECT *, p * count(*) OVER () / row_number() OVER (ORDER BY p, feature1, feature2) AS raw FROM pv)
SELECT feature1, feature2, {R('rho')} AS rho, {R('p')} AS p_value, {R('least(1::DOUBLE, min(raw) OVER (ORDER BY p DESC, feature1 DESC, feature2 DESC ROWS UNBOUNDED PRECEDING))')} AS fdr FROM b"""

_EFFECT = """CASE WHEN var1 + var2 IS NOT NULL THEN (mean1 - mean2) / sqrt(greatest((var1 + var2) / 2, 1e-8)) END AS cohen,
  CASE WHEN var1 + var2 IS NOT NULL THEN (mean1 - mean2) / sqrt(greatest(var1 / n1 + var2 / n2, 1e-8)) END AS z, mean1 - mean2 AS delta_mean,
  ln((det1 + 0.5::DOUBLE) / (n1 + 1)) / ln(2::DOUBLE) - ln((det2 + 0.5::DOUBLE) / (n2 + 1)) / ln(2::DOUBLE) AS lfc_detected"""
_EFFECTS = f"""{_PAIRS}{_NODES}, e0 AS (SELECT feature, first, second, {_EFFECT} FROM p),
e AS (SELECT feature, first, second, any_value(cohen) AS cohen, 0.5::DOUBLE + any_value(z) / 600 * sum(w * exp(-(z * i / 200) * (z * i / 200) / 2)) / sqrt(2 * pi()) AS auc, any_value(delta_mean) AS delta_mean, any_value(lfc_detected) AS lfc_detected FROM e0 CROSS JOIN nodes GROUP BY 1, 2, 3)"""
_BINOM = """, k AS (SELECT feature, first, second, n1, n2, det1, det1 + det2 AS size, n1 / (n1 + n2) AS p0 FROM p),
bt AS (SELECT feature, first, second, i, det1, CASE WHEN size = 0 THEN 1::DOUBLE ELSE exp(lgamma(size + 1) - (CASE WHEN i < 1 THEN 0 ELSE lgamma(i + 1) END) - (CASE WHEN size - i < 1 THEN 0 ELSE lgamma(size - i + 1) END) + i * ln(p0) + (size - i) * ln(1 - p0)) END AS d FROM k CROSS JOIN range(0, 2000) AS t(i) WHERE i <= size),
pv AS (SELECT feature, first, second, 0::DOUBLE AS effect, least(1::DOUBLE, 2 * least(sum(CASE WHEN i <= det1 THEN d ELSE 0 END), sum(CASE WHEN i >= det1 THEN d ELSE 0 END))) AS p FROM bt GROUP BY 1, 2, 3)"""
_AUC = f"""{SALES}, x AS (SELECT feature, g, v FROM dense JOIN reg USING (sample))
SELECT a.feature, a.g AS first, b.g AS second, {R('avg(CASE WHEN a.v - {l} > b.v THEN 1.0::DOUBLE WHEN a.v - {l} = b.v THEN 0.5::DOUBLE ELSE 0 END)')} AS auc FROM x a JOIN x b ON a.feature = b.feature AND a.g <> b.g GROUP BY 1, 2, 3"""


def _entries() -> dict:
    """name: (query, SQL or None)."""
    cells = lambda m: m.cells.select("feature", "sample", "value")
    t_columns = ["feature", "first", "second"]

    def welch(m: SparseMatrix, g: DataFrame) -> DataFrame:
        return markers.welch(markers._pairs(moments.moments(m, g), ["n", "mean", "var"], False))

    def sum_set(sql: str) -> str:
        return _sets_sql(R(sql))

    embed_both = ', x AS (SELECT feature, sample, v, g AS "group", CAST(sample % 2 AS BIGINT) AS block FROM dense)'
    by_block = ', x AS (SELECT feature, sample, v, CAST(sample % 2 AS BIGINT) AS block FROM dense)'
    both = ', x AS (SELECT feature, sample, v, g AS "group", CAST(sample % 2 AS BIGINT) AS block FROM dense JOIN reg USING (sample))'
    log_x = ", x AS (SELECT feature, sample, log2(v / sf + 1) AS v FROM dense JOIN lsf USING (sample))"
    raw_x = ", x AS (SELECT feature, sample, v / sf AS v FROM dense JOIN lsf USING (sample))"
    summary_cols = ", ".join(f"{R(f'avg({c})')} AS mean_{c}, {R(f'median({c})')} AS median_{c}, {R(f'min({c})')} AS min_{c}, {R(f'max({c})')} AS max_{c}" for c in ("cohen", "auc", "lfc_detected"))
    self_other = """, m2 AS (SELECT feature, "group", avg(v) AS mean, avg(CASE WHEN v > 1e-8 THEN 1.0::DOUBLE ELSE 0 END) AS share FROM x GROUP BY 1, 2)"""
    self_sql = f"""SELECT a."group", a.feature, {R('any_value(a.mean)')} AS self_average, {R('avg(b.mean)')} AS other_average, {R('any_value(a.share)')} AS self_detected, {R('avg(b.share)')} AS other_detected FROM m2 a JOIN m2 b ON a.feature = b.feature AND a."group" <> b."group" GROUP BY 1, 2"""
    scored = [f"{s}_{c}" for c in ("cohen", "auc", "lfc_detected") for s in ("mean", "median", "min", "max")]
    sales_group = f"{SALES}{_GROUPED}"
    embed_group = f"{EMBED}{_EMBED_X}"
    return {
        "cell_qc": (lambda s, d: rounded(qc.per_sample_qc(sales(s, d))), _cell_qc("0")),
        "cell_qc_threshold": (lambda s, d: rounded(qc.per_sample_qc(sales(s, d), threshold=30.0)), _cell_qc("30")),
        "cell_qc_subsets": (lambda s, d: rounded(qc.per_sample_qc(sales(s, d), set_of(s, d, "feature"))), _cell_qc("0", True)),
        "cell_qc_top": (lambda s, d: rounded(qc.per_sample_qc(sales(s, d), percent_top=(10, 50))), f"{SALES}, r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY v DESC, feature) AS k FROM dense) SELECT sample, {R('sum(v)')} AS sum, CAST(sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS detected, {R('100 * sum(CASE WHEN k <= 10 THEN v ELSE 0 END) / nullif(sum(v), 0)')} AS percent_top_10, {R('100 * sum(CASE WHEN k <= 50 THEN v ELSE 0 END) / nullif(sum(v), 0)')} AS percent_top_50 FROM r GROUP BY sample"),
        "feature_qc": (lambda s, d: rounded(qc.per_feature_qc(sales(s, d))), _feature_qc("0")),
        "feature_qc_threshold": (lambda s, d: rounded(qc.per_feature_qc(sales(s, d), threshold=30.0)), _feature_qc("30")),
        "feature_qc_subsets": (lambda s, d: rounded(qc.per_feature_qc(sales(s, d), set_of(s, d, "sample"))), _feature_qc("0", True)),
        "size_factors_library": (lambda s, d: rounded(normalize.library_size_factors(sales(s, d))), f"{SALES} SELECT sample, {R('sf')} AS size_factor FROM lsf"),
        "size_factors_geometric": (lambda s, d: rounded(normalize.geometric_size_factors(sales(s, d))), f"{SALES}, g AS (SELECT sample, pow(2::DOUBLE, avg(log2(v + 1))) AS x FROM dense GROUP BY 1) SELECT sample, {R('x / (SELECT avg(x) FROM g)')} AS size_factor FROM g"),
        "normalize_log": (lambda s, d: rounded(cells(normalize.normalized(sales(s, d)))), _cells_sql("log2(v / sf + 1)")),
        "normalize_none": (lambda s, d: rounded(cells(normalize.normalized(sales(s, d), factors(s, d), transform="none"))), _cells_sql("v / sf", "coo JOIN usf USING (sample)")),
        "normalize_asinh": (lambda s, d: rounded(cells(normalize.normalized(sales(s, d), factors(s, d), transform="asinh", center=False))), _cells_sql("asinh(v / sf) / ln(2)", "coo JOIN usf0 USING (sample)")),
        "normalize_pc3": (lambda s, d: rounded(normalize.normalized(sales(s, d), pseudo_count=3.0).dense()), _cells_sql("log2(v / sf + 3)", "dense JOIN lsf USING (sample)")),
        "cpm": (lambda s, d: rounded(cells(normalize.cpm(sales(s, d)))), _cells_sql("v / (total / 1e6)", "coo JOIN lib USING (sample)")),
        "cpm_sf": (lambda s, d: rounded(cells(normalize.cpm(sales(s, d), factors(s, d)))), _cells_sql("v / (sf * (SELECT avg(total / 1e6) FROM lib))", "coo JOIN usf USING (sample)")),
        "tpm": (lambda s, d: rounded(cells(normalize.tpm(sales(s, d), table(s, d, "part").select(F.col("p_partkey").alias("feature"), F.col("p_size").alias("length"))))), f"{SALES}, y AS (SELECT feature, sample, v / p_size AS v FROM coo JOIN part ON p_partkey = feature), l AS (SELECT sample, sum(v) / 1e6 AS t FROM y GROUP BY 1) SELECT feature, sample, {R('v / t')} AS value FROM y JOIN l USING (sample)"),
        "average_counts": (lambda s, d: rounded(normalize.average(sales(s, d))), f"{SALES} SELECT feature, {R('avg(v / sf)')} AS average FROM dense JOIN lsf USING (sample) GROUP BY 1"),
        "sets_detected": (lambda s, d: aggregate.detected_across_features(sales(s, d), brands(s, d)), _sets_sql("CAST(sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS BIGINT)")),
        "sets_detected_avg": (lambda s, d: rounded(aggregate.detected_across_features(sales(s, d), brands(s, d), average=True, threshold=5.0)), sum_set("avg(CASE WHEN v > 5 THEN 1.0::DOUBLE ELSE 0 END)")),
        "sets_sum": (lambda s, d: rounded(aggregate.sum_across_features(sales(s, d), brands(s, d))), sum_set("sum(v)")),
        "sets_sum_avg": (lambda s, d: rounded(aggregate.sum_across_features(sales(s, d), brands(s, d), average=True)), sum_set("avg(v)")),
        "sets_overlapping": (lambda s, d: rounded(aggregate.sum_across_features(sales(s, d), overlapping(s, d))), _sets_sql(R("sum(v)"), _OVERLAP)),
        "group_sum": (lambda s, d: rounded(aggregate.summarize_by_group(sales(s, d), regions(s, d), ["sum"])), _group_sql(R("sum(v)"), "sum")),
        "group_mean": (lambda s, d: rounded(aggregate.summarize_by_group(sales(s, d), regions(s, d), ["mean"])), _group_sql(R("avg(v)"), "mean")),
        "group_numdet": (lambda s, d: aggregate.summarize_by_group(sales(s, d), regions(s, d), ["num_detected"]), _group_sql("CAST(sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS BIGINT)", "num_detected")),
        "group_propdet": (lambda s, d: rounded(aggregate.summarize_by_group(sales(s, d), regions(s, d), ["prop_detected"], threshold=3.0)), _group_sql(R("avg(CASE WHEN v > 3 THEN 1.0::DOUBLE ELSE 0 END)"), "prop_detected")),
        "group_wide": (lambda s, d: rounded(aggregate.to_wide(aggregate.summarize_by_group(sales(s, d), regions(s, d), ["sum"]), "feature", "group", "sum", ["ASIA", "EUROPE"])), _GROUP_WIDE),
        "moments_all": (lambda s, d: rounded(moments.moments(sales(s, d))), f"{SALES}, x AS (SELECT feature, sample, v FROM dense) {_moments_sql('')}"),
        "moments_group": (lambda s, d: rounded(moments.moments(sales(s, d), regions(s, d))), f"{sales_group} " + _moments_sql('"group"')),
        "moments_block": (lambda s, d: rounded(moments.moments(sales(s, d), blocks(s, d))), f"{SALES}{by_block} {_moments_sql('block')}"),
        "moments_group_block": (lambda s, d: rounded(moments.moments(sales(s, d), regions(s, d).join(blocks(s, d), "sample"))), f"{SALES}{both} " + _moments_sql('"group" block')),
        "moments_embed": (lambda s, d: rounded(moments.moments(embed(s, d), labels_of(s, d))), f"{embed_group} " + _moments_sql('"group"')),
        "moments_activity": (lambda s, d: rounded(moments.moments(activity(s, d))), f"WITH u AS (SELECT DISTINCT user_id FROM events), e AS (SELECT DISTINCT event_type FROM events), c AS (SELECT event_type, user_id, count(*)::DOUBLE AS v FROM events GROUP BY 1, 2), x AS (SELECT e.event_type AS feature, u.user_id AS sample, coalesce(v, 0::DOUBLE) AS v FROM e CROSS JOIN u LEFT JOIN c ON c.event_type = e.event_type AND c.user_id = u.user_id) {_moments_sql('')}"),
        "moments_normalized": (lambda s, d: rounded(moments.normalized_moments(sales(s, d))), f"{SALES}{raw_x} {_moments_sql('')}"),
        "moments_log_normalized": (lambda s, d: rounded(moments.normalized_moments(sales(s, d), pseudo_count=1.0)), f"{SALES}{log_x} {_moments_sql('')}"),
        "cv2_raw": (lambda s, d: rounded(variance.cv2(moments.normalized_moments(sales(s, d))).select("feature", "mean", "total")), f"{SALES}{raw_x} SELECT feature, {R('avg(v)')} AS mean, {R('var_samp(v) / nullif(avg(v) * avg(v), 0)')} AS total FROM x GROUP BY 1"),
        "var_decomposition": (lambda s, d: rounded(variance.model_gene_var(normalize.normalized(sales(s, d)))), None),
        "var_decomposition_blocked": (lambda s, d: rounded(variance.model_gene_var(normalize.normalized(sales(s, d)), blocks(s, d))), None),
        "var_poisson": (lambda s, d: rounded(variance.model_gene_var_by_poisson(sales(s, d))), None),
        "var_cv2": (lambda s, d: rounded(variance.model_gene_cv2(sales(s, d))), None),
        "ttest_stats": (lambda s, d: rounded(welch(embed(s, d), labels_of(s, d)).select(*t_columns, "delta", "err2", "df"), 5), f"{embed_group}{_PAIRS}{_T} SELECT feature, first, second, {R('delta', 5)} AS delta, {R('err2', 5)} AS err2, {R('df', 5)} AS df FROM tt"),
        "ttest_cohen": (lambda s, d: rounded(markers.pairwise_t_tests(embed(s, d), labels_of(s, d), std_lfc=True, log_p=True).select(*t_columns, "effect")), f"{embed_group}{_PAIRS} SELECT feature, first, second, {R('(mean1 - mean2) / sqrt(((n1 - 1) * var1 + (n2 - 1) * var2) / (n1 + n2 - 2))')} AS effect FROM p"),
        "ttest_pvalues": (lambda s, d: rounded(markers.pairwise_t_tests(embed(s, d), labels_of(s, d))), f"{embed_group}{_PAIRS}{_T}{_NODES}{_T_P} {_BH_SQL}"),
        "ttest_restricted": (lambda s, d: rounded(markers.pairwise_t_tests(embed(s, d), labels_of(s, d), restrict=[0, 1, 2], exclude=[2])), EMBED + ', x AS (SELECT feature, sample, v, g AS "group" FROM dense WHERE g IN (0, 1))' + f"{_PAIRS}{_T}{_NODES}{_T_P} {_BH_SQL}"),
        "ttest_lfc": (lambda s, d: rounded(markers.pairwise_t_tests(embed(s, d), labels_of(s, d), lfc=0.05, direction="up")), f"{embed_group}{_PAIRS}{_T}{_NODES}{_t_direction('0.05', _upper_t('t'))} {_BH_SQL}"),
        "ttest_down": (lambda s, d: rounded(markers.pairwise_t_tests(embed(s, d), labels_of(s, d), direction="down")), f"{embed_group}{_PAIRS}{_T}{_NODES}{_t_direction('0', '1 - ' + _upper_t('t'))} {_BH_SQL}"),
        "ttest_blocked": (lambda s, d: rounded(markers.pairwise_t_tests(embed(s, d), labels_of(s, d), vec_blocks(s, d))), f"{EMBED}{embed_both}{_NODES}{_T_BLOCKED} {_BH_SQL}"),
        "ttest_design": (lambda s, d: rounded(markers.pairwise_t_tests(embed(s, d), labels_of(s, d), design=covariate(s, d))), f"{embed_group}{_NODES}{_T_DESIGN} {_BH_SQL}"),
        "ttest_ordered": (
            lambda s, d: writer.indexed(rounded(markers.in_order_of_pairs(markers.pairwise_t_tests(embed(s, d), labels_of(s, d)), [3, 1, 2])).select(*t_columns, "effect"), "place"),
            f"""{embed_group}{_PAIRS} SELECT feature, first, second, {R('mean1 - mean2')} AS effect, row_number() OVER (ORDER BY coalesce(list_position([3, 1, 2], first), 99), coalesce(list_position([3, 1, 2], second), 99), first, second, feature) AS place FROM p""",
        ),
        "residual_variance": (lambda s, d: rounded(linear.residual_variance(embed(s, d), covariate(s, d))), f"{EMBED} SELECT feature, count(*) AS n, {R('avg(v)')} AS mean, {R('(regr_syy(v, sample % 5) - pow(regr_sxy(v, sample % 5), 2) / regr_sxx(v, sample % 5)) / (count(*) - 2)')} AS var FROM dense GROUP BY 1"),
        "ttest_blocked_effect": (
            lambda s, d: rounded(markers.pairwise_t_tests(embed(s, d), labels_of(s, d), vec_blocks(s, d)).select(*t_columns, "effect")),
            EMBED + f""", m AS (SELECT feature, g, sample % 2 AS b, count(*)::DOUBLE AS n, avg(v) AS mean FROM dense GROUP BY 1, 2, 3) SELECT a.feature, a.g AS first, b.g AS second, {R('sum((a.mean - b.mean) / (1 / a.n + 1 / b.n)) / sum(1 / (1 / a.n + 1 / b.n))')} AS effect FROM m a JOIN m b ON a.feature = b.feature AND a.b = b.b AND a.g <> b.g WHERE a.n >= 2 AND b.n >= 2 GROUP BY 1, 2, 3""",
        ),
        "binom_effects": (lambda s, d: rounded(markers.pairwise_binom(sales(s, d), regions(s, d), log_p=True).select(*t_columns, "effect")), f"{sales_group}{_PAIRS}, f AS (SELECT *, (n1 + n2) / 2 AS m0 FROM p) SELECT feature, first, second, {R('log2((det1 + n1 / m0) / (n1 + 2 * n1 / m0)) - log2((det2 + n2 / m0) / (n2 + 2 * n2 / m0))')} AS effect FROM f"),
        "binom_pvalues": (lambda s, d: rounded(markers.pairwise_binom(sales(s, d), regions(s, d))), f"{sales_group}{_PAIRS}{_BINOM}, fx AS (SELECT feature, first, second, {_BINOM_EFFECT} AS effect FROM (SELECT *, (n1 + n2) / 2 AS m0 FROM p)) SELECT feature, first, second, {R('fx.effect')} AS effect, p_value, fdr FROM ({_BH_SQL}) b JOIN fx USING (feature, first, second)"),
        "binom_blocked": (lambda s, d: rounded(markers.pairwise_binom(sales(s, d), regions(s, d), blocks(s, d))), f"{SALES}{both}{_NODES}{_BINOM_BLOCKED} {_BH_SQL}"),
        "wilcox_pvalues": (lambda s, d: rounded(markers.pairwise_wilcox(sales(s, d), regions(s, d))), _WILCOX),
        "markers_any": (lambda s, d: rounded(markers.find_markers(embed(s, d), labels_of(s, d), sorted_=False)), f"{embed_group}{_PAIRS}{_T}{_NODES}{_T_P}{_COMPARED}, b AS (SELECT first AS \"group\", feature, min(rk) AS top, least(1::DOUBLE, min(p * k / r)) AS p, first(effect ORDER BY p * k / r, r) AS e FROM o GROUP BY 1, 2) {_MARKERS}"),
        "markers_all": (lambda s, d: rounded(markers.find_markers(embed(s, d), labels_of(s, d), pval_type="all", sorted_=False)), f"{embed_group}{_PAIRS}{_T}{_NODES}{_T_P}{_COMPARED}, b AS (SELECT first AS \"group\", feature, max(rk) AS top, max(p) AS p, first(effect ORDER BY p DESC, r DESC) AS e FROM o GROUP BY 1, 2) {_MARKERS}"),
        "markers_some": (
            lambda s, d: rounded(markers.find_markers(embed(s, d), labels_of(s, d), pval_type="some", sorted_=False)),
            f"""{embed_group}{_PAIRS}{_T}{_NODES}{_T_P}{_COMPARED}, h AS (SELECT *, greatest(1, ceil(k * 0.5::DOUBLE)) AS j, least(1::DOUBLE, max(p * (k - r + 1)) OVER (PARTITION BY first, feature ORDER BY r ROWS UNBOUNDED PRECEDING)) AS a FROM o),
b AS (SELECT first AS "group", feature, list_sort(list(rk))[CAST(any_value(j) AS BIGINT)] AS top, max(CASE WHEN r = j THEN a END) AS p, max(CASE WHEN r = j THEN effect END) AS e FROM h GROUP BY 1, 2) {_MARKERS}""",
        ),
        "markers_sorted": (
            lambda s, d: rounded(writer.indexed(markers.find_markers(embed(s, d), labels_of(s, d)), "place")).select("group", "feature", "top", "place"),
            f"{embed_group}{_PAIRS}{_T}{_NODES}{_T_P}{_COMPARED}, b AS (SELECT first AS \"group\", feature, min(rk) AS top, least(1::DOUBLE, min(p * k / r)) AS p FROM o GROUP BY 1, 2) SELECT \"group\", feature, top, row_number() OVER (ORDER BY \"group\", top, p, feature) AS place FROM b",
        ),
        "score_effects": (lambda s, d: rounded(markers.effects(sales(s, d), regions(s, d))), f"{sales_group}{_EFFECTS} SELECT feature, first, second, {R('cohen')} AS cohen, {R('auc')} AS auc, {R('delta_mean')} AS delta_mean, {R('lfc_detected')} AS lfc_detected FROM e"),
        "score_pairings": (lambda s, d: rounded(markers.effects(sales(s, d), regions(s, d), pairings=[["ASIA"], ["EUROPE", "AFRICA"]])), f"{sales_group}{_EFFECTS} SELECT feature, first, second, {R('cohen')} AS cohen, {R('auc')} AS auc, {R('delta_mean')} AS delta_mean, {R('lfc_detected')} AS lfc_detected FROM e WHERE first = 'ASIA' AND second IN ('EUROPE', 'AFRICA')"),
        "score_summary": (lambda s, d: rounded(markers.score_markers(sales(s, d), regions(s, d)).select("group", "feature", *scored)), f'{sales_group}{_EFFECTS} SELECT first AS "group", feature, {summary_cols} FROM e GROUP BY 1, 2'),
        "score_minrank": (
            lambda s, d: markers.score_markers(embed(s, d), labels_of(s, d)).select("group", "feature", "rank_cohen", "rank_auc", "rank_lfc_detected"),
            embed_group + f"""{_PAIRS}, e AS (SELECT feature, first, second, {_EFFECT} FROM p), r AS (SELECT *, rank() OVER (PARTITION BY first, second ORDER BY round(cohen, 12) DESC) AS k, rank() OVER (PARTITION BY first, second ORDER BY z DESC) AS kz, rank() OVER (PARTITION BY first, second ORDER BY round(lfc_detected, 12) DESC) AS kl FROM e)
SELECT first AS "group", feature, CAST(min(k) AS BIGINT) AS rank_cohen, CAST(min(kz) AS BIGINT) AS rank_auc, CAST(min(kl) AS BIGINT) AS rank_lfc_detected FROM r GROUP BY 1, 2""",
        ),
        "score_auc_exact": (lambda s, d: rounded(markers.exact_auc(sales(s, d), regions(s, d)).drop("n1", "n2")), _AUC.replace("{l}", "0")),
        "score_auc_lfc": (lambda s, d: rounded(markers.exact_auc(sales(s, d), regions(s, d), lfc=10.0).drop("n1", "n2")), _AUC.replace("{l}", "10")),
        "marker_summary": (lambda s, d: rounded(markers.summary_marker_stats(sales(s, d), regions(s, d))), f"{sales_group}{self_other} {self_sql}"),
        "corr_all": (lambda s, d: rounded(correlate.correlate_pairs(embed(s, d))), EMBED + _CORR.format(on="AND a.feature < b.feature", r=_RHO)),
        "corr_pairs": (lambda s, d: rounded(correlate.correlate_pairs(embed(s, d), _pairs_of_embed(s, d))), EMBED + ", w AS (SELECT * FROM (VALUES (0, 1), (5, 3), (10, 63), (7, 7)) AS t(a, b))" + _CORR.format(on="JOIN w ON w.a = a.feature AND w.b = b.feature", r=_RHO)),
        "corr_ordered": (lambda s, d: writer.indexed(rounded(correlate.correlate_pairs(embed(s, d), sorted_=True)), "place"), EMBED + _CORR.format(on="AND a.feature < b.feature", r=_RHO).replace(" AS rho FROM", " AS rho, row_number() OVER (ORDER BY f1, f2) AS place FROM")),
        "corr_significance": (lambda s, d: rounded(correlate.correlate_pairs(embed(s, d), significance=True)), EMBED + _CORR_P),
        "qc_ordered": (lambda s, d: writer.indexed((m := sales(s, d)).in_order(rounded(qc.per_sample_qc(m)), "sample"), "place"), f"{SALES} SELECT sample, {R('sum(v)')} AS sum, CAST(sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS detected, row_number() OVER (ORDER BY sample) AS place FROM dense GROUP BY sample"),
        "cell_qc_nested": (
            lambda s, d: rounded(qc.per_sample_qc(sales(s, d), set_of(s, d, "feature"), percent_top=(10,), flatten=False).select("sample", "sum", "detected", F.col("percent_top.10").alias("top"), *(F.col(f"subsets.{n}.{f}").alias(f"{n}_{f}") for n in ("dear", "large") for f in ("sum", "detected", "percent")))),
            f"""{SALES}, r AS (SELECT *, row_number() OVER (PARTITION BY sample ORDER BY v DESC, feature) AS k FROM dense) SELECT sample, {R('sum(v)')} AS sum, CAST(sum(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS detected, {R('100 * sum(CASE WHEN k <= 10 THEN v ELSE 0 END) / nullif(sum(v), 0)')} AS top, """
            + ", ".join(f"{R(f'sum(CASE WHEN {c} THEN v ELSE 0 END)')} AS {n}_sum, CAST(sum(CASE WHEN {c} AND v <> 0 THEN 1 ELSE 0 END) AS BIGINT) AS {n}_detected, {R(f'100 * sum(CASE WHEN {c} THEN v ELSE 0 END) / nullif(sum(v), 0)')} AS {n}_percent" for n, c in _PART_SETS.items())
            + " FROM r GROUP BY sample",
        ),
        "feature_qc_nested": (
            lambda s, d: rounded(qc.per_feature_qc(sales(s, d), set_of(s, d, "sample"), flatten=False).select("feature", "mean", "detected", *(F.col(f"subsets.{n}.{f}").alias(f"{n}_{f}") for n in ("early", "rich") for f in ("mean", "detected", "ratio")))),
            f"""{SALES} SELECT feature, {R('avg(v)')} AS mean, {R('100 * avg(CASE WHEN v <> 0 THEN 1.0::DOUBLE ELSE 0 END)')} AS detected, """
            + ", ".join(f"{R(f'avg(CASE WHEN {c} THEN v END)')} AS {n}_mean, {R(f'100 * avg(CASE WHEN {c} THEN CASE WHEN v <> 0 THEN 1.0::DOUBLE ELSE 0 END END)')} AS {n}_detected, {R(f'avg(CASE WHEN {c} THEN v END) / nullif(avg(v), 0)')} AS {n}_ratio" for n, c in _SUPPLIER_SETS.items())
            + " FROM dense GROUP BY feature",
        ),
        "normalize_fill": (lambda s, d: rounded(normalize.normalized(replace(sales(s, d), fill=1.0), factors(s, d).withColumn("size_factor", F.lit(2.0)), center=False).dense()), f"{SALES}, f AS (SELECT d.feature, d.sample, coalesce(c.v, 1::DOUBLE) AS v FROM dense d LEFT JOIN coo c USING (feature, sample)) SELECT feature, sample, {R('log2(v / 2 + 1)')} AS value FROM f"),
        "realized": (lambda s, d: rounded(_realized(sales(s, d).subset(features=F.col("p_brand") == "Brand#11"))), f"{SALES} SELECT feature, sample, v AS value FROM dense WHERE feature IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#11')"),
        "corr_top_variable": (lambda s, d: rounded(correlate.correlate_pairs((y := normalize.normalized(sales(s, d))).subset(features=variance.top_variable(variance.model_gene_var(y), 20)), significance=True)), None),
        **catalogue_io.entries(),
    }


def queries() -> dict:
    return {name: query for name, (query, _) in _entries().items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _entries().items() if sql}
