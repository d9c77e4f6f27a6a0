"""Pooling over the studies of the driver's tables, by outcome."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolwright.functions import special
from poolwright.functions.special import Z95, t_ppf
from poolwright.operators import pooling
from poolwright.sources.tables import EFFECTS_SQL, effects

from .base import query, rounded, rounded_sql

c = F.col
KEYS = ["outcome"]
#: t quantiles for the df that the oracles meet: 25 studies an outcome, 5 clusters
_T = "tq(df, q) AS (VALUES " + ", ".join(f"({df}, {t_ppf(0.975, df)!r})" for df in range(1, 200)) + ")"

#: fixed-weight sums by outcome, then DL
_FIXED = """f AS (
  SELECT outcome, count(*) AS k, sum(1 / v) AS f1, sum(1 / (v * v)) AS f2, sum(y / v) / sum(1 / v) AS mu, sum(y * y / v) AS yy, sum(y / v) AS wy
  FROM effects GROUP BY outcome HAVING count(*) >= 2
), fq AS (
  SELECT f.outcome, any_value(k) AS k, any_value(f1) AS f1, any_value(f2) AS f2, any_value(mu) AS mu, sum((y - mu) * (y - mu) / v) AS q
  FROM f JOIN effects e ON e.outcome = f.outcome GROUP BY f.outcome
), dl AS (SELECT *, greatest(0, (q - (k - 1)) / (f1 - f2 / f1)) AS tau2_dl FROM fq)"""

#: one scoring step from tau2, by the sums of a group
_STEP = """SELECT t.outcome, t.i + 1, greatest(0, t.tau2 + ({adj})) FROM (
    SELECT it.outcome, it.i, it.tau2, sum(1 / (v + tau2)) AS s1, sum(1 / power(v + tau2, 2)) AS s2, sum(1 / power(v + tau2, 3)) AS s3,
           sum(y / (v + tau2)) / sum(1 / (v + tau2)) AS m, sum(y * y / power(v + tau2, 2)) AS a, sum(y / power(v + tau2, 2)) AS b
    FROM it JOIN effects USING (outcome) WHERE it.i < 100 GROUP BY it.outcome, it.i, it.tau2) t"""
_REML = "((a - 2 * m * b + m * m * s2) - (s1 - s2 / s1)) / (s2 - 2 * s3 / s1 + s2 * s2 / (s1 * s1))"
_ML = "((a - 2 * m * b + m * m * s2) - s1) / s2"


def _tau2_sql(adj: str) -> str:
    return (
        f"WITH RECURSIVE {EFFECTS_SQL}, {_FIXED}, it(outcome, i, tau2) AS (SELECT outcome, 0, tau2_dl FROM dl UNION ALL "
        + _STEP.format(adj=adj)
        + "), tau AS (SELECT outcome, max_by(tau2, i) AS tau2 FROM it GROUP BY outcome)"
    )


_POOL = """, p AS (
  SELECT outcome, any_value(tau2) AS tau2, sum(1 / (v + tau2)) AS sw, sum(y / (v + tau2)) / sum(1 / (v + tau2)) AS mu
  FROM effects JOIN tau USING (outcome) GROUP BY outcome
), pq AS (
  SELECT p.outcome, any_value(p.tau2) AS tau2, any_value(sw) AS sw, any_value(mu) AS mu, sum((y - mu) * (y - mu) / (v + p.tau2)) AS ssw
  FROM p JOIN effects e ON e.outcome = p.outcome GROUP BY p.outcome
), r AS (SELECT pq.*, k, q, (k - 1) * f1 / (f1 * f1 - f2) AS s2, sqrt(1 / sw) AS se FROM pq JOIN fq USING (outcome))"""

_RANDOM_COLUMNS = {
    "estimate": "mu",
    "se": "se",
    "ci_low": f"mu - {Z95} * se",
    "ci_high": f"mu + {Z95} * se",
    "z": "mu / se",
    "tau2": "tau2",
    "tau": "CASE WHEN tau2 < 1e-7 THEN 0.0 ELSE sqrt(tau2) END",
    "q": "q",
    "i2": "greatest(0, (q - (k - 1)) / q)",
    "i2_tau": "tau2 / (tau2 + s2)",
    "h2": "(tau2 + s2) / s2",
    "pi_low_z": f"mu - {Z95} * sqrt(se * se + tau2)",
    "pi_high_z": f"mu + {Z95} * sqrt(se * se + tau2)",
    "pi_low_hts": "mu - t2.q * sqrt(se * se + tau2)",
    "pi_high_hts": "mu + t2.q * sqrt(se * se + tau2)",
    "pi_low_v": "mu - t1.q * sqrt(se * se + tau2)",
    "pi_high_v": "mu + t1.q * sqrt(se * se + tau2)",
}
_RANDOM_SQL = (
    "SELECT outcome, k, "
    + rounded_sql({n: x.replace("q - (k", "r.q - (k").replace("/ q)", "/ r.q)") if n == "i2" else ("r.q" if n == "q" else x) for n, x in _RANDOM_COLUMNS.items()}, 5)
    + " FROM r JOIN tq t1 ON t1.df = k - 1 JOIN tq t2 ON t2.df = k - 2"
)


def _random(spark: SparkSession, sf_dir: str, method: str) -> DataFrame:
    out = pooling.random_effects(effects(spark, sf_dir), KEYS, method)
    # step halving leaves a residue at the boundary, of which the root would show
    out = out.withColumn("tau", F.when(c("tau2") < 1e-7, 0.0).otherwise(c("tau")))
    return rounded(out.select("outcome", "k", *_RANDOM_COLUMNS), 5)


@query(f"WITH {EFFECTS_SQL}, {_T}, {_FIXED}, tau AS (SELECT outcome, tau2_dl AS tau2 FROM dl){_POOL} {_RANDOM_SQL}")
def pool_dl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _random(spark, sf_dir, "DL")


@query(f"{_tau2_sql(_REML)}, {_T}{_POOL} {_RANDOM_SQL}")
def pool_reml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _random(spark, sf_dir, "REML")


@query(f"{_tau2_sql(_ML)}, {_T}{_POOL} {_RANDOM_SQL}")
def pool_ml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _random(spark, sf_dir, "ML")


_PM = f"""WITH RECURSIVE {EFFECTS_SQL}, {_FIXED}, it(outcome, i, lo, hi) AS (
  SELECT outcome, 0, 0.0::DOUBLE, CASE WHEN q <= k - 1 THEN 0.0 ELSE 64.0 END::DOUBLE FROM dl UNION ALL
  SELECT t.outcome, t.i + 1, CASE WHEN big THEN mid ELSE lo END, CASE WHEN big THEN hi ELSE mid END FROM (
    SELECT u.outcome, u.i, u.lo, u.hi, u.mid, sum(y * y / (v + mid)) - power(sum(y / (v + mid)), 2) / sum(1 / (v + mid)) > count(*) - 1 AS big
    FROM (SELECT *, (lo + hi) / 2 AS mid FROM it WHERE i < 70) u JOIN effects USING (outcome) GROUP BY ALL) t
), tau AS (SELECT outcome, max_by((lo + hi) / 2, i) AS tau2 FROM it GROUP BY outcome)"""


@query(f"{_PM}, {_T}{_POOL} {_RANDOM_SQL}")
def pool_pm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _random(spark, sf_dir, "PM")


@query(f"WITH {EFFECTS_SQL}, {_T}, {_FIXED}, tau AS (SELECT outcome, 0.0::DOUBLE AS tau2 FROM dl){_POOL} {_RANDOM_SQL}")
def pool_fe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _random(spark, sf_dir, "FE")


@query(
    f"WITH {EFFECTS_SQL}, {_FIXED} SELECT outcome, k, "
    + rounded_sql(
        {"estimate": "mu", "se": "sqrt(1 / f1)", "ci_low": f"mu - {Z95} * sqrt(1 / f1)", "ci_high": f"mu + {Z95} * sqrt(1 / f1)", "z": "mu * sqrt(f1)", "q": "q"}
    )
    + ", k - 1 AS q_df FROM fq"
)
def pool_fixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pooling.fixed_effects(effects(spark, sf_dir), KEYS).drop("p", "q_p"))


@query(f"WITH {EFFECTS_SQL}, {_FIXED}, g AS (SELECT outcome, sum(1/(v+0.01)) AS s, sum(y/(v+0.01)) AS a, sum(y*y/(v+0.01)) AS b FROM effects GROUP BY 1) SELECT outcome, {rounded_sql({'q_gen': 'b - a * a / s'})} FROM g")
def pool_q_generalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pooling.q_generalised(effects(spark, sf_dir), KEYS, F.lit(0.01)))


@query(
    f"{_tau2_sql(_REML)}, {_T}{_POOL}, hk AS (SELECT *, sqrt(ssw / ((k - 1) * sw)) AS hk FROM r) SELECT outcome, k, "
    + rounded_sql({"estimate": "mu", "se": "hk", "ci_low": "mu - t1.q * hk", "ci_high": "mu + t1.q * hk", "z": "mu / hk"}, 5)
    + ", false AS hk_fallback FROM hk JOIN tq t1 ON t1.df = k - 1"
)
def pool_hartung_knapp(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pooling.random_effects(effects(spark, sf_dir), KEYS, "REML", hartung_knapp=True)
    return rounded(out.select("outcome", "k", "estimate", "se", "ci_low", "ci_high", "z", "hk_fallback"), 5)


@query(
    f"WITH {EFFECTS_SQL}, {_FIXED}, w AS (SELECT e.outcome, study, 1 / (v + tau2_dl) AS w FROM effects e JOIN dl ON dl.outcome = e.outcome) "
    f"SELECT outcome, study, {rounded_sql({'weight_pct': '100 * w / sum(w) OVER (PARTITION BY outcome)'})} FROM w"
)
def pool_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = effects(spark, sf_dir)
    return rounded(pooling.weights(df, KEYS, pooling.tau2_dl(df, KEYS)).select("outcome", "study", "weight_pct"))


@query(
    f"""WITH {EFFECTS_SQL}, per AS (
      SELECT outcome, cluster, count(*) AS kj, avg(v) AS vb, avg(y) AS yb FROM effects GROUP BY 1, 2
    ), a AS (
      SELECT outcome, count(*) AS m, sum(kj) AS k, sum(1 / vb) AS w, sum(1 / (vb * vb)) AS w2, sum(yb / vb) / sum(1 / vb) AS mu0,
             sum(1 / (kj * vb)) / sum(1 / vb) AS ta, sum((kj - 1) / (kj * vb)) / sum(1 / vb) AS tb FROM per GROUP BY 1
    ), qe AS (
      SELECT e.outcome, sum(power(y - mu0, 2) / (kj * vb)) AS qe FROM effects e JOIN per USING (outcome, cluster) JOIN a ON a.outcome = e.outcome GROUP BY 1
    ), t AS (
      SELECT a.*, qe, greatest(0, (qe - m + ta) / (w - w2 / w) + 0.8 * tb / (w - w2 / w)) AS tau2, m - ta - 0.8 * tb AS q_df FROM a JOIN qe USING (outcome)
    ), l AS (SELECT per.outcome, yb, 1 / (vb + tau2) AS w FROM per JOIN t ON t.outcome = per.outcome),
    s AS (SELECT outcome, sum(w) AS s, sum(w * yb) / sum(w) AS mu FROM l GROUP BY 1),
    h AS (
      SELECT l.outcome, any_value(mu) AS mu, any_value(s) AS s, sqrt(sum(w * w * power(yb - mu, 2) / (1 - w / s)) / power(any_value(s), 2)) AS se,
             1 / (sum(power(w / s, 2)) + power(sum(power(w / s, 2) / (1 - w / s)), 2) - sum(power(power(w / s, 2) / (1 - w / s), 2))) AS df
      FROM l JOIN s ON s.outcome = l.outcome GROUP BY 1
    ) SELECT outcome, k::BIGINT AS k, m, """
    + rounded_sql({"estimate": "mu", "se": "se", "df": "df", "t": "mu / se", "tau2": "tau2", "q": "qe", "q_df": "q_df", "i2": "greatest(0, (qe - q_df) / qe)", "se_model": "sqrt(1 / s)"}, 5)
    + " FROM t JOIN h USING (outcome)"
)
def cluster_robust(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pooling.cluster_robust(effects(spark, sf_dir), KEYS, "cluster")
    return rounded(out.select("outcome", "k", "m", "estimate", "se", "df", "t", "tau2", "q", "q_df", "i2", "se_model"), 5)


@query(
    f"""WITH {EFFECTS_SQL}, x AS (SELECT outcome, y / sqrt(v) AS u, 1 / sqrt(v) AS x FROM effects), g AS (
      SELECT outcome, count(*) AS k, regr_slope(u, x) AS slope, regr_intercept(u, x) AS intercept, regr_sxx(u, x) AS sxx, regr_syy(u, x) AS syy,
             regr_sxy(u, x) AS sxy, avg(x) AS mx FROM x GROUP BY 1 HAVING count(*) >= 3
    ), s AS (SELECT *, sqrt((syy - slope * sxy) / (k - 2) * (1.0 / k + mx * mx / sxx)) AS se FROM g)
    SELECT outcome, k, k - 2 AS df, {rounded_sql({"intercept": "intercept", "intercept_se": "se", "slope": "slope", "t": "intercept / se"}, 5)} FROM s"""
)
def egger_classic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pooling.egger_classic(effects(spark, sf_dir), KEYS).drop("p"), 5)


@query(
    f"""WITH {EFFECTS_SQL}, x AS (SELECT outcome, y, sqrt(1.0 / n_a + 1.0 / n_b) AS x, 1 / v AS w FROM effects), m AS (
      SELECT outcome, count(*) AS k, sum(w * x) / sum(w) AS mx, sum(w * y) / sum(w) AS my FROM x GROUP BY 1 HAVING count(*) >= 3
    ), s AS (
      SELECT m.outcome, any_value(k) AS k, any_value(mx) AS mx, any_value(my) AS my, sum(w) AS sw, sum(w * (x - mx) * (x - mx)) AS sxx,
             sum(w * (x - mx) * (y - my)) AS sxy, sum(w * (y - my) * (y - my)) AS syy FROM x JOIN m ON m.outcome = x.outcome GROUP BY 1
    ), b AS (SELECT *, sxy / sxx AS slope, (syy - sxy * sxy / sxx) / (k - 2) AS s2 FROM s)
    SELECT outcome, k, k - 2 AS df, {rounded_sql({"estimate": "my - slope * mx", "estimate_se": "sqrt(s2 * (1 / sw + mx * mx / sxx))", "slope": "slope", "slope_se": "sqrt(s2 / sxx)", "t": "slope / sqrt(s2 / sxx)"}, 4)} FROM b"""
)
def egger_sample_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pooling.egger_sample_size(effects(spark, sf_dir), KEYS).drop("p"), 4)


def _loo_sql(unit: str) -> str:
    return f"""WITH {EFFECTS_SQL}, units AS (SELECT DISTINCT outcome, {unit} AS omitted FROM effects),
    n AS (SELECT outcome FROM units GROUP BY 1 HAVING count(*) >= 3),
    x AS (SELECT u.outcome, u.omitted, y, v FROM units u JOIN n ON n.outcome = u.outcome JOIN effects e ON e.outcome = u.outcome AND e.{unit} <> u.omitted),
    f AS (SELECT outcome, omitted, count(*) AS k, sum(1 / v) AS f1, sum(1 / (v * v)) AS f2, sum(y / v) / sum(1 / v) AS mu FROM x GROUP BY 1, 2),
    q AS (SELECT f.outcome, f.omitted, any_value(k) AS k, any_value(f1) AS f1, any_value(f2) AS f2, sum(power(y - mu, 2) / v) AS q FROM x JOIN f USING (outcome, omitted) GROUP BY 1, 2),
    t AS (SELECT *, greatest(0, (q - (k - 1)) / (f1 - f2 / f1)) AS tau2 FROM q),
    p AS (SELECT x.outcome, x.omitted, any_value(k) AS k, any_value(q) AS q, any_value(tau2) AS tau2, sum(1 / (v + tau2)) AS sw, sum(y / (v + tau2)) / sum(1 / (v + tau2)) AS mu
          FROM x JOIN t ON t.outcome = x.outcome AND t.omitted = x.omitted GROUP BY 1, 2)
    SELECT outcome, omitted, k, {rounded_sql({"estimate": "mu", "se": "sqrt(1 / sw)", "tau2": "tau2", "q": "q"}, 5)} FROM p"""


@query(_loo_sql("study"))
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pooling.leave_one_out(effects(spark, sf_dir), KEYS, "study")
    return rounded(out.select("outcome", "omitted", "k", "estimate", "se", "tau2", "q"), 5)


@query(_loo_sql("cluster"))
def leave_one_cluster_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pooling.leave_one_out(effects(spark, sf_dir), KEYS, "cluster")
    return rounded(out.select("outcome", "omitted", "k", "estimate", "se", "tau2", "q"), 5)


@query(
    f"""WITH {EFFECTS_SQL}, {_FIXED}, tau AS (SELECT outcome, tau2_dl AS tau2 FROM dl){_POOL}, m AS (SELECT outcome, max(sqrt(v)) AS se_max FROM effects GROUP BY 1)
    SELECT outcome, i::INT AS i, level, {rounded_sql({"se": "se_max * i / 49", "low": "mu - z * se_max * i / 49", "high": "mu + z * se_max * i / 49"}, 5)}
    FROM r JOIN m USING (outcome), range(50) g(i), (VALUES ('0.95', {Z95}), ('0.99', {special.normal_ppf(0.995)!r})) l(level, z)"""
)
def funnel_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = effects(spark, sf_dir)
    pools = pooling.random_effects(df, KEYS, "DL")
    return rounded(pooling.funnel_contours(pools, df, KEYS, {"0.95": Z95, "0.99": special.normal_ppf(0.995)}), 5)


@query(f"WITH {EFFECTS_SQL} SELECT outcome, study, {rounded_sql({'low': f'y - {Z95} * sqrt(v)', 'high': f'y + {Z95} * sqrt(v)'})} FROM effects")
def study_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = effects(spark, sf_dir)
    return rounded(df.select("outcome", "study", (c("y") - Z95 * F.sqrt("v")).alias("low"), (c("y") + Z95 * F.sqrt("v")).alias("high")))


_CHI = "chi(df, lo, hi) AS (VALUES " + ", ".join(f"({df}, {special.chi2_ppf(0.025, df)!r}, {special.chi2_ppf(0.975, df)!r})" for df in range(1, 60)) + ")"
_BOUND = """SELECT t.outcome, t.side, t.target, t.i + 1, CASE WHEN big THEN mid ELSE lo END, CASE WHEN big THEN hi ELSE mid END FROM (
    SELECT u.outcome, u.side, u.target, u.i, u.lo, u.hi, u.mid, sum(y * y / (v + mid)) - power(sum(y / (v + mid)), 2) / sum(1 / (v + mid)) > any_value(u.target) AS big
    FROM (SELECT *, (lo + hi) / 2 AS mid FROM it WHERE i < 80) u JOIN effects USING (outcome) GROUP BY ALL) t"""


@query(
    f"""WITH RECURSIVE {EFFECTS_SQL}, {_CHI}, {_FIXED}, it(outcome, side, target, i, lo, hi) AS (
      SELECT outcome, side, target, 0, 0.0::DOUBLE, CASE WHEN q <= target THEN 0.0 ELSE 100000.0 END::DOUBLE
      FROM (SELECT outcome, q, 'high' AS side, chi.lo AS target FROM dl JOIN chi ON df = k - 1 UNION ALL SELECT outcome, q, 'low', chi.hi FROM dl JOIN chi ON df = k - 1)
      UNION ALL {_BOUND}
    ), b AS (SELECT outcome, side, max_by((lo + hi) / 2, i) AS x FROM it GROUP BY 1, 2)
    SELECT outcome, {rounded_sql({"tau2_low": "max(x) FILTER (WHERE side = 'low')", "tau2_high": "max(x) FILTER (WHERE side = 'high')"}, 5)} FROM b GROUP BY 1"""
)
def tau2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Q-profile interval of the between-study variance."""
    out = pooling.tau2_iterated(effects(spark, sf_dir), KEYS, "REML", interval=True)
    return rounded(out.select("outcome", "tau2_low", "tau2_high"), 5)


@query(
    f"""WITH {EFFECTS_SQL}, {_T}, s AS (
      SELECT *, unnest(CASE WHEN n_a >= 300 THEN ['all', 'large'] ELSE ['all'] END) AS scenario FROM effects
    ), x AS (SELECT outcome, scenario, y, v FROM s UNION ALL SELECT outcome, 'positive', y, v FROM effects WHERE y > 0),
    f AS (SELECT outcome, scenario, count(*) AS k, sum(1 / v) AS f1, sum(1 / (v * v)) AS f2, sum(y / v) / sum(1 / v) AS mu FROM x GROUP BY 1, 2 HAVING count(*) >= 2),
    q AS (SELECT f.outcome, f.scenario, any_value(k) AS k, any_value(f1) AS f1, any_value(f2) AS f2, sum(power(y - mu, 2) / v) AS q FROM x JOIN f USING (outcome, scenario) GROUP BY 1, 2),
    t AS (SELECT *, greatest(0, (q - (k - 1)) / (f1 - f2 / f1)) AS tau2 FROM q),
    p AS (SELECT x.outcome, x.scenario, any_value(k) AS k, any_value(tau2) AS tau2, sum(1 / (v + tau2)) AS sw, sum(y / (v + tau2)) / sum(1 / (v + tau2)) AS mu
          FROM x JOIN t ON t.outcome = x.outcome AND t.scenario = x.scenario GROUP BY 1, 2)
    SELECT outcome, scenario, k, {rounded_sql({"estimate": "mu", "se": "sqrt(1 / sw)", "tau2": "tau2"}, 5)} FROM p"""
)
def sensitivity_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Named subsets of the rows, pooled by one grouped operator: a row is repeated for each scenario that has it."""
    from poolwright.operators.aggregate import scenarios

    rows = scenarios(effects(spark, sf_dir), {"all": F.lit(True), "large": c("n_a") >= 300, "positive": c("y") > 0})
    out = pooling.random_effects(rows, ["outcome", "scenario"], "DL")
    return rounded(out.select("outcome", "scenario", "k", "estimate", "se", "tau2"), 5)
