"""Effect sizes over the studies of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolwright.functions import effects as e
from poolwright.functions.special import Z95, t_ppf
from poolwright.sources.tables import ARMS_SQL, EFFECTS_SQL, arms, effects

from .base import query, rounded, rounded_sql

c = F.col
_J = "exp(lgamma(({m}) / 2.0) - ln(sqrt(({m}) / 2.0)) - lgamma((({m}) - 1) / 2.0))"
_JX = _J.format(m="n_a + n_b - 2")
_K = f"(1 - (n_a + n_b - 4) / ((n_a + n_b - 2) * power({_JX}, 2)))"


@query(
    f"WITH {EFFECTS_SQL} SELECT study, "
    + rounded_sql(
        {
            "s_pooled": "sqrt(((n_a - 1) * sd_a * sd_a + (n_b - 1) * sd_b * sd_b) / (n_a + n_b - 2))",
            "d": "y",
            "j": _JX,
            "j_near": "1 - 3.0 / (4 * (n_a + n_b - 2) - 1)",
            "k": _K,
            "g": f"{_JX} * y",
            "g_near": "(1 - 3.0 / (4 * (n_a + n_b - 2) - 1)) * y",
        }
    )
    + " FROM effects"
)
def effect_smd(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = effects(spark, sf_dir)
    m = c("n_a") + c("n_b") - 2
    return rounded(
        df.select(
            "study",
            e.pooled_sd(c("sd_a"), c("n_a"), c("sd_b"), c("n_b")).alias("s_pooled"),
            c("y").alias("d"),
            e.j_exact(m).alias("j"),
            e.j_approx(m).alias("j_near"),
            e.k_exact(m).alias("k"),
            e.hedges_g(c("y"), c("n_a"), c("n_b")).alias("g"),
            e.hedges_g(c("y"), c("n_a"), c("n_b"), exact=False).alias("g_near"),
        )
    )


@query(
    f"WITH {EFFECTS_SQL}, b AS (SELECT *, 1.0 / n_a + 1.0 / n_b AS base FROM effects) SELECT study, "
    + rounded_sql(
        {
            "borenstein": "v",
            "hedges_olkin_df": "base + y * y / (2.0 * (n_a + n_b - 2))",
            "meta_exact": f"base + power({_JX} * y, 2) * {_K}",
            "meta_exact_g": f"base + y * y * {_K}",
            "meta_hedges_approx": "base + y * y / (2 * (n_a + n_b - 3.94))",
            "se": "sqrt(v)",
            "ci_low": f"y - {Z95} * sqrt(v)",
            "ci_high": f"y + {Z95} * sqrt(v)",
            "oriented": "CASE WHEN n_a >= n_b THEN y ELSE -y END",
        },
        8,
    )
    + " FROM b"
)
def effect_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = effects(spark, sf_dir)
    methods = ("borenstein", "hedges_olkin_df", "meta_exact", "meta_exact_g", "meta_hedges_approx")
    low, high = e.ci(c("y"), e.se_smd(c("y"), c("n_a"), c("n_b")))
    return rounded(
        df.select(
            "study",
            *[e.var_smd(c("y"), c("n_a"), c("n_b"), m).alias(m) for m in methods],
            e.se_smd(c("y"), c("n_a"), c("n_b")).alias("se"),
            low.alias("ci_low"),
            high.alias("ci_high"),
            e.orient(c("y"), c("n_a") >= c("n_b")).alias("oriented"),
        ),
        8,
    )


@query(
    f"WITH {EFFECTS_SQL}, s AS (SELECT *, sqrt(1.0 / n_a + 1.0 / n_b) AS u FROM effects), t AS (SELECT *, y / u AS t FROM s) SELECT study, "
    + rounded_sql(
        {
            "d_t": "t * u",
            "d_f": "sign(t) * sqrt(t * t) * u",
            "d_r": "2 * (t / sqrt(t * t + n_a + n_b - 2)) / sqrt(1 - power(t / sqrt(t * t + n_a + n_b - 2), 2))",
            "sd_se": "sd_a / sqrt(n_a) * sqrt(n_a)",
            "sd_diff_se": "sqrt(power(sd_a, 2) / n_a + power(sd_b, 2) / n_b) / u",
            "sd_diff_ci": f"(2 * {Z95} * sqrt(power(sd_a, 2) / n_a + power(sd_b, 2) / n_b)) / 2 / {Z95} / u",
            "half_control": "n_b / 2.0",
            "both_mean": "(n_a * m_a + n_b * m_b) / (n_a + n_b)",
            "both_sd": "sqrt(((n_a - 1) * sd_a * sd_a + (n_b - 1) * sd_b * sd_b + n_a * n_b * power(m_a - m_b, 2) / (n_a + n_b)) / (n_a + n_b - 1))",
        },
        5,
    )
    + ", n_a + n_b AS both_n FROM t"
)
def effect_conversions(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.sqrt(1 / c("n_a") + 1 / c("n_b"))
    df = effects(spark, sf_dir).withColumn("t", c("y") / u)
    df = df.withColumn("r", c("t") / F.sqrt(c("t") ** 2 + c("n_a") + c("n_b") - 2))
    df = df.withColumn("se", F.sqrt(c("sd_a") ** 2 / c("n_a") + c("sd_b") ** 2 / c("n_b")))
    mean, sd, n = e.combine_arms(c("m_a"), c("sd_a"), c("n_a"), c("m_b"), c("sd_b"), c("n_b"))
    return rounded(
        df.select(
            "study",
            e.d_from_t(c("t"), c("n_a"), c("n_b")).alias("d_t"),
            e.d_from_f(c("t") ** 2, c("n_a"), c("n_b"), F.signum("t")).alias("d_f"),
            e.d_from_r(c("r")).alias("d_r"),
            e.sd_from_se(c("sd_a") / F.sqrt("n_a"), c("n_a")).alias("sd_se"),
            e.pooled_sd_from_diff_se(c("se"), c("n_a"), c("n_b")).alias("sd_diff_se"),
            e.pooled_sd_from_diff_ci(-Z95 * c("se"), Z95 * c("se"), c("n_a"), c("n_b")).alias("sd_diff_ci"),
            (c("n_b") / 2).alias("half_control"),
            mean.alias("both_mean"),
            sd.alias("both_sd"),
            n.alias("both_n"),
        ),
        5,
    )


def _values(name: str, columns: str, rows) -> str:
    return f"{name}({columns}) AS (VALUES {', '.join(str(r) for r in rows)})"


#: t quantiles for every n that the oracle may meet
_T = _values("tq", "df, q", [(df, repr(t_ppf(0.975, df))) for df in range(1, 100)]).replace("'", "")


@query()
def sd_from_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means and SDs from medians, quartiles and ranges, by supplier."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    five = rows.groupBy(c("l_suppkey").alias("supplier")).agg(
        F.count("*").alias("n"), F.min("l_quantity").alias("lo"), F.percentile("l_quantity", 0.25).alias("q1"), F.median("l_quantity").alias("md"),
        F.percentile("l_quantity", 0.75).alias("q3"), F.max("l_quantity").alias("hi"),
    ).where("n > 1")
    x = {k: c(k) for k in ("lo", "q1", "md", "q3", "hi", "n")}
    return rounded(
        five.select(
            "supplier",
            "n",
            e.mean_from_median_iqr(x["md"], x["q1"], x["q3"]).alias("mean_three"),
            e.luo_mean_iqr(x["md"], x["q1"], x["q3"], x["n"]).alias("mean_iqr"),
            e.luo_mean_five(*(x[k] for k in ("lo", "q1", "md", "q3", "hi", "n"))).alias("mean_five"),
            e.sd_from_iqr(x["q1"], x["q3"], x["n"]).alias("sd_iqr"),
            e.sd_from_range(x["lo"], x["hi"], x["n"]).alias("sd_range"),
            e.sd_five(x["lo"], x["q1"], x["q3"], x["hi"], x["n"]).alias("sd_shi"),
            e.sd_five(x["lo"], x["q1"], x["q3"], x["hi"], x["n"], "wan").alias("sd_wan"),
        )
    )


@query(
    f"""WITH {_T}, g AS (
      SELECT l_suppkey % 500 AS g, l_partkey % 7 AS h, count(*) AS n, avg(l_quantity) AS m, stddev_samp(l_quantity) AS sd
      FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 2 AND stddev_samp(l_quantity) > 0
    ), q AS (SELECT g.*, CASE WHEN n < 100 THEN q ELSE {Z95} END AS q FROM g LEFT JOIN tq ON df = n - 1)
    SELECT g, h, n, {rounded_sql({"half": "q * sd / sqrt(n)", "sd_back": "q * sd / sqrt(n) / q * sqrt(n)"})} FROM q"""
)
def sd_from_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-width of a 95 % interval of the mean (t below n = 100) and the SD recovered from the interval."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    g = rows.groupBy((c("l_suppkey") % 500).alias("g"), (c("l_partkey") % 7).alias("h")).agg(
        F.count("*").alias("n"), F.avg("l_quantity").alias("m"), F.stddev_samp("l_quantity").alias("sd")
    ).where("n >= 2 and sd > 0")
    g = g.withColumn("half", e.ci_quantile(c("n")) * c("sd") / F.sqrt("n"))
    back = e.sd_from_ci(c("m") - c("half"), c("m") + c("half"), c("n"))
    return rounded(g.select("g", "h", "n", "half", back.alias("sd_back")))


@query(
    f"WITH {EFFECTS_SQL}, p AS (SELECT *, sqrt(((n_a - 1) * sd_a * sd_a + (n_b - 1) * sd_b * sd_b) / (n_a + n_b - 2)) AS s FROM effects) SELECT study, "
    + rounded_sql(
        {
            "v_read": "(power(0.01 * m_a, 2) + power(0.01 * m_b, 2)) / (s * s) + power(-y * (n_a - 1) * sd_a / ((n_a + n_b - 2) * s * s) * 0.02 * sd_a, 2) + power(-y * (n_b - 1) * sd_b / ((n_a + n_b - 2) * s * s) * 0.02 * sd_b, 2)"
        },
        8,
    )
    + " FROM p"
)
def effect_reading_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delta-method variance of d from reading errors of 1 % of means and 2 % of SDs."""
    df = effects(spark, sf_dir)
    v = e.delta_variance_d(
        c("m_a"), c("sd_a"), c("n_a"), c("m_b"), c("sd_b"), c("n_b"), 0.01 * c("m_a"), 0.02 * c("sd_a"), 0.01 * c("m_b"), 0.02 * c("sd_b")
    )
    return rounded(df.select("study", v.alias("v_read")), 8)


@query(
    f"""WITH {ARMS_SQL}, s AS (SELECT *, sqrt(1.0 / n_a + 1.0 / n_b) AS u, sqrt(((n_a - 1) * sd_a * sd_a + (n_b - 1) * sd_b * sd_b) / (n_a + n_b - 2)) AS sp FROM arms),
    t AS (SELECT *, (m_a - m_b) / sp AS d, (m_a - m_b) / sp / u AS t FROM s)
    SELECT study, {rounded_sql({"d_p": "abs(d)"}, 4)} FROM t WHERE abs(t) BETWEEN 0.1 AND 5"""
)
def effect_from_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """|d| recovered from the two-sided p of its own t: t's distribution function and quantile undo each other."""
    from poolwright.functions.special import t_p_value

    df = effects(spark, sf_dir).withColumn("t", c("y") / F.sqrt(1 / c("n_a") + 1 / c("n_b"))).where("abs(t) between 0.1 and 5")
    df = df.withColumn("p", t_p_value(c("t"), c("n_a") + c("n_b") - 2))
    return rounded(df.select("study", e.d_from_p(c("p"), c("n_a"), c("n_b"), F.lit(1.0)).alias("d_p")), 4)


@query(
    f"""WITH {ARMS_SQL}, p AS (SELECT study, list_value(m_a, m_b, sd_a) AS x FROM arms)
    SELECT study, {rounded_sql({"mean": "list_avg(x)", "sd": "list_stddev_samp(x)"}, 4)}, 3::BIGINT AS n FROM p"""
)
def points_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, SD and n of an array of points."""
    df = arms(spark, sf_dir).withColumn("x", F.array("m_a", "m_b", "sd_a"))
    mean, sd, n = e.points_mean_sd(c("x"))
    return rounded(df.select("study", mean.alias("mean"), sd.alias("sd"), n.cast("long").alias("n")), 4)
