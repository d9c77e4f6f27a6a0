"""The named sensitivity analyses over the studies of the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolwright.functions.special import Z95, t_ppf
from poolwright.operators.sensitivity import ANALYSES, named_analyses
from poolwright.sources.tables import EFFECTS_SQL, effects

from .base import query, rounded, rounded_sql

c = F.col
#: t quantiles for the df that the oracle meets
_T = "tq(df, t) AS (VALUES " + ", ".join(f"({df}, {t_ppf(0.975, df)!r})" for df in range(1, 200)) + ")"
_ALWAYS = ["primary", "include_needs_human", "best_guess", "hartung_knapp", "normal_z", "with_digitization_variance", "without_digitization_variance", "all_rows"]


@query(
    f"""WITH {EFFECTS_SQL}, {_T}, r AS (SELECT *, n_a % 4 AS kind, n_b % 5 = 0 AS held, CASE WHEN n_a % 2 = 0 THEN 'smd' ELSE 'ratio' END AS metric FROM effects),
    tagged AS (SELECT *, unnest(CASE WHEN held AND n_b % 10 = 0 THEN ['include_needs_human', 'best_guess'] WHEN held THEN ['include_needs_human']
        ELSE list_concat({_ALWAYS!r}, ['by_analysis_metric:' || metric], CASE WHEN kind <> 0 THEN ['exclude_figure_derived'] ELSE [] END,
                         CASE WHEN kind <> 1 THEN ['exclude_test_statistic_derived'] ELSE [] END) END) AS analysis FROM r),
    x AS (SELECT outcome, analysis, cluster, y, CASE WHEN analysis = 'with_digitization_variance' AND kind = 0 THEN 1.5 * v ELSE v END AS v FROM tagged
          UNION ALL SELECT outcome, 'one_row_per_paper', cluster, avg(y), (sum(v) + 0.5 * (power(sum(sqrt(v)), 2) - sum(v))) / power(count(*), 2) FROM r WHERE NOT held GROUP BY outcome, cluster),
    f AS (SELECT outcome, analysis, count(*) AS k, count(DISTINCT cluster) AS clusters, sum(1 / v) AS f1, sum(1 / (v * v)) AS f2, sum(y / v) / sum(1 / v) AS mu FROM x GROUP BY 1, 2),
    q AS (SELECT outcome, analysis, any_value(k) AS k, any_value(f1) AS f1, any_value(f2) AS f2, sum(power(y - mu, 2) / v) AS q FROM x JOIN f USING (outcome, analysis) WHERE k >= 2 GROUP BY 1, 2),
    t AS (SELECT *, greatest(0, (q - (k - 1)) / (f1 - f2 / f1)) AS tau2 FROM q),
    m AS (SELECT outcome, analysis, any_value(k) AS k, any_value(tau2) AS tau2, sum(1 / (v + tau2)) AS sw, sum(y / (v + tau2)) / sum(1 / (v + tau2)) AS mu FROM x JOIN t USING (outcome, analysis) GROUP BY 1, 2),
    h AS (SELECT outcome, analysis, any_value(m.k) AS k, any_value(tau2) AS tau2, any_value(m.mu) AS mu, any_value(sw) AS sw, sqrt(sum(power(y - m.mu, 2) / (v + tau2)) / ((any_value(m.k) - 1) * any_value(sw))) AS hk
          FROM x JOIN m USING (outcome, analysis) GROUP BY 1, 2),
    s AS (SELECT h.*, CASE WHEN analysis = 'hartung_knapp' AND hk > 0 THEN hk ELSE sqrt(1 / sw) END AS se, CASE WHEN analysis = 'hartung_knapp' AND hk > 0 THEN tq.t ELSE {Z95!r} END AS w FROM h JOIN tq ON tq.df = k - 1),
    names AS (SELECT DISTINCT outcome, unnest(list_concat({list(ANALYSES)!r}, ['by_analysis_metric:' || metric])) AS analysis FROM r)
    SELECT names.outcome, names.analysis, CASE WHEN names.analysis <> 'dependency' THEN coalesce(f.k, 0) END AS k, CASE WHEN names.analysis <> 'dependency' THEN coalesce(f.clusters, 0) END AS clusters,
    """
    + rounded_sql({"estimate": "s.mu", "se": "s.se", "ci_low": "s.mu - s.w * s.se", "ci_high": "s.mu + s.w * s.se", "tau2": "s.tau2", "delta": "s.mu - main.mu"}, 5)
    + """ FROM names LEFT JOIN f USING (outcome, analysis) LEFT JOIN s USING (outcome, analysis) LEFT JOIN s main ON main.outcome = names.outcome AND main.analysis = 'primary'"""
)
def sensitivity_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every named analysis of each outcome; a study's counts stand for its route, metric and state."""
    kind = c("n_a") % 4
    rows = (
        effects(spark, sf_dir)
        .withColumn("route", F.when(kind == 0, "figure:bars").when(kind == 1, "test_statistic").when(kind == 2, "table").otherwise("text:mean"))
        .withColumn("metric", F.when(c("n_a") % 2 == 0, "smd").otherwise("ratio"))
        .withColumn("digitised", 0.5 * c("v"))
        .withColumn("held", c("n_b") % 5 == 0)
        .withColumn("admitted", c("n_b") % 10 == 0)
    )
    return rounded(named_analyses(rows, ["outcome"]), 5)
