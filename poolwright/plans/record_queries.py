"""Aggregation, ranking, agreement and calibration over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolwright.operators import aggregate, agreement
from poolwright.sources.tables import ARMS_SQL, EFFECTS_SQL, arms, effects, table

from .base import query, rounded, rounded_sql

c = F.col


def _composite_sql(independent: str) -> str:
    return f"""WITH {EFFECTS_SQL}, g AS (
      SELECT outcome, cluster, count(*) AS members, avg(y) AS y, sum(v) AS sv, sum(sqrt(v)) AS rv, sum(n_a + n_b) AS sn, max(n_a + n_b) AS mn FROM effects GROUP BY 1, 2
    ) SELECT outcome, cluster, members, {independent} AS independent, """


@query(
    _composite_sql("false")
    + rounded_sql({"y": "y", "v": "(sv + 0.5 * (rv * rv - sv)) / (members * members)"}, 7)
    + ", mn::BIGINT AS n FROM g"
)
def composite_dependent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a nation: the mean of its studies with the variance of correlated estimates."""
    return rounded(aggregate.one_row_per_cluster(effects(spark, sf_dir), ["outcome"], "cluster"), 7)


@query(_composite_sql("true") + rounded_sql({"y": "y", "v": "sv / (members * members)"}, 7) + ", sn::BIGINT AS n FROM g")
def composite_independent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where every study names a sample of its own."""
    return rounded(aggregate.one_row_per_cluster(effects(spark, sf_dir), ["outcome"], "cluster", sample="study"), 7)


@query(
    f"""WITH {ARMS_SQL}, s AS (SELECT *, count(*) OVER (PARTITION BY cluster) AS sharing FROM arms)
    SELECT study, sharing, round_even(n_b / sharing::DOUBLE, 0)::BIGINT AS n_b FROM s"""
)
def shared_control_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies of a nation share its arm B: each gets an equal part of the n, half to even."""
    return aggregate.shared_control(arms(spark, sf_dir), ["cluster"], "study", "split_n").select("study", "sharing", "n_b")


@query(
    f"""WITH {ARMS_SQL}, t AS (
      SELECT cluster, count(*) AS sharing, min(study) AS study, sum(n_a) AS n, sum(n_a * m_a) / sum(n_a) AS m, sum((n_a - 1) * sd_a * sd_a) AS ss,
             min_by(n_b, study) AS n_b FROM arms GROUP BY 1
    ), b AS (SELECT arms.cluster, sum(n_a * (m_a - m) * (m_a - m)) AS bt FROM arms JOIN t ON t.cluster = arms.cluster GROUP BY 1)
    SELECT cluster, sharing, study, n::BIGINT AS n_a, n_b, {rounded_sql({"m_a": "m", "sd_a": "sqrt((ss + bt) / (n - 1))"}, 4)} FROM t JOIN b USING (cluster)"""
)
def shared_control_combine(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate.shared_control(arms(spark, sf_dir), ["cluster"], "study", "combine_arms")
    return rounded(out.select("cluster", "sharing", "study", "n_a", "n_b", "m_a", "sd_a"), 4)


@query(f"WITH {ARMS_SQL} SELECT cluster, count(*) AS sharing, min(study) AS study FROM arms GROUP BY 1")
def shared_control_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.shared_control(arms(spark, sf_dir), ["cluster"], "study", "keep_first").select("cluster", "sharing", "study")


@query(f"WITH {ARMS_SQL} SELECT study, count(*) OVER (PARTITION BY cluster) > 1 AS flagged FROM arms")
def shared_control_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.shared_control(arms(spark, sf_dir), ["cluster"], "study", "keep_all_flagged").select("study", "flagged")


@query(
    f"""WITH {EFFECTS_SQL}, x AS (SELECT outcome, study, y, y - 1.959963984540054 * sqrt(v) AS lo, y + 1.959963984540054 * sqrt(v) AS hi FROM effects)
    SELECT outcome, study, row_number() OVER (PARTITION BY outcome ORDER BY y, study)::INT AS position,
           greatest(1.0, ceil(2 * max(greatest(abs(lo), abs(hi))) OVER (PARTITION BY outcome)) / 2)::DOUBLE AS "limit" FROM x"""
)
def forest_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.forest_layout(effects(spark, sf_dir), ["outcome"], "study")


_ROUTES = "CASE event_type WHEN 'click' THEN 'figure_bar' WHEN 'view' THEN 'text_mean_sd' WHEN 'signup' THEN 'table' WHEN 'error' THEN 'p_value' ELSE 'digitize:ensemble' END"


@query(
    f"""WITH r AS (SELECT {_ROUTES} AS route FROM events), b AS (
      SELECT route, CASE WHEN route LIKE 'figure%' OR route LIKE 'digitize%' THEN 'figure' WHEN route IN ('test_statistic', 'p_value', 'reported_d') THEN 'statistic'
             WHEN route = 'table' THEN 'table' WHEN route LIKE 'text%' THEN 'text' ELSE 'other' END AS bucket FROM r
    ) SELECT bucket, count(*) AS n, round(100.0 * count(*) / (SELECT count(*) FROM r), 6) + 0.0 AS pct, array_to_string(list_sort(list(DISTINCT route)), '|') AS routes FROM b GROUP BY 1"""
)
def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    route = (
        F.when(c("event_type") == "click", "figure_bar").when(c("event_type") == "view", "text_mean_sd").when(c("event_type") == "signup", "table")
        .when(c("event_type") == "error", "p_value").otherwise("digitize:ensemble")
    )
    return rounded(aggregate.route_counts(table(spark, sf_dir, "events").select(route.alias("route")), "route"))


_STEPS_SQL = "CASE WHEN n_chars < 200 THEN 'short' WHEN lang <> 'en' THEN 'language' WHEN text LIKE '%@%' THEN 'mail' END"


@query(
    f"""WITH t AS (SELECT {_STEPS_SQL} AS reason FROM documents)
    SELECT count(*) AS found, count(*) FILTER (WHERE reason = 'short') AS removed_short, count(*) FILTER (WHERE reason = 'language') AS removed_language,
           count(*) FILTER (WHERE reason = 'mail') AS removed_mail, count(*) FILTER (WHERE reason IS NULL) AS included, true AS adds_up FROM t"""
)
def flow_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records each step of a selection removes, and whether the counts add up."""
    steps = {"short": c("n_chars") < 200, "language": c("lang") != "en", "mail": c("text").contains("@")}
    return aggregate.flow_counts(table(spark, sf_dir, "documents"), steps)


@query(
    """WITH r AS (SELECT CASE p_type WHEN 'SMALL' THEN 'Not Human: mice' WHEN 'ECONOMY' THEN 'no control group: ' || p_name WHEN 'LARGE' THEN 'wrong task' ELSE p_type END AS reason FROM part),
    h AS (SELECT trim(split_part(lower(reason), ':', 1)) AS head FROM r)
    SELECT coalesce(a.reason, 'other') AS reason, count(*) AS n FROM h
    LEFT JOIN (VALUES ('not human', 'population'), ('no control group', 'no_comparison'), ('wrong task', 'task')) a(head, reason) USING (head) GROUP BY 1"""
)
def exclusion_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = c("p_type")
    reason = (
        F.when(kind == "SMALL", "Not Human: mice").when(kind == "ECONOMY", F.concat(F.lit("no control group: "), "p_name"))
        .when(kind == "LARGE", "wrong task").otherwise(kind)
    )
    aliases = spark.createDataFrame([("not human", "population"), ("no control group", "no_comparison"), ("wrong task", "task")], "alias string, reason string")
    return aggregate.reason_histogram(table(spark, sf_dir, "part").select(reason.alias("reason")), "reason", aliases)


_CALLS = """calls AS (
  SELECT l_orderkey, l_linenumber, l_returnflag AS stage, l_linestatus AS model, (l_quantity * 100)::BIGINT AS n_in, (l_quantity * 10)::BIGINT AS n_out,
         l_partkey AS n_cache_read, l_suppkey AS n_cache_write, l_linenumber = 7 AS replayed FROM lineitem
)"""


@query(
    f"""WITH {_CALLS}, p(model, per_in, per_out) AS (VALUES ('O', 3.0, 15.0), ('F', 5.0, 25.0))
    SELECT stage, count(*) AS calls, sum(n_in)::BIGINT AS tokens_in, sum(n_out)::BIGINT AS tokens_out,
           round(sum(CASE WHEN replayed THEN 0 ELSE ((n_in + 1.25 * n_cache_write + 0.1 * n_cache_read) * per_in + n_out * per_out) / 1e6 END), 6) + 0.0 AS cost,
           round(sum(n_cache_read) FILTER (WHERE NOT replayed) / sum(n_in + n_cache_read + n_cache_write) FILTER (WHERE NOT replayed), 6) + 0.0 AS cache_share,
           round(sum(CASE WHEN replayed THEN 0 ELSE 0.9 * n_cache_read * per_in / 1e6 END), 6) + 0.0 AS saved FROM calls JOIN p USING (model) GROUP BY 1"""
)
def cost_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost of calls by stage, with cache reads and writes, and what the cache saved."""
    calls = table(spark, sf_dir, "lineitem").select(
        c("l_returnflag").alias("stage"), c("l_linestatus").alias("model"), (c("l_quantity") * 100).cast("long").alias("n_in"), (c("l_quantity") * 10).cast("long").alias("n_out"),
        c("l_partkey").alias("n_cache_read"), c("l_suppkey").alias("n_cache_write"), (c("l_linenumber") == 7).alias("replayed"),
    )
    prices = spark.createDataFrame([("O", 3.0, 15.0), ("F", 5.0, 25.0)], "model string, per_in double, per_out double")
    return rounded(aggregate.cost_rollup(calls, prices))


@query(
    """WITH b AS (SELECT event_id, user_id, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM events)
    SELECT event_id, user_id, round(s, 4) + 0.0 AS spent_before, round(s, 4) < 500 AS allowed FROM b"""
)
def running_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = aggregate.running_budget(table(spark, sf_dir, "events").select("event_id", "user_id", "value"), "user_id", "event_id", "value", 500.0)
    out = out.withColumn("spent_before", F.round("spent_before", 4) + 0.0)
    return out.select("event_id", "user_id", "spent_before", (c("spent_before") < 500).alias("allowed"))


_AGREE = """n, CASE WHEN vx + vy + (mx - my) * (mx - my) > 0 THEN round(2 * cv / (vx + vy + (mx - my) * (mx - my)), 6) + 0.0 END AS ccc, round(mae, 4) + 0.0 AS mae,
  round(rmse, 4) + 0.0 AS rmse, round(sg, 6) + 0.0 AS sign_agreement, round(bias, 4) + 0.0 AS bias, round(sd, 4) + 0.0 AS sd,
  round(bias - 1.96 * sd, 4) + 0.0 AS loa_low, round(bias + 1.96 * sd, 4) + 0.0 AS loa_high"""
_AGREE_FROM = """SELECT {keys} count(*) AS n, covar_pop(x, y) AS cv, var_pop(x) AS vx, var_pop(y) AS vy, avg(x) AS mx, avg(y) AS my, avg(abs(x - y)) AS mae,
  sqrt(avg((x - y) * (x - y))) AS rmse, avg(CASE WHEN sign(x) = sign(y) OR x = 0 OR y = 0 THEN 1.0 ELSE 0.0 END) AS sg, avg(x - y) AS bias, stddev_samp(x - y) AS sd FROM pairs {group}"""
_PAIRS = """pairs AS (
  SELECT o_orderpriority AS priority, o_orderstatus AS status, o_totalprice / 1000 - 250 AS x, sum(l_extendedprice * (1 - l_discount)) / 1000 - 250 AS y
  FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey, 1, 2, 3
)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(c("l_extendedprice") * (1 - c("l_discount"))).alias("total"))
    return table(spark, sf_dir, "orders").join(lines, c("l_orderkey") == c("o_orderkey")).select(
        c("o_orderpriority").alias("priority"), c("o_orderstatus").alias("status"), (c("o_totalprice") / 1000 - 250).alias("x"), (c("total") / 1000 - 250).alias("y")
    )


def _agreed(df: DataFrame) -> DataFrame:
    places = {"ccc": 6, "sign_agreement": 6}
    return df.select(*[(F.round(x, places.get(x, 4)) + 0.0).alias(x) if t == "double" else c(x) for x, t in df.dtypes])


@query(f"WITH {_PAIRS}, a AS ({_AGREE_FROM.format(keys='', group='')}) SELECT {_AGREE} FROM a")
def agreement_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order totals against the sums of their lines: CCC, MAE, RMSE, signs, Bland-Altman."""
    return _agreed(agreement.agreement(_pairs(spark, sf_dir), []))


@query(
    f"WITH {_PAIRS}, a AS ({_AGREE_FROM.format(keys='priority, status,', group='GROUP BY GROUPING SETS ((priority), (status))')}) SELECT priority, status, {_AGREE} FROM a"
)
def agreement_by_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by priority and by status."""
    pairs = _pairs(spark, sf_dir)
    by = [agreement.agreement(pairs, [k]) for k in ("priority", "status")]
    return _agreed(by[0].unionByName(by[1], allowMissingColumns=True))


@query("SELECT l_suppkey, count(*) AS n, median(l_extendedprice) AS median, round(1.4826 * mad(l_extendedprice), 4) + 0.0 AS spread FROM lineitem GROUP BY 1")
def median_mad(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agreement.median_mad(table(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice")
    return out.withColumn("spread", F.round("spread", 4) + 0.0)


@query("SELECT event_type, list_sort(list(value))[(count(*) // 2) + 1] AS upper_median, median(value) AS median FROM events GROUP BY 1")
def upper_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(agreement.upper_median(c("value")).alias("upper_median"), F.median("value").alias("median"))


_TICKS = """ticks AS (
  SELECT user_id AS axis, event_id AS tick, 10.0 * row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS px,
         2.5 * row_number() OVER (PARTITION BY user_id ORDER BY event_id) + CASE WHEN value > 100 THEN 7.0 ELSE value / 100 END AS value
  FROM events
)"""


def _ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    value = 2.5 * place + F.when(c("value") > 100, 7.0).otherwise(c("value") / 100)
    return table(spark, sf_dir, "events").select(c("user_id").alias("axis"), c("event_id").alias("tick"), (10.0 * place).alias("px"), value.alias("value"))


@query(
    f"""WITH {_TICKS}, f AS (SELECT axis, regr_slope(value, px) AS a, regr_intercept(value, px) AS b, count(*) AS n FROM ticks GROUP BY 1),
    r AS (SELECT ticks.*, n, abs((value - a * px - b) / a) AS res FROM ticks JOIN f USING (axis)),
    m AS (SELECT axis, median(res) AS mid FROM r GROUP BY 1),
    k AS (SELECT r.*, mid, row_number() OVER (PARTITION BY r.axis ORDER BY res DESC, tick) AS rk FROM r JOIN m ON m.axis = r.axis),
    kept AS (SELECT axis, px, value FROM k WHERE NOT coalesce(n >= 4 AND rk = 1 AND res > greatest(3 * mid, 0.25), false)),
    g AS (SELECT axis, regr_slope(value, px) AS a, regr_intercept(value, px) AS b, count(*) AS used FROM kept GROUP BY 1)
    SELECT axis, used, round(any_value(a), 3) + 0.0 AS a, round(any_value(b), 3) + 0.0 AS b, round(sqrt(avg(power((value - a * px - b) / a, 2))), 3) + 0.0 AS rmse_px FROM kept JOIN g USING (axis) GROUP BY 1, 2"""
)
def fit_axis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Axis calibration from tick tables, with one outlier left out."""
    return rounded(agreement.fit_axis(_ticks(spark, sf_dir), "axis"), 3)


@query(
    f"""WITH {_TICKS}, s AS (SELECT a.axis, median((b.value - a.value) / (b.px - a.px)) AS slope FROM ticks a JOIN ticks b ON a.axis = b.axis AND a.tick < b.tick GROUP BY 1)
    SELECT axis, round(any_value(slope), 4) + 0.0 AS slope, round(median(value - slope * px), 4) + 0.0 AS intercept FROM ticks JOIN s USING (axis) GROUP BY 1"""
)
def theil_sen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(agreement.theil_sen(_ticks(spark, sf_dir), "axis", "px", "value", "tick"), 4)


@query(
    """WITH x AS (SELECT user_id, event_id, value, coalesce(value > lag(value) OVER (PARTITION BY user_id ORDER BY event_id), false) AS up FROM events),
    r AS (SELECT *, sum(CASE WHEN up THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM x),
    g AS (SELECT user_id, run, count(*) AS length, min(event_id) AS start FROM r GROUP BY 1, 2)
    SELECT user_id, max(length) AS length, min(start) FILTER (WHERE length = m) AS start FROM (SELECT *, max(length) OVER (PARTITION BY user_id) AS m FROM g) GROUP BY 1"""
)
def monotone_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.monotone_runs(table(spark, sf_dir, "events").select("user_id", "event_id", "value"), "user_id", "event_id", "value")
