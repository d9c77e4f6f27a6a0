"""Decision log, event windows and retention over the driver's events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolwright.operators import log
from poolwright.sources.tables import table
from poolwright.streaming import events as streams

from .base import query, rounded

c = F.col

_LOG = """log AS (
  SELECT event_id AS seq, CASE event_type WHEN 'click' THEN 'value' WHEN 'view' THEN 'which_measure' WHEN 'signup' THEN 'group_n' WHEN 'error' THEN 'exclude_dataset' ELSE 'eligibility' END AS kind,
         user_id AS dataset, user_id % 40 AS paper, CASE WHEN event_id % 3 > 0 THEN value END AS mean, CASE WHEN event_id % 4 > 0 THEN value / 10 END AS spread,
         CASE WHEN event_id % 5 = 0 THEN (1 + event_id % 30)::DOUBLE END AS n, value > 20 AS eligible FROM events
)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (
        F.when(c("event_type") == "click", "value").when(c("event_type") == "view", "which_measure").when(c("event_type") == "signup", "group_n")
        .when(c("event_type") == "error", "exclude_dataset").otherwise("eligibility")
    )
    k = c("event_id")
    return table(spark, sf_dir, "events").select(
        k.alias("seq"), kind.alias("kind"), c("user_id").alias("dataset"), (c("user_id") % 40).alias("paper"), F.when(k % 3 > 0, c("value")).alias("mean"),
        F.when(k % 4 > 0, c("value") / 10).alias("spread"), F.when(k % 5 == 0, 1.0 + k % 30).alias("n"), (c("value") > 20).alias("eligible"),
    )


@query(
    f"""WITH {_LOG}, r AS (SELECT *, row_number() OVER (PARTITION BY kind, dataset ORDER BY seq DESC) AS t FROM log)
    SELECT seq, kind, dataset FROM r WHERE kind NOT IN ('which_measure', 'group_n') OR t = 1"""
)
def log_lastwins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Live decisions: the last of replacing kinds, all of the others."""
    return log.live(_log(spark, sf_dir), ["dataset"]).select("seq", "kind", "dataset")


@query(
    f"""WITH {_LOG} SELECT dataset, max_by(mean, seq) FILTER (WHERE mean IS NOT NULL) AS mean, max_by(spread, seq) FILTER (WHERE spread IS NOT NULL) AS spread,
    max_by(n, seq) FILTER (WHERE n IS NOT NULL) AS n, max(seq) AS last_seq FROM log WHERE kind = 'value' GROUP BY 1"""
)
def log_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field-wise latest values."""
    return log.last_stated(_log(spark, sf_dir).where("kind = 'value'"), ["dataset"], ["mean", "spread", "n"])


@query(
    f"""WITH {_LOG}, v AS (SELECT dataset, max_by(mean, seq) FILTER (WHERE mean IS NOT NULL) AS m, max_by(n, seq) FILTER (WHERE n IS NOT NULL) AS k FROM log WHERE kind = 'value' GROUP BY 1),
    x AS (SELECT DISTINCT dataset FROM log WHERE kind = 'exclude_dataset'),
    p AS (SELECT paper FROM log WHERE kind = 'eligibility' GROUP BY 1 HAVING NOT max_by(eligible, seq))
    SELECT c_custkey, coalesce(m, c_acctbal) AS mean, coalesce(k, 10.0::DOUBLE) AS n, v.dataset IS NOT NULL AS touched FROM customer LEFT JOIN v ON v.dataset = c_custkey
    WHERE c_custkey NOT IN (SELECT dataset FROM x) AND c_custkey % 40 NOT IN (SELECT paper FROM p)"""
)
def log_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base cells with the decisions folded in: values replaced, datasets and papers excluded."""
    decisions = _log(spark, sf_dir)
    cells = table(spark, sf_dir, "customer").select(
        c("c_custkey").alias("dataset"), (c("c_custkey") % 40).alias("paper"), c("c_acctbal").alias("mean"), F.lit(10.0).alias("n")
    )
    folded = log.fold_values(cells, decisions, ["dataset"], ["mean", "n"])
    out = log.excluded(folded, decisions, "dataset", "paper")
    return out.select(c("dataset").alias("c_custkey"), "mean", "n", "touched")


@query(
    f"""WITH {_LOG} SELECT seq, CASE WHEN kind = 'group_n' THEN 'no cell named' WHEN kind = 'value' AND mean IS NULL AND spread IS NULL AND n IS NULL THEN 'no value given'
    WHEN kind = 'value' AND n < 2 THEN 'n too small' END AS problem FROM log"""
)
def log_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeps a decision from being applied."""
    rows = _log(spark, sf_dir).withColumn("outcome", F.when(c("kind") != "group_n", F.lit("late"))).withColumn("arm", F.lit("A"))
    return log.validate(rows).select("seq", "problem")


@query(
    """WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS e, min(event_id) OVER (PARTITION BY user_id) AS f FROM events)
    SELECT user_id, event_id FROM r WHERE e <= 9 OR event_id = f"""
)
def log_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last nine events of each user."""
    return log.retained(table(spark, sf_dir, "events").select("user_id", "event_id"), "user_id", "event_id", 10)


@query("SELECT time_bucket(INTERVAL 60 MINUTE, ts)::TIMESTAMP AS start, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY 1, 2")
def tumbling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly windows (an extension: the reference has no windows)."""
    out = streams.tumbling(table(spark, sf_dir, "events")).withColumn("start", c("start").cast("timestamp_ntz"))
    return rounded(out, 4)


@query(
    """WITH g AS (SELECT *, coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE, true)::INT AS new FROM events),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM g)
    SELECT user_id, min(ts)::TIMESTAMP AS start, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM s GROUP BY user_id, s"""
)
def session_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of each user (an extension)."""
    out = streams.sessions(table(spark, sf_dir, "events")).withColumn("start", c("start").cast("timestamp_ntz"))
    return rounded(out, 4)


@query(
    """WITH RECURSIVE v AS (SELECT user_id, list(value ORDER BY event_id) AS xs FROM events GROUP BY 1),
    r(user_id, xs, i, groups) AS (SELECT user_id, xs, 1, []::DOUBLE[] FROM v UNION ALL
      SELECT user_id, xs, i + 1, CASE WHEN len(list_filter(groups, lambda g: abs(g - xs[i]) <= 0.05 * greatest(abs(g), abs(xs[i])) AND sign(g) = sign(xs[i]))) > 0 THEN groups ELSE list_append(groups, xs[i]) END
      FROM r WHERE i <= len(xs))
    SELECT user_id, len(max_by(groups, i))::INT AS n_groups FROM r GROUP BY 1"""
)
def distinct_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy groups of nearly equal readings."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "value")
    return log.distinct_readings(e, "user_id", "event_id", "value", 0.05).select("user_id", F.size("groups").alias("n_groups"))
