"""Queries of the small rules on readings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolwright.functions import readings
from poolwright.plans.base import query, rounded
from poolwright.sources.tables import table

c = F.col


@query(
    """SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'figure:readout' WHEN l_linenumber = 2 THEN 'figure' WHEN l_linenumber = 3 THEN 'figure' WHEN l_linenumber = 4 THEN 'statistic'
      WHEN l_linenumber = 5 THEN 'table' ELSE 'text' END || '/' || CASE WHEN l_returnflag = 'A' THEN 'opus' ELSE 'sonnet' END AS route,
      l_linenumber > 5 AND l_linestatus = 'F' AND l_partkey % 7 > 0 AND l_suppkey % 5 > 0 AS votes FROM lineitem"""
)
def reading_routes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who votes by which route, and which readings may."""
    line = c("l_linenumber")
    extractor = F.when(line == 1, "digitize:readout:m:direct").when(line == 2, "digitize:").otherwise("read:m")
    source = F.when(line == 3, "figure").when(line == 5, "table").otherwise("text")
    kind = F.when(line == 4, "test_statistic").when(line > 5, "group_stats").otherwise("other")
    model = F.when(c("l_returnflag") == "A", "opus-4-1").otherwise("sonnet-20250101")
    status = F.when(c("l_linestatus") == "F", "found").otherwise("absent")
    mean = F.when(c("l_partkey") % 7 > 0, c("l_quantity"))
    dropped = F.when(c("l_suppkey") % 5 == 0, True)
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber", readings.route_key(readings.modality(extractor, source, kind), model).alias("route"), readings.usable(status, kind, mean, dropped).alias("votes")
    )


@query(
    """WITH n AS (SELECT l_orderkey, l_returnflag, count(*) AS n, min(l_linenumber) AS seen FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n DESC, seen, l_returnflag) AS place FROM n) SELECT l_orderkey, l_returnflag FROM r WHERE place = 1"""
)
def first_seen_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent value of each order's lines; of several the one seen first."""
    flag = F.when(c("l_returnflag") != "N", c("l_returnflag"))
    return readings.first_mode(table(spark, sf_dir, "lineitem").withColumn("l_returnflag", flag), ["l_orderkey"], "l_returnflag", "l_linenumber")


@query(
    """WITH x AS (SELECT p_partkey, p_size / 50.0 - 0.4 AS e, p_retailprice / 10000 AS se, CASE WHEN p_partkey % 4 > 0 THEN p_size / 60.0 - 0.5 END AS low, CASE WHEN p_partkey % 5 > 0 THEN p_size / 40.0 - 0.2 END AS high FROM part),
    y AS (SELECT p_partkey, CASE WHEN low IS NOT NULL AND high IS NOT NULL THEN low ELSE e - 1.96 * se END AS low, CASE WHEN low IS NOT NULL AND high IS NOT NULL THEN high ELSE e + 1.96 * se END AS high, low AS l, high AS h FROM x)
    SELECT p_partkey, round(low, 6) + 0.0 AS low, round(high, 6) + 0.0 AS high, l IS NOT NULL AND h IS NOT NULL AND (l > 0 OR h < 0) AS moves FROM y"""
)
def interval_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals, given or normal, and whether a row left out moves the pool's across zero."""
    low = F.when(c("p_partkey") % 4 > 0, c("p_size") / 60 - 0.5)
    high = F.when(c("p_partkey") % 5 > 0, c("p_size") / 40 - 0.2)
    found = readings.interval_or_normal(low, high, c("p_size") / 50 - 0.4, c("p_retailprice") / 10000)
    moves = readings.crosses_zero(F.lit(-0.5), F.lit(0.5), low, high)
    return rounded(table(spark, sf_dir, "part").select("p_partkey", found["low"].alias("low"), found["high"].alias("high"), moves.alias("moves")))


@query(
    """WITH s AS (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'wanted' WHEN 'O' THEN 'unsure' ELSE 'unread' END AS state, o_custkey % 3 > 0 AS open, o_totalprice FROM orders),
    r AS (SELECT *, row_number() OVER (PARTITION BY state ORDER BY o_totalprice DESC, o_orderkey) AS place FROM s WHERE state = 'wanted' OR open)
    SELECT o_orderkey, CASE state WHEN 'wanted' THEN 0 WHEN 'unsure' THEN 1 ELSE 2 END AS stage, place::INT AS place FROM r WHERE state <> 'unsure' OR place <= 100"""
)
def fetch_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is fetched in which turn: the wanted, up to 100 unsure ones, the unread."""
    state = F.when(c("o_orderstatus") == "F", "wanted").when(c("o_orderstatus") == "O", "unsure").otherwise("unread")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", state.alias("state"), (c("o_custkey") % 3 > 0).alias("open"), "o_totalprice")
    return readings.fetch_order(rows, "state", "open", [F.desc("o_totalprice"), c("o_orderkey")], 100).select("o_orderkey", "stage", "place")


@query(
    r"""SELECT p_partkey, trim(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '_') AS measure, array_to_string(regexp_split_to_array(lower(p_type), '[\s-]+'), '|') AS tokens,
      (abs(p_size - 20) + abs(p_partkey % 30 - 12))::BIGINT AS distance FROM part"""
)
def measure_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures' keys and tokens, and the distance of group sizes."""
    away = readings.n_distance(c("p_size"), c("p_partkey") % 30, F.lit(20), F.lit(12)).cast("long")
    return table(spark, sf_dir, "part").select(
        "p_partkey", readings.measure_key(c("p_type")).alias("measure"), F.array_join(readings.term_tokens(c("p_type")), "|").alias("tokens"), away.alias("distance")
    )
