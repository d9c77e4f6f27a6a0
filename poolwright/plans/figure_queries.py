"""Figure numerics and search planning over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolwright.operators import figures, search
from poolwright.sources.tables import table

from .base import query, rounded

c = F.col


@query(
    """WITH x AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity END AS u, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE -l_discount * 400 END AS d FROM lineitem),
    y AS (SELECT l_orderkey, l_linenumber, CASE WHEN abs(u) > 2 THEN abs(u) END AS u, CASE WHEN abs(d) > 2 THEN abs(d) END AS d FROM x),
    z AS (SELECT *, u IS NOT NULL AND d IS NOT NULL AND abs(u - d) > greatest(2.0, 0.25 * greatest(u, d)) AS far FROM y)
    SELECT l_orderkey, l_linenumber, round(CASE WHEN u IS NULL THEN d WHEN d IS NULL THEN u WHEN far THEN greatest(u, d) ELSE (u + d) / 2 END, 6) + 0.0 AS half,
      CASE WHEN u IS NULL AND d IS NULL THEN NULL WHEN u IS NULL THEN 'down' WHEN d IS NULL THEN 'up' WHEN far THEN CASE WHEN u >= d THEN 'up' ELSE 'down' END END AS side FROM z"""
)
def error_bar_arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half-lengths of error bars from their two arms."""
    n = c("l_linenumber")
    up, down = F.when(n % 3 != 0, c("l_quantity")), F.when(n % 4 != 0, -c("l_discount") * 400)
    arms = figures.resolve_arms(up, down, F.lit(2.0))
    return rounded(table(spark, sf_dir, "lineitem").select("l_orderkey", n, arms.alias("x")).select("l_orderkey", "l_linenumber", "x.half", "x.side"))


@query(
    """WITH g AS (SELECT l_orderkey, max(l_quantity) - min(l_quantity) AS ms, greatest(0.02 * 50, 0.5 * 10) AS mt, max(l_tax * 100) - min(l_tax * 100) AS es, median(l_tax * 100) AS m FROM lineitem GROUP BY 1)
    SELECT l_orderkey, round(ms, 6) + 0.0 AS mean_span, mt::DOUBLE AS mean_tolerance, round(es, 6) + 0.0 AS error_span, round(greatest(0.1 * m, 0.5), 6) + 0.0 AS error_tolerance,
      ms <= mt AND round(es, 9) <= round(greatest(0.1 * m, 0.5), 9) AS agrees FROM g"""
)
def dual_tolerance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the routes of a series agree on means and errors."""
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", F.round(c("l_tax") * 100, 9).alias("error"))
    return rounded(figures.dual_tolerance(rows, ["l_orderkey"], "l_quantity", "error", F.lit(50.0), F.lit(10.0), F.lit(1.0)))


@query(
    """SELECT p_partkey, round(CASE WHEN p_size % 2 = 0 THEN power(10.0, 0.01 * p_size + 0.5) ELSE 0.01 * p_size + 0.5 END, 9) + 0.0 AS value, p_size::DOUBLE AS px,
      round(CASE WHEN p_size % 2 = 0 THEN 0.01 * ln(10.0) * power(10.0, 0.01 * p_size + 0.5) ELSE 0.01 END, 9) + 0.0 AS resolution FROM part"""
)
def axis_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels to values and back, and what a pixel is worth."""
    log, a, b = c("p_size") % 2 == 0, F.lit(0.01), F.lit(0.5)
    rows = table(spark, sf_dir, "part").withColumn("value", figures.px_to_value(a, b, c("p_size"), log))
    back = F.round(figures.value_to_px(a, b, c("value"), log), 6)
    return rounded(rows.select("p_partkey", "value", back.alias("px"), figures.pixel_resolution(a, c("value"), log).alias("resolution")), 9)


_AXES = """ticks AS (
  SELECT user_id AS axis, 20.0 * row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS px,
         CASE WHEN user_id % 2 = 0 THEN power(10.0, 0.2 * row_number() OVER (PARTITION BY user_id ORDER BY event_id)) ELSE 3.0 * row_number() OVER (PARTITION BY user_id ORDER BY event_id) + (value % 1) END AS value
  FROM events
)"""


@query(
    f"""WITH {_AXES}, n AS (SELECT axis, count(*) AS n, min(value) AS lo, max(value) AS hi FROM ticks GROUP BY 1),
    f AS (SELECT axis, regr_slope(value, px) AS a, regr_intercept(value, px) AS b, regr_slope(log10(value), px) AS la, regr_intercept(log10(value), px) AS lb FROM ticks GROUP BY 1),
    r AS (SELECT axis, sqrt(avg(power((value - a * px - b) / a, 2))) AS rl, sqrt(avg(power((log10(value) - la * px - lb) / la, 2))) AS rg FROM ticks JOIN f USING (axis) GROUP BY 1)
    SELECT axis, n, CASE WHEN n >= 3 AND lo > 0 AND hi >= 9 * lo AND rg < rl THEN 'log' ELSE 'linear' END AS scale FROM n JOIN r USING (axis)"""
)
def axis_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linear or logarithmic axes from their ticks."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    value = F.when(c("user_id") % 2 == 0, F.pow(F.lit(10.0), 0.2 * place)).otherwise(3.0 * place + c("value") % 1)
    ticks = table(spark, sf_dir, "events").select(c("user_id").alias("axis"), (20.0 * place).alias("px"), value.alias("value"))
    return figures.best_scale(ticks, "axis", ratio=9.0).select("axis", "n", "scale")


@query(
    """SELECT conv_id, count(*) AS readers, count(*) FILTER (WHERE role = 'user') AS blind, count(*) FILTER (WHERE role = 'system') AS partial, 0::BIGINT AS inferred,
      count(*) >= 2 AND 2 * count(*) FILTER (WHERE role = 'user') > count(*) AS abstain FROM conversations GROUP BY 1"""
)
def figure_legibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(c("role") == "user", "blind").when(c("role") == "system", "partial").otherwise("read")
    return figures.legibility(table(spark, sf_dir, "conversations").select("conv_id", state.alias("state")), ["conv_id"])


@query(
    """WITH RECURSIVE e AS (SELECT DISTINCT l_suppkey AS a, l_partkey + 1000000 AS b FROM lineitem),
    m AS (SELECT a, b FROM e UNION SELECT b, a FROM e), r(id, round) AS (SELECT 1::BIGINT, 0 UNION SELECT m.b, round + 1 FROM r JOIN m ON m.a = r.id WHERE round < 3)
    SELECT id, min(round)::INT AS round FROM r GROUP BY 1"""
)
def snowball_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a seed reaches in three rounds of links."""
    e = table(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("a"), (c("l_partkey") + 1000000).alias("b")).distinct()
    both = e.unionByName(e.select(c("b").alias("a"), c("a").alias("b")))
    return search.snowball(both, spark.range(1, 2).select("id"), 3)


_BLOCKS = [["the", "licensed", "de"], ["and", "of", "rights"]]


@query()
def width_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms dropped from a query that is too wide (held against brute force in the tests)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    most = max(1, docs.count() // 20)
    _, dropped = search.prune(docs, "text", _BLOCKS, {"de", "of"}, {"rights"}, most)
    return spark.createDataFrame([(i, t, n) for i, (t, n) in enumerate(dropped)], "turn int, term string, hits long")


@query(
    r"""SELECT doc_id FROM documents WHERE regexp_matches(lower(text), '(^|[^\w])(the|licensed)([^\w]|$)') AND regexp_matches(lower(text), '(^|[^\w])(and|rights)([^\w]|$)')"""
)
def boolean_query_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.query_hits(table(spark, sf_dir, "documents").select("doc_id", "text"), "text", [["the", "licensed"], ["and", "rights"]]).select("doc_id")


@query(
    """WITH r AS (SELECT o_orderkey AS k, count(DISTINCT l_returnflag) AS f, count(*) AS n, any_value(o_orderstatus) AS s FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1)
    SELECT sum(greatest(greatest(f, 1), n))::BIGINT AS identified, count(*) AS "unique", count(*) FILTER (WHERE k % 10 = 0) AS possible_duplicates, count(*) FILTER (WHERE k % 12 = 0) AS excluded_by_rule,
      count(*) FILTER (WHERE s = 'O') AS included, count(*) FILTER (WHERE s = 'F') AS unsure, 0::BIGINT AS screened_out, count(*) FILTER (WHERE s = 'P') AS unread, count(*) FILTER (WHERE n > 4) AS fetched FROM r"""
)
def selection_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of a selection derived from its rows."""
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("found_by"), F.count("*").alias("rows"))
    state = F.when(c("o_orderstatus") == "O", "include").when(c("o_orderstatus") == "F", "unsure")
    k = c("o_orderkey")
    rows = table(spark, sf_dir, "orders").join(lines, c("l_orderkey") == k).select(
        "found_by", "rows", state.alias("state"), (k % 10 == 0).alias("duplicate"), (k % 12 == 0).alias("excluded"), (c("rows") > 4).alias("fetched")
    )
    return search.selection_ladder(rows)


@query(
    """WITH a AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 3 > 0), b AS (SELECT c_custkey AS k, c_nationkey + (c_custkey % 5 = 0)::INT AS v FROM customer WHERE c_custkey % 4 > 0)
    SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'second_only' WHEN b.k IS NULL THEN 'first_only' WHEN a.v = b.v THEN 'agreed' ELSE 'conflict' END AS state FROM a FULL JOIN b ON a.k = b.k"""
)
def two_reader_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where two readers' maps agree, conflict or stand alone (full outer join)."""
    rows = table(spark, sf_dir, "customer")
    a = rows.where("c_custkey % 3 > 0").select(c("c_custkey").alias("k"), c("c_nationkey").alias("v"))
    b = rows.where("c_custkey % 4 > 0").select(c("c_custkey").alias("k"), (c("c_nationkey") + (c("c_custkey") % 5 == 0).cast("int")).alias("w"))
    state = F.when(c("v").isNull(), "second_only").when(c("w").isNull(), "first_only").when(c("v") == c("w"), "agreed").otherwise("conflict")
    return a.join(b, "k", "full_outer").select("k", state.alias("state"))
