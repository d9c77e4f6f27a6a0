"""Checks, votes, confidence and routes, on readings made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from poolwright.operators import resolve, voting
from poolwright.sources.tables import table

from .base import query, rounded

c = F.col

#: readings: order line = reading, order = cell
_READINGS = """readings AS (
  SELECT l_orderkey AS cell, l_linenumber AS ord, CASE WHEN l_linenumber = 6 THEN NULL WHEN l_linenumber = 5 THEN 1.0 WHEN l_linenumber = 4 THEN l_quantity + 0.5 ELSE l_quantity END AS n,
         CASE WHEN l_linenumber = 7 THEN NULL ELSE l_extendedprice / 1000 END AS mean,
         CASE WHEN l_partkey % 11 = 0 THEN NULL WHEN l_partkey % 13 = 0 THEN 0.0 ELSE l_tax * 100 END AS spread,
         CASE l_suppkey % 4 WHEN 0 THEN 'SD' WHEN 1 THEN 'SE' WHEN 2 THEN 'UNKNOWN' ELSE 'NONE' END AS spread_type,
         l_extendedprice / 1000 - l_quantity / 10 AS ci_low, l_extendedprice / 1000 + l_quantity / 10 + (l_linenumber = 2)::INT * 2.0 AS ci_high,
         0.0 AS axis_low, 100.0 AS axis_high, l_returnflag <> 'A' AS grounded, l_linestatus || repeat('x', l_linenumber * 4) AS quote,
         l_returnflag AS unit, l_linestatus AS metric
  FROM lineitem
)"""


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, q = c("l_linenumber"), c("l_quantity")
    price = c("l_extendedprice") / 1000
    kind = F.when(c("l_suppkey") % 4 == 0, "SD").when(c("l_suppkey") % 4 == 1, "SE").when(c("l_suppkey") % 4 == 2, "UNKNOWN").otherwise("NONE")
    return table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("cell"),
        n.alias("ord"),
        F.when(n == 5, 1.0).when(n == 4, q + 0.5).when(n != 6, q).alias("n"),
        F.when(n != 7, price).alias("mean"),
        F.when(c("l_partkey") % 11 == 0, None).when(c("l_partkey") % 13 == 0, 0.0).otherwise(c("l_tax") * 100).alias("spread"),
        kind.alias("spread_type"),
        (price - q / 10).alias("ci_low"),
        (price + q / 10 + (n == 2).cast("int") * 2.0).alias("ci_high"),
        F.lit(0.0).alias("axis_low"),
        F.lit(100.0).alias("axis_high"),
        (c("l_returnflag") != "A").alias("grounded"),
        F.concat("l_linestatus", F.repeat(F.lit("x"), n * 4)).alias("quote"),
        c("l_returnflag").alias("unit"),
        c("l_linestatus").alias("metric"),
        "l_partkey",
        "l_suppkey",
    )


_SEVERITY = "(VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in resolve.SEVERITY.items()) + ") sev(code, severity)"
_CHECKS = """checks AS (
  SELECT cell, ord, unnest(list_filter([
    CASE WHEN n IS NULL THEN 'n_missing' END, CASE WHEN n <> floor(n) THEN 'n_not_integer' END, CASE WHEN n < 2 THEN 'n_too_small' END,
    CASE WHEN mean IS NULL THEN 'mean_missing' END, CASE WHEN spread_type = 'UNKNOWN' THEN 'dispersion_unknown' END,
    CASE WHEN spread IS NULL AND spread_type <> 'NONE' THEN 'dispersion_missing' END, CASE WHEN spread_type = 'SD' AND spread <= 0 THEN 'sd_nonpositive' END,
    CASE WHEN spread_type = 'SD' AND spread > 0 AND spread < 1e-6 * abs(mean) THEN 'sd_near_zero' END,
    CASE WHEN abs((ci_high + ci_low) / 2 - mean) > 0.1 * (ci_high - ci_low) / 2 THEN 'ci_asymmetric' END,
    CASE WHEN NOT (mean >= axis_low AND mean <= axis_high) THEN 'value_outside_axis' END, CASE WHEN NOT grounded THEN 'quote_not_grounded' END,
    CASE WHEN length(quote) > 0 AND length(quote) < 20 THEN 'quote_short' END], lambda x: x IS NOT NULL)) AS code FROM readings
)"""


@query(f"WITH {_READINGS}, {_CHECKS} SELECT cell, ord, code, severity FROM checks JOIN {_SEVERITY} USING (code)")
def checks_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every check that a reading fails, one row each."""
    return resolve.reading_checks(_readings(spark, sf_dir), ["cell", "ord"])


_GROUP_CHECKS = """g AS (
  SELECT cell, count(DISTINCT n) AS ns, count(DISTINCT unit) AS units, count(DISTINCT metric) AS metrics, max(abs(mean)) AS hi, min(CASE WHEN abs(mean) > 0 THEN abs(mean) END) AS lo,
         avg(CASE WHEN spread_type = 'SE' THEN spread * sqrt(n) END) AS se, avg(CASE WHEN spread_type = 'SD' THEN spread END) AS sd FROM readings GROUP BY 1
), gc AS (
  SELECT cell, unnest(list_filter([CASE WHEN ns > 1 THEN 'n_mismatch' END, CASE WHEN units > 1 THEN 'unit_mismatch' END, CASE WHEN metrics > 1 THEN 'metric_mixed' END,
    CASE WHEN hi >= 10 * lo THEN 'unit_incoherent' END, CASE WHEN abs(se - sd) > 0.05 * sd THEN 'se_sd_inconsistent' END], lambda x: x IS NOT NULL)) AS code FROM g
)"""


@query(f"WITH {_READINGS}, {_GROUP_CHECKS} SELECT cell, code, severity FROM gc JOIN {_SEVERITY} USING (code)")
def checks_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the readings of a cell say against each other."""
    return resolve.group_checks(_readings(spark, sf_dir), ["cell"])


_FLAGS = f"""flags AS (
  SELECT cell, array_to_string(list_sort(list(DISTINCT code)), '|') AS codes, count(DISTINCT code) FILTER (WHERE severity = 'warn') AS warns,
         count(DISTINCT code) FILTER (WHERE severity = 'info') AS infos, count(DISTINCT code) FILTER (WHERE severity = 'error') AS errors
  FROM (SELECT cell, code FROM checks UNION ALL SELECT cell, code FROM gc) JOIN {_SEVERITY} USING (code) GROUP BY 1
)"""


def _flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _readings(spark, sf_dir)
    checks = resolve.reading_checks(rows, ["cell"]).unionByName(resolve.group_checks(rows, ["cell"]))
    return resolve.cell_flags(checks, ["cell"])


@query(f"WITH {_READINGS}, {_CHECKS}, {_GROUP_CHECKS}, {_FLAGS} SELECT * FROM flags")
def cell_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _flags(spark, sf_dir).select("cell", F.array_join("codes", "|").alias("codes"), "warns", "infos", "errors")


@query(
    f"""WITH {_READINGS}, {_CHECKS}, {_GROUP_CHECKS}, {_FLAGS}, f AS (
      SELECT o_orderkey AS cell, CASE o_orderkey % 4 WHEN 0 THEN 'text' WHEN 1 THEN 'table' WHEN 2 THEN 'figure' ELSE 'statistic' END AS kind,
             CASE o_orderkey % 5 WHEN 0 THEN 'agree' WHEN 1 THEN 'agree' WHEN 2 THEN 'single' WHEN 3 THEN 'disagree' ELSE 'none' END AS agreement,
             o_orderkey % 3 AS witnesses, o_orderkey % 6 AS routes, CASE o_orderkey % 7 WHEN 0 THEN 'none' WHEN 1 THEN 'short' ELSE 'all' END AS grounding,
             CASE o_orderkey % 11 WHEN 0 THEN 'refuted' WHEN 1 THEN 'ambiguous' WHEN 2 THEN 'not_run' ELSE 'confirmed' END AS verifier,
             (o_orderkey % 13) / 100.0 AS mad, o_orderkey % 17 = 0 AS conflict, (o_orderkey % 19) / 100.0 AS sigma, o_orderkey % 23 = 0 AS adjudicated, o_orderkey % 29 = 0 AS undirected FROM orders
    ), s AS (
      SELECT cell, CASE kind WHEN 'figure' THEN 0.35 WHEN 'statistic' THEN 0.30 ELSE 0.40 END
        + CASE WHEN agreement = 'agree' AND witnesses >= 2 THEN 0.25 + least(0.10, 0.05 * greatest(routes - 2, 0)) WHEN agreement = 'single' AND witnesses >= 2 THEN 0.25 WHEN agreement = 'disagree' THEN -0.20 ELSE 0 END
        + CASE grounding WHEN 'all' THEN 0.15 WHEN 'short' THEN 0.05 ELSE -0.30 END + CASE verifier WHEN 'confirmed' THEN 0.20 WHEN 'ambiguous' THEN -0.05 ELSE 0 END
        - 0.05 * ((mad > 0.05)::INT + conflict::INT + (sigma > 0.10)::INT) - least(0.24, 0.08 * least(coalesce(warns, 0), 3)) - least(0.03, 0.01 * coalesce(infos, 0)) AS b,
        f.* EXCLUDE (cell), warns, infos FROM f LEFT JOIN flags USING (cell)
    ), r AS (SELECT *, round(greatest(0, least(1, greatest(CASE WHEN adjudicated OR witnesses <= 1 THEN least(b, 0.70) ELSE b END, least(b, 0.45)))), 4) + 0.0 AS score FROM s)
    SELECT cell, score::DOUBLE AS score, CASE WHEN agreement = 'disagree' OR verifier = 'refuted' OR undirected THEN 'needs_human' WHEN score >= 0.75 THEN 'auto_accept'
           WHEN score >= 0.45 THEN 'accept_with_note' ELSE 'needs_human' END AS bucket FROM r"""
)
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Additive score and bucket of each cell."""
    k = c("o_orderkey")
    pick = lambda m, *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (k % m + 1).cast("int"))
    f = table(spark, sf_dir, "orders").select(
        k.alias("cell"),
        pick(4, "text", "table", "figure", "statistic").alias("kind"),
        pick(5, "agree", "agree", "single", "disagree", "none").alias("agreement"),
        (k % 3).alias("witnesses"),
        (k % 6).alias("routes"),
        pick(7, "none", "short", "all", "all", "all", "all", "all").alias("grounding"),
        pick(11, "refuted", "ambiguous", "not_run", *["confirmed"] * 8).alias("verifier"),
        ((k % 13) / 100).alias("mad_share"),
        (k % 17 == 0).alias("figure_conflict"),
        ((k % 19) / 100).alias("sigma_share"),
        (k % 23 == 0).alias("adjudicated"),
        (k % 29 == 0).alias("unresolved_direction"),
        F.lit(0).alias("errors"),
        F.lit(0).alias("contradicting"),
        F.lit(0).alias("capping"),
    )
    flags = _flags(spark, sf_dir).select("cell", F.least("warns", F.lit(3)).alias("warns"), "infos")
    return resolve.confidence_score(f.join(flags, "cell", "left").fillna(0, ["warns", "infos"])).select("cell", "score", "bucket")


@query()
def vote_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The staged vote on each cell (its decision table is in the tests)."""
    line = c("l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("cell"),
        line.alias("ord"),
        F.when(line <= 2, "text/a").when(line <= 4, "table/b").otherwise(F.concat(F.lit("figure/"), c("l_returnflag"))).alias("route"),
        F.lit("cm").alias("unit"),
        (line <= 4).alias("printed"),
        F.round(c("l_quantity") / 5).alias("mean"),
        F.when(line <= 4, 0.5).otherwise(1.5).alias("tolerance"),
        F.when(line > 4, c("l_linestatus")).alias("figure"),
        F.when(line > 4, c("l_returnflag")).alias("place"),
        (c("l_tax") * 100).alias("spread"),
        F.lit("SD").alias("spread_type"),
        F.lit(20.0).alias("n"),
    )
    return rounded(voting.vote(rows, ["cell"]))


_ROUTE_SQL = " ".join(f"WHEN l_suppkey % {p} = 0 THEN '{r}'" for p, r in zip((7, 6, 5, 4, 3, 2, 1), resolve.ROUTES, strict=True))


@query(
    f"""WITH r AS (SELECT l_orderkey, l_linenumber, CASE {_ROUTE_SQL} END AS route, l_quantity AS x, l_linenumber <> 7 AS ok FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN ok THEN route END AS route,
           CASE WHEN ok THEN round(x / list_position(['{"', '".join(resolve.ROUTES)}'], route), 6) + 0.0 END::DOUBLE AS d FROM r"""
)
def route_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first convertible route of each row by precedence."""
    rows = table(spark, sf_dir, "lineitem")
    can = {r: c("l_suppkey") % p == 0 for r, p in zip(resolve.ROUTES, (7, 6, 5, 4, 3, 2, 1), strict=True)}
    value = {r: c("l_quantity") / (i + 1) for i, r in enumerate(resolve.ROUTES)}
    return rounded(resolve.first_route(rows, can, value, c("l_linenumber") != 7).select("l_orderkey", "l_linenumber", "route", "d"))


@query(
    """WITH x AS (SELECT l_orderkey, l_linenumber, CASE l_suppkey % 3 WHEN 0 THEN 'independent_t' WHEN 1 THEN 'one_way_between' ELSE 'mixed' END AS design,
      CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE 38 - l_linenumber % 4 END AS df, l_returnflag = 'A' AS explained, CASE WHEN l_partkey % 9 = 0 THEN 'time' ELSE 'groups' END AS contrast FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN contrast <> 'groups' THEN 'contrast' WHEN design = 'mixed' THEN 'design'
      WHEN df IS NOT NULL AND df <> 38 AND NOT (explained AND 38 - df BETWEEN 1 AND 2) THEN 'df' END AS refused FROM x"""
)
def conversion_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why printed statistics cannot be converted."""
    design = F.when(c("l_suppkey") % 3 == 0, "independent_t").when(c("l_suppkey") % 3 == 1, "one_way_between").otherwise("mixed")
    df = F.when(c("l_partkey") % 10 != 0, 38 - c("l_linenumber") % 4)
    contrast = F.when(c("l_partkey") % 9 == 0, "time").otherwise("groups")
    refused = resolve.convertible(design, df, F.lit(20), F.lit(20), c("l_returnflag") == "A", contrast)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", refused.alias("refused"))


@query(
    """WITH x AS (SELECT p_partkey, p_partkey % 11 = 0 AS refused, p_partkey % 7 > 0 AS directed, CASE WHEN p_partkey % 13 = 0 THEN 1 ELSE 2 END AS groups,
      CASE WHEN p_partkey % 17 = 0 THEN NULL ELSE p_size / 10.0 END AS v, p_partkey % 2 = 0 AS disputed, p_partkey % 3 = 0 AS inferred, p_size / 50.0 AS score, p_partkey % 5 = 0 AS overridden FROM part),
    y AS (SELECT *, CASE WHEN refused THEN 'row_refusal' WHEN NOT directed THEN 'orientation_unresolvable' WHEN coalesce(v, 0) <= 0 AND groups < 2 THEN 'one_group_only' WHEN coalesce(v, 0) <= 0 THEN 'no_variance' END AS veto FROM x)
    SELECT p_partkey, veto, CASE WHEN veto IS NULL THEN CASE WHEN disputed THEN 'disputed_reading_guess' WHEN inferred THEN 'inferred_premise' WHEN score < 0.45 THEN 'low_confidence_value'
      WHEN overridden THEN 'precedence_override' END END AS rule, veto IS NULL AND (disputed OR inferred OR score < 0.45 OR overridden) AS admitted FROM y"""
)
def best_guess_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vetoes and admission rules of held rows."""
    k = c("p_partkey")
    rows = table(spark, sf_dir, "part").select(
        k, (k % 11 == 0).alias("refused"), (k % 7 > 0).alias("direction_resolved"), F.when(k % 13 == 0, 1).otherwise(2).alias("groups"),
        F.when(k % 17 != 0, c("p_size") / 10).alias("v"), (k % 2 == 0).alias("disputed"), (k % 3 == 0).alias("inferred"), (c("p_size") / 50).alias("score"), (k % 5 == 0).alias("overridden"),
    )
    return resolve.best_guess(rows).select("p_partkey", "veto", "rule", "admitted")


@query(
    """WITH b AS (SELECT user_id, event_id // 4 AS measure, CASE event_type WHEN 'click' THEN 'up' WHEN 'view' THEN 'down' WHEN 'signup' THEN 'up' END AS way,
      CASE WHEN event_type = 'signup' AND value > 50 THEN 'discarded' WHEN event_id % 11 = 0 THEN 'lost' ELSE 'live' END AS state, event_id % 5 = 0 AS scale, event_id % 3 = 0 AS third FROM events),
    t AS (SELECT user_id, measure, bool_or(third) AS third, count(*) FILTER (state = 'discarded') AS discarded, count(*) FILTER (state = 'lost') AS lost, count(way) FILTER (state = 'live') AS n FROM b GROUP BY 1, 2),
    w AS (SELECT user_id, measure, way, count(*) FILTER (state = 'live') AS votes, count(DISTINCT scale) FILTER (state = 'live') AS scales FROM b WHERE way IS NOT NULL GROUP BY 1, 2, 3 HAVING count(*) FILTER (state = 'live') > 0),
    x AS (SELECT t.*, w.way, votes, scales, EXISTS (FROM b WHERE b.user_id = t.user_id AND b.measure = t.measure AND b.state = 'discarded' AND b.way <> w.way) AS denied,
      EXISTS (FROM b WHERE b.user_id = t.user_id AND b.measure = t.measure AND b.state = 'lost' AND b.way <> w.way) AS dissent FROM t JOIN w ON w.user_id = t.user_id AND w.measure = t.measure),
    y AS (SELECT user_id, measure, way, CASE WHEN third AND n >= 2 AND 2 * votes > n AND scales = 1 AND NOT denied THEN 'majority' WHEN NOT third AND n >= 2 AND votes = n AND NOT denied THEN 'agreement'
      WHEN NOT third AND n = 1 AND lost > 0 AND discarded = 0 AND NOT dissent THEN 'single_witness' END AS how FROM x)
    SELECT t.user_id, t.measure, t.discarded, coalesce(y.how, 'abstain') AS how, CASE WHEN y.how IS NOT NULL THEN y.way = 'up' END AS higher_is_better
    FROM t LEFT JOIN y ON y.user_id = t.user_id AND y.measure = t.measure AND y.how IS NOT NULL"""
)
def orientation_ballots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Direction of each measure from its readers' ballots."""
    up = F.when(c("event_type").isin("click", "signup"), True).when(c("event_type") == "view", False)
    bad = (c("event_type") == "signup") & (c("value") > 50)
    b = table(spark, sf_dir, "events").select(
        "user_id", F.floor(c("event_id") / 4).alias("measure"), up.alias("higher_is_better"), bad.alias("contradicts"), ((c("event_id") % 11 == 0) & ~bad).alias("not_run"),
        (c("event_id") % 5 == 0).cast("string").alias("scale"), (c("event_id") % 3 == 0).alias("third_read"),
    )
    return resolve.orientation(b, ["user_id", "measure"]).select("user_id", "measure", "discarded", "how", "higher_is_better")


@query(
    """WITH f AS (SELECT l_orderkey AS paper, CASE WHEN l_linenumber % 3 = 0 THEN NULL WHEN l_returnflag = 'A' THEN 'SD' ELSE 'SE' END AS t, l_partkey % 40 = 0 AS conflict FROM lineitem)
    SELECT paper, max(t) AS house FROM f GROUP BY 1 HAVING count(t) >= 2 AND count(DISTINCT t) = 1 AND NOT bool_or(conflict)"""
)
def house_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spread type that all figures of a paper use."""
    kind = F.when(c("l_linenumber") % 3 == 0, None).when(c("l_returnflag") == "A", "SD").otherwise("SE")
    f = table(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("paper"), kind.alias("spread_type"), (c("l_partkey") % 40 == 0).alias("conflict"))
    return resolve.house_spread(f, "paper")
