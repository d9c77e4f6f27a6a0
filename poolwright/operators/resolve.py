"""Cell resolution: deterministic checks, confidence, routes to an effect, best-guess rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolwright.functions import effects as e

c = F.col

# fixed values: confidence weights, thresholds and code families
BASE_SCORE = {"text": 0.40, "table": 0.40, "figure": 0.35, "statistic": 0.30}
ACCEPT, NOTE, CAP = 0.75, 0.45, 0.70
BUCKETS = ("needs_human", "accept_with_note", "auto_accept")
ROUTES = ("text_mean_sd", "table", "text_mean_se_ci", "figure", "test_statistic", "p_value", "reported_d")
CONVERTIBLE_DESIGNS = ("independent_t", "one_way_between")
CAPPING_CODES = (
    "calibration_single_witness", "calibration_refuted", "collapsed_across_x", "categorical_point_read", "categorical_x_resolved_from_readings",
    "reopened_on_better_source", "calibration_missing", "calibration_two_point", "dispersion_type_from_legend", "dispersion_type_from_caption",
    "series_marker_mismatch", "series_caption_mismatch", "orientation_single_witness", "orientation_by_majority", "orientation_direction_conflict",
    "panel_not_isolated", "crop_reacquired", "negligible_split_resolved", "panel_labels_disputed", "locator_reads_set_aside", "n_before_exclusions",
    "reread_disputes_human_value",
)
CONTRADICTING_CODES = (
    "quote_row_only", "series_identity_conflict", "series_transposed", "axis_conflict", "orientation_reader_contradicts_values", "locator_reads_conflict",
    "locator_panel_mismatch",
)
SEVERITY = {
    "n_not_integer": "error", "n_too_small": "error", "n_missing": "warn", "n_mismatch": "warn", "sd_nonpositive": "error", "sd_near_zero": "warn",
    "se_sd_inconsistent": "warn", "ci_asymmetric": "warn", "value_outside_axis": "error", "mean_missing": "warn", "dispersion_unknown": "warn",
    "dispersion_missing": "warn", "implausible_dispersion": "warn", "quote_not_grounded": "error", "quote_short": "info", "unit_mismatch": "warn",
    "metric_mixed": "warn", "unit_incoherent": "warn", "df_missing": "error", "sign_mismatch": "error", "orientation_unknown": "warn",
    "group_label_swapped": "error", "test_stat_missing_df": "error", "df_shortfall_unexplained": "error",
}


def severity(code: Column) -> Column:
    """Severity of a check code; the df_off_by_ family warns; unknown codes have none."""
    table = F.create_map(*[F.lit(x) for pair in SEVERITY.items() for x in pair])
    return F.when(code.startswith("df_off_by_"), "warn").otherwise(F.element_at(table, code))


def reading_checks(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, severity): what is wrong with single readings.

    Needs n, mean, spread, spread_type, ci_low, ci_high, axis_low, axis_high, grounded, quote.
    """
    half = (c("ci_high") - c("ci_low")) / 2
    inside = (c("mean") >= c("axis_low")) & (c("mean") <= c("axis_high"))
    rules = {
        "n_missing": c("n").isNull(),
        "n_not_integer": c("n") != F.floor("n"),
        "n_too_small": c("n") < 2,
        "mean_missing": c("mean").isNull(),
        "dispersion_unknown": c("spread_type") == "UNKNOWN",
        "dispersion_missing": c("spread").isNull() & (c("spread_type") != "NONE"),
        "sd_nonpositive": (c("spread_type") == "SD") & (c("spread") <= 0),
        "sd_near_zero": (c("spread_type") == "SD") & (c("spread") > 0) & (c("spread") < 1e-6 * F.abs("mean")),
        "ci_asymmetric": F.abs((c("ci_high") + c("ci_low")) / 2 - c("mean")) > 0.1 * half,
        "value_outside_axis": ~inside,
        "quote_not_grounded": ~c("grounded"),
        "quote_short": (F.length("quote") > 0) & (F.length("quote") < 20),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in rules.items()]))
    return df.select(*keys, F.explode(found).alias("code")).withColumn("severity", severity(c("code")))


def group_checks(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, code, severity): what readings of one cell say against each other."""
    size = F.abs("mean")
    g = df.groupBy(*keys).agg(
        F.count_distinct("n").alias("ns"),
        F.size(F.collect_set("unit")).alias("units"),
        F.size(F.collect_set("metric")).alias("metrics"),
        F.max(size).alias("largest"),
        F.min(F.when(size > 0, size)).alias("least"),
        F.avg(F.when(c("spread_type") == "SE", c("spread") * F.sqrt("n"))).alias("from_se"),
        F.avg(F.when(c("spread_type") == "SD", c("spread"))).alias("sd"),
    )
    rules = {
        "n_mismatch": c("ns") > 1,
        "unit_mismatch": c("units") > 1,
        "metric_mixed": c("metrics") > 1,
        "unit_incoherent": c("largest") >= 10 * c("least"),
        "se_sd_inconsistent": F.abs(c("from_se") - c("sd")) > 0.05 * c("sd"),
    }
    found = F.array_compact(F.array(*[F.when(F.coalesce(cond, F.lit(False)), F.lit(code)) for code, cond in rules.items()]))
    return g.select(*keys, F.explode(found).alias("code")).withColumn("severity", severity(c("code")))


def cell_flags(checks: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of distinct codes by severity and family, and the codes in order."""
    distinct = checks.select(*keys, "code", "severity").distinct()
    capping, contradicting = c("code").isin(list(CAPPING_CODES)), c("code").isin(list(CONTRADICTING_CODES))
    return distinct.groupBy(*keys).agg(
        F.array_sort(F.collect_set("code")).alias("codes"),
        F.count_if((c("severity") == "warn") & ~capping & ~contradicting).alias("warns"),
        F.count_if(c("severity") == "info").alias("infos"),
        F.count_if((c("severity") == "error") & (c("code") != "calibration_refuted")).alias("errors"),
        F.count_if(contradicting).alias("contradicting"),
        F.count_if((c("severity") == "warn") & capping).alias("capping"),
    )


def confidence_score(df: DataFrame) -> DataFrame:
    """`score` and `bucket` of each cell.

    Needs kind, agreement, witnesses, routes, grounding (all / short / none / null), verifier, mad_share,
    figure_conflict, sigma_share, warns, infos, errors, contradicting, capping, adjudicated, unresolved_direction.
    Capping codes cannot take a score below the lower of what it was and the note threshold.
    """
    base = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for p in BASE_SCORE.items() for x in p]), c("kind")), F.lit(0.40))
    agree = (
        F.when((c("agreement") == "agree") & (c("witnesses") >= 2), 0.25 + F.least(F.lit(0.10), 0.05 * F.greatest(c("routes") - 2, F.lit(0))))
        .when((c("agreement") == "single") & (c("witnesses") >= 2), 0.25)
        .when(c("agreement") == "disagree", -0.20)
        .otherwise(0.0)
    )
    grounding = F.when(c("grounding") == "all", 0.15).when(c("grounding") == "short", 0.05).when(c("grounding") == "none", -0.30).otherwise(0.0)
    verifier = F.when(c("verifier") == "confirmed", 0.20).when(c("verifier") == "ambiguous", -0.05).otherwise(0.0)
    noise = F.when(c("mad_share") > 0.05, -0.05).otherwise(0.0) + F.when(c("figure_conflict"), -0.05).otherwise(0.0) + F.when(c("sigma_share") > 0.10, -0.05).otherwise(0.0)
    flags = -F.least(F.lit(0.24), 0.08 * c("warns")) - F.least(F.lit(0.03), 0.01 * c("infos")) - F.least(F.lit(0.24), 0.08 * c("contradicting"))
    before = base + agree + grounding + verifier + noise + flags
    floor = F.least(c("before"), F.lit(NOTE))
    after = c("before") - F.least(F.lit(0.24), 0.08 * c("capping"))
    capped = F.when(c("adjudicated") | (c("capping") > 0) | (c("witnesses") <= 1), F.least(after, F.lit(CAP))).otherwise(after)
    score = F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.greatest(capped, floor))), 4)
    human = (
        (c("agreement") == "disagree") | (c("verifier") == "refuted") | (c("errors") > 0) | (c("contradicting") > 0) | c("unresolved_direction")
    )
    out = df.withColumn("before", before).withColumn("score", score)
    bucket = F.when(human, BUCKETS[0]).when(c("score") >= ACCEPT, BUCKETS[2]).when(c("score") >= NOTE, BUCKETS[1]).otherwise(BUCKETS[0])
    margin = F.least(F.abs(c("score") - ACCEPT), F.abs(c("score") - NOTE))
    return out.withColumn("bucket", bucket).withColumn("margin", F.round(margin, 4)).drop("before")


def stricter(a: Column, b: Column) -> Column:
    """The lower of two buckets."""
    order = F.array(*[F.lit(x) for x in BUCKETS])
    return F.when(F.array_position(order, a) <= F.array_position(order, b), a).otherwise(b)


def convertible(design: Column, df: Column, n_a: Column, n_b: Column, explained: Column, contrast: Column) -> Column:
    """Why a printed statistic cannot become an effect, or null: contrast, design, then the error df exactly
    n_a + n_b - 2 (up to two fewer where the shortfall is explained)."""
    short = n_a + n_b - 2 - df
    return (
        F.when(contrast != "groups", "contrast")
        .when(~design.isin(list(CONVERTIBLE_DESIGNS)), "design")
        .when(df.isNotNull() & (short != 0) & ~(explained & (short > 0) & (short <= 2)), "df")
    )


def first_route(df: DataFrame, available: dict[str, Column], values: dict[str, Column], resolved_direction: Column) -> DataFrame:
    """`route` and `d`: the first route by precedence that converts; an unresolved direction refuses all.

    `rejected` lists the better routes that did not.
    """
    ok = [F.coalesce(available[r], F.lit(False)) & values[r].isNotNull() for r in ROUTES]
    route = F.coalesce(*[F.when(x, F.lit(r)) for x, r in zip(ok, ROUTES, strict=True)])
    value = F.coalesce(*[F.when(x, values[r]) for x, r in zip(ok, ROUTES, strict=True)])
    place = F.array_position(F.array(*[F.lit(r) for r in ROUTES]), c("route"))
    rejected = F.array_compact(F.array(*[F.when(~x & (F.coalesce(place, F.lit(99)) > i + 1), F.lit(r)) for i, (x, r) in enumerate(zip(ok, ROUTES, strict=True))]))
    out = df.withColumn("route", F.when(resolved_direction, route)).withColumn("d", F.when(resolved_direction, value))
    return out.withColumn("rejected", rejected)


def arm_sd(kind: Column, spread: Column, low: Column, high: Column, n: Column) -> Column:
    """SD of an arm by the type of its spread; null where it cannot be had."""
    return (
        F.when(kind == "SD", spread)
        .when(kind == "SE", e.sd_from_se(spread, n))
        .when(kind == "CI95", e.sd_from_ci(low, high, n))
        .when(kind == "IQR", e.sd_from_iqr(low, high, n))
        .when(kind == "RANGE", e.sd_from_range(low, high, n))
    )


def house_spread(figures: DataFrame, paper: str) -> DataFrame:
    """The spread type that all of a paper's figures name: two figures at least, one type, no conflict."""
    g = figures.groupBy(paper).agg(
        F.count_if(c("spread_type").isNotNull()).alias("naming"), F.count_distinct("spread_type").alias("types"), F.bool_or("conflict").alias("conflict"), F.max("spread_type").alias("house")
    )
    return g.where((c("naming") >= 2) & (c("types") == 1) & ~F.coalesce("conflict", F.lit(False))).select(paper, "house")


def best_guess(df: DataFrame) -> DataFrame:
    """`veto` and `rule` of held rows, first match each; `admitted` where a rule holds and nothing vetoes."""
    veto = (
        F.when(c("refused"), "row_refusal").when(~c("direction_resolved"), "orientation_unresolvable")
        .when((c("v").isNull() | (c("v") <= 0)) & (c("groups") < 2), "one_group_only").when(c("v").isNull() | (c("v") <= 0), "no_variance")
    )
    rule = (
        F.when(c("disputed"), "disputed_reading_guess").when(c("inferred"), "inferred_premise").when(c("score") < NOTE, "low_confidence_value")
        .when(c("overridden"), "precedence_override")
    )
    return df.withColumn("veto", veto).withColumn("rule", F.when(veto.isNull(), rule)).withColumn("admitted", c("rule").isNotNull())


def orientation(ballots: DataFrame, keys: list[str]) -> DataFrame:
    """Direction of a measure from its readers' ballots.

    ballots: keys, higher_is_better (null: none named), contradicts (the claim is against the means),
    not_run (the reply was none), scale (what the raw values are), third_read (it was bought to settle).
    Contradicted readers and replies that were none do not decide. A direction that a contradicted
    reader named otherwise is not recorded. With a third read a strict majority on one raw scale
    decides; without, two readers of one answer; one reader only where its partner's reply was none,
    named nothing else, and nobody was contradicted.
    """
    flag = lambda x: F.coalesce(c(x), F.lit(False))
    counts, up = ~flag("contradicts") & ~flag("not_run"), c("higher_is_better")
    named = lambda rows, way: F.count_if(rows & (up == way))
    scales = lambda way: F.size(F.collect_set(F.when(counts & (up == way), F.coalesce("scale", F.lit("")))))
    g = ballots.groupBy(*keys).agg(
        F.count_if(flag("contradicts")).alias("discarded"), F.count_if(flag("not_run")).alias("lost"), F.max(flag("third_read")).alias("third"),
        named(counts, True).alias("up"), named(counts, False).alias("down"), scales(True).alias("up_scales"), scales(False).alias("down_scales"),
        named(flag("contradicts"), True).alias("against_down"), named(flag("contradicts"), False).alias("against_up"),
        named(flag("not_run"), True).alias("lost_up"), named(flag("not_run"), False).alias("lost_down"),
    )
    n, more_up = c("up") + c("down"), c("up") > c("down")
    free = F.when(more_up, c("against_up") == 0).otherwise(c("against_down") == 0)
    one_scale = F.when(more_up, c("up_scales")).otherwise(c("down_scales")) == 1
    dissent = F.when(more_up, c("lost_down")).otherwise(c("lost_up")) > 0
    how = (
        F.when(c("third") & (n >= 2), F.when((c("up") != c("down")) & one_scale & free, "majority").otherwise("abstain"))
        .when((n >= 2) & ((c("up") == 0) | (c("down") == 0)) & free, "agreement")
        .when((n == 1) & (c("lost") > 0) & (c("discarded") == 0) & ~c("third") & ~dissent, "single_witness").otherwise("abstain")
    )
    g = g.withColumn("how", how)
    return g.select(*keys, "discarded", "up", "down", "how", F.when(c("how") != "abstain", more_up).alias("higher_is_better"))
