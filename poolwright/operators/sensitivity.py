"""The named analyses that are pooled beside a primary one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import pooling
from .aggregate import one_row_per_cluster

c = F.col

# fixed values: names of the analyses; by_analysis_metric has one for each metric
ANALYSES = (
    "primary",
    "exclude_figure_derived",
    "exclude_test_statistic_derived",
    "include_needs_human",
    "best_guess",
    "hartung_knapp",
    "normal_z",
    "with_digitization_variance",
    "without_digitization_variance",
    "one_row_per_paper",
    "all_rows",
    "dependency",
)
BY_METRIC = "by_analysis_metric:"


def route_head(route: Column) -> Column:
    return F.element_at(F.split(F.coalesce(route, F.lit("")), ":"), 1)


def is_figure_route(route: Column) -> Column:
    return F.startswith(route_head(route), F.lit("figure")) | F.startswith(route_head(route), F.lit("digitize"))


def is_statistic_route(route: Column) -> Column:
    return route_head(route).isin("test_statistic", "p_value")


def named_analyses(df: DataFrame, keys: list[str], method: str = "DL", r: float = 0.5) -> DataFrame:
    """One row for each group and named analysis: k, clusters, pool, interval, difference from the primary estimate.

    df: cluster, y, v, n_a, n_b, route, metric (text), digitised (variance of reading a figure, or null),
    held (for a human), admitted (a rule takes the held row at its own value). Rows without an estimate or a positive
    variance are in no analysis. Fewer than two rows are counted and not pooled. Primary rows are taken
    as independent; the dependency analysis of composites is none, so its row is empty. Every row is read
    once and repeated for the analyses that have it; sums by group and analysis combine on the map side.
    """
    held, admitted = F.coalesce("held", F.lit(False)), F.coalesce("admitted", F.lit(False))
    usable = c("y").isNotNull() & ~F.isnan("y") & c("v").isNotNull() & ~F.isnan("v") & (c("v") > 0)
    rows = df.where(usable)
    when = {
        "exclude_figure_derived": ~held & ~is_figure_route(c("route")),
        "exclude_test_statistic_derived": ~held & ~is_statistic_route(c("route")),
        "include_needs_human": F.lit(True),
        "best_guess": ~held | admitted,
        "one_row_per_paper": F.lit(False),
        "dependency": F.lit(False),
    }
    tags = [F.when(when.get(name, ~held), F.lit(name)) for name in ANALYSES]
    tags.append(F.when(~held, F.concat(F.lit(BY_METRIC), c("metric"))))
    read = F.when((c("analysis") == "with_digitization_variance") & is_figure_route(c("route")), F.coalesce("digitised", F.lit(0.0))).otherwise(0.0)
    tagged = rows.withColumn("analysis", F.explode(F.array_compact(F.array(*tags)))).select(*keys, "analysis", "cluster", "y", (c("v") + read).alias("v"))
    papers = one_row_per_cluster(rows.where(~held), keys, "cluster", r).select(*keys, F.lit("one_row_per_paper").alias("analysis"), "cluster", "y", "v")
    tagged = tagged.unionByName(papers)

    by = [*keys, "analysis"]
    counts = tagged.groupBy(*by).agg(F.count("*").alias("k"), F.count_distinct("cluster").alias("clusters"))
    kept = [*by, "estimate", "se", "ci_low", "ci_high", "tau2"]
    corrected = c("analysis") == "hartung_knapp"
    pools = pooling.random_effects(tagged.where(~corrected), by, method).select(*kept)
    pools = pools.unionByName(pooling.random_effects(tagged.where(corrected), by, method, hartung_knapp=True).select(*kept))
    names = df.groupBy(*keys).agg(F.collect_set("metric").alias("metrics"))
    named = F.concat(F.array(*map(F.lit, ANALYSES)), F.transform("metrics", lambda m: F.concat(F.lit(BY_METRIC), m)))
    listed = names.select(*keys, F.explode(named).alias("analysis"))
    out = listed.join(counts, by, "left").join(pools, by, "left")
    primary = pools.where("analysis = 'primary'").select(*keys, c("estimate").alias("main"))
    out = out.join(primary, keys, "left").withColumn("delta", c("estimate") - c("main"))
    empty = c("analysis") == "dependency"
    count = lambda name: F.when(~empty, F.coalesce(name, F.lit(0))).alias(name)
    return out.select(*by, count("k"), count("clusters"), "estimate", "se", "ci_low", "ci_high", "tau2", "delta")
