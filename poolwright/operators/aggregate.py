"""Grouping operators: composite rows, shared arms, scenario sets, flow counts, cost and route rollups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolwright.functions import effects as e

c = F.col


def filled(*columns: Column) -> Column:
    """The first that is neither null nor empty."""
    return F.coalesce(*[F.nullif(x, F.lit("")) for x in columns])


def cluster_label(cluster: Column, paper: Column, dataset: Column) -> Column:
    return filled(cluster, paper, dataset)


def common_value(x: Column, default: Column) -> Column:
    """The one value of a group, null counting as a value, else the default."""
    one = (F.count_distinct(x) + F.max(x.isNull().cast("int"))) == 1
    return F.when(one, F.max(x)).otherwise(default)


def composite_variance(v: Column, r: Column | float) -> Column:
    """Variance of the plain mean of a group of equally correlated estimates."""
    total, root = F.sum(v), F.sum(F.sqrt(v))
    return (total + r * (root * root - total)) / (F.count(v) ** 2)


def worst(ordinal: Column) -> Column:
    """The worst confidence of a group: the highest place in the order from best to worst."""
    return F.max(ordinal)


def one_row_per_cluster(df: DataFrame, keys: list[str], cluster: str, r: float = 0.5, sample: str | None = None) -> DataFrame:
    """A composite of each cluster's poolable rows: mean, variance, members, n.

    Rows are dependent (variance with correlation r, n the largest) unless every row names a sample
    of its own (r = 0, n the sum). A cluster of one row stays as it is.
    """
    n = c("n_a") + c("n_b")
    aggregates = [
        F.count("*").alias("members"),
        F.avg("y").alias("y"),
        composite_variance(c("v"), r).alias("dependent_v"),
        composite_variance(c("v"), 0.0).alias("independent_v"),
        F.sum(n).alias("sum_n"),
        F.max(n).alias("max_n"),
    ]
    if sample:
        own = F.nullif(c(sample), F.lit(""))
        aggregates.append(((F.count_distinct(own) == F.count("*")) & (F.count(own) == F.count("*"))).alias("independent"))
    out = df.groupBy(*keys, cluster).agg(*aggregates)
    if not sample:
        out = out.withColumn("independent", F.lit(False))
    return out.select(
        *keys,
        cluster,
        "members",
        "independent",
        "y",
        F.when(c("independent"), c("independent_v")).otherwise(c("dependent_v")).alias("v"),
        F.when(c("independent"), c("sum_n")).otherwise(c("max_n")).alias("n"),
    )


def shared_control(df: DataFrame, group: list[str], order: str, strategy: str) -> DataFrame:
    """Rows of a group that share arm B: split_n, combine_arms, keep_first or keep_all_flagged.

    split_n divides the shared n by the rows, half to even; combine_arms merges the A arms into one
    by exact sums; the order column makes `first` definite.
    """
    own = Window.partitionBy(*group)
    rows = df.withColumn("sharing", F.count("*").over(own))
    if strategy == "split_n":
        return rows.withColumn("n_b", F.when(c("sharing") > 1, F.bround(c("n_b") / c("sharing")).cast("long")).otherwise(c("n_b")))
    if strategy == "keep_first":
        first = F.row_number().over(own.orderBy(order))
        return rows.withColumn("turn", first).where("turn = 1").drop("turn")
    if strategy == "keep_all_flagged":
        return rows.withColumn("flagged", c("sharing") > 1)
    if strategy != "combine_arms":
        raise ValueError(f"unknown strategy {strategy!r}")
    total = df.groupBy(*group).agg(
        F.min(order).alias(order),
        F.count("*").alias("sharing"),
        F.sum("n_a").alias("n"),
        (F.sum(c("n_a") * c("m_a")) / F.sum("n_a")).alias("m"),
        F.sum((c("n_a") - 1) * c("sd_a") ** 2).alias("within"),
        F.min_by("n_b", order).alias("n_b"),
        F.min_by("m_b", order).alias("m_b"),
        F.min_by("sd_b", order).alias("sd_b"),
    )
    about = df.join(total.select(*group, "m"), group).groupBy(*group).agg(F.sum(c("n_a") * (c("m_a") - c("m")) ** 2).alias("between"))
    out = total.join(about, group)
    return out.select(
        *group, order, "sharing", c("n").alias("n_a"), c("m").alias("m_a"), F.sqrt((c("within") + c("between")) / (c("n") - 1)).alias("sd_a"), "n_b", "m_b", "sd_b"
    )


def scenarios(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """Each row once for every scenario whose condition it meets: one pass for all analyses."""
    tags = F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in conditions.items()]))
    return df.withColumn("scenario", F.explode(tags))


def split_rows(df: DataFrame, confidence: str, includes: list[str], es: str = "y", var: str = "v") -> DataFrame:
    """`line`: primary where the confidence is included and the row can be pooled, else held."""
    ok = c(confidence).isin(includes) & c(es).isNotNull() & ~F.isnan(es) & (F.coalesce(c(var), F.lit(0.0)) != 0)
    return df.withColumn("line", F.when(F.coalesce(ok, F.lit(False)), "primary").otherwise("held"))


def route_group(route: Column) -> Column:
    """Bucket of a route for reports."""
    return (
        F.when(route.startswith("figure") | route.startswith("digitize"), "figure")
        .when(route.isin("test_statistic", "p_value", "reported_d"), "statistic")
        .when(route == "table", "table")
        .when(route.startswith("text"), "text")
        .otherwise("other")
    )


def route_counts(df: DataFrame, route: str) -> DataFrame:
    """Rows, share in percent and routes of each bucket."""
    g = df.withColumn("bucket", route_group(c(route))).groupBy("bucket").agg(F.count("*").alias("n"), F.array_sort(F.collect_set(route)).alias("routes"))
    share = 100 * c("n") / F.sum("n").over(Window.partitionBy())  # five buckets at most
    return g.select("bucket", "n", share.alias("pct"), F.array_join("routes", "|").alias("routes"))


def flow_counts(df: DataFrame, steps: dict[str, Column]) -> DataFrame:
    """One row: how many rows each step removes, in order, and how many are left; the first reason counts."""
    reason = F.lit(None).cast("string")
    for name, cond in reversed(steps.items()):
        reason = F.when(F.coalesce(cond, F.lit(False)), F.lit(name)).otherwise(reason)
    tagged = df.select(reason.alias("reason"))
    counts = [F.count_if(c("reason") == name).alias(f"removed_{name}") for name in steps]
    out = tagged.agg(F.count("*").alias("found"), *counts, F.count_if(c("reason").isNull()).alias("included"))
    removed = sum((c(f"removed_{name}") for name in steps), F.lit(0))
    return out.withColumn("adds_up", c("found") - removed == c("included"))


def reason_histogram(df: DataFrame, reason: str, aliases: DataFrame) -> DataFrame:
    """Reasons by their head before a colon, through an alias table (alias, reason); unknown ones are `other`."""
    head = F.trim(F.substring_index(F.lower(c(reason)), ":", 1))
    known = F.broadcast(aliases.select(c("alias").alias("head"), c("reason").alias("name")))  # closed vocabulary
    return df.select(head.alias("head")).join(known, "head", "left").groupBy(F.coalesce("name", F.lit("other")).alias("reason")).agg(F.count("*").alias("n"))


def cost_rollup(calls: DataFrame, prices: DataFrame) -> DataFrame:
    """Cost by stage from token counts: input, output, and cached input at 1.25 (write) and 0.1 (read).

    prices (model, per_in, per_out) is a closed vocabulary. Replayed calls cost nothing.
    """
    m = calls.join(F.broadcast(prices), "model", "left")
    cost = (c("n_in") + 1.25 * c("n_cache_write") + 0.1 * c("n_cache_read")) * c("per_in") + c("n_out") * c("per_out")
    cost = F.when(c("replayed"), 0.0).otherwise(cost / 1e6)
    live = lambda x: F.sum(F.when(~c("replayed"), c(x)).otherwise(0))
    seen = live("n_in") + live("n_cache_read") + live("n_cache_write")
    return m.groupBy("stage").agg(
        F.count("*").alias("calls"),
        F.sum("n_in").alias("tokens_in"),
        F.sum("n_out").alias("tokens_out"),
        F.sum(cost).alias("cost"),
        F.when(seen > 0, live("n_cache_read") / seen).otherwise(0.0).alias("cache_share"),
        F.sum(F.when(~c("replayed"), 0.9 * c("n_cache_read") * c("per_in") / 1e6).otherwise(0.0)).alias("saved"),
    )


def running_budget(calls: DataFrame, key: str, order: str, cost: str, cap: float) -> DataFrame:
    """Spent before each call of a key, and whether the call is still allowed: the guard looks before it pays."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spent = F.coalesce(F.sum(cost).over(before), F.lit(0.0))
    return calls.withColumn("spent_before", spent).withColumn("allowed", c("spent_before") < cap)


def combined_arm(df: DataFrame, keys: list[str]) -> DataFrame:
    """Mean, SD and n of all arms of a group taken as one (n, m, sd columns)."""
    total = df.groupBy(*keys).agg(F.sum("n").alias("n_all"), (F.sum(c("n") * c("m")) / F.sum("n")).alias("m_all"), F.sum((c("n") - 1) * c("sd") ** 2).alias("within"))
    about = df.join(total.select(*keys, "m_all"), keys).groupBy(*keys).agg(F.sum(c("n") * (c("m") - c("m_all")) ** 2).alias("between"))
    return total.join(about, keys).select(*keys, "n_all", "m_all", F.sqrt((c("within") + c("between")) / (c("n_all") - 1)).alias("sd_all"))


def forest_layout(df: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Order by effect then label, position from the top, and the axis limits of the group."""
    own = Window.partitionBy(*keys)
    low, high = c("y") - e.Z95 * F.sqrt("v"), c("y") + e.Z95 * F.sqrt("v")
    rows = df.withColumn("low", low).withColumn("high", high)
    return rows.select(
        *keys,
        label,
        F.row_number().over(own.orderBy("y", label)).alias("position"),
        F.greatest(F.lit(1.0), F.ceil(2 * F.max(F.greatest(F.abs("low"), F.abs("high"))).over(own)) / 2).alias("limit"),
    )
