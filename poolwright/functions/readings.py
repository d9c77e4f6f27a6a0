"""Small rules on readings, routes and review entries, as columns and frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolwright.functions.text import model_family

c = F.col


def digitizer_path(extractor: Column) -> Column:
    """`digitize:readout:…` is figure:readout; without a second part it is figure."""
    part = F.get(F.split(F.coalesce(extractor, F.lit("")), ":"), F.lit(1))
    return F.when(F.coalesce(part, F.lit("")) != "", F.concat(F.lit("figure:"), part)).otherwise("figure")


def modality(extractor: Column, source_kind: Column, kind: Column, figure_kinds: tuple[str, ...] = ("figure",)) -> Column:
    """How a value was obtained: a digitizer's path, a figure, a statistic, a table, or the text."""
    return (
        F.when(F.startswith(F.coalesce(extractor, F.lit("")), F.lit("digitize:")), digitizer_path(extractor))
        .when(source_kind.isin(*figure_kinds), "figure")
        .when(kind.isin("test_statistic", "reported_d"), "statistic")
        .when(source_kind == "table", "table")
        .otherwise("text")
    )


def route_key(route: Column, model: Column) -> Column:
    """Who is voting: one modality and one model family."""
    return F.concat(route, F.lit("/"), model_family(model))


def usable(status: Column, kind: Column, mean: Column, dropped: Column) -> Column:
    """A reading that may vote."""
    return (status == "found") & (kind == "group_stats") & mean.isNotNull() & ~F.coalesce(dropped, F.lit(False))


def n_distance(n_a: Column, n_b: Column, gold_a: Column, gold_b: Column) -> Column:
    """How far two pairs of group sizes are apart; null if one is unknown."""
    return F.abs(n_a - gold_a) + F.abs(n_b - gold_b)


def interval_or_normal(low: Column, high: Column, effect: Column, se: Column) -> Column:
    """(low, high) as given, else the normal 95 % interval."""
    both = low.isNotNull() & high.isNotNull()
    return F.struct(F.when(both, low).otherwise(effect - 1.96 * se).alias("low"), F.when(both, high).otherwise(effect + 1.96 * se).alias("high"))


def crosses_zero(pool_low: Column, pool_high: Column, low: Column, high: Column) -> Column:
    """Whether leaving one row out moves the interval across zero, either way; false where it has none."""
    moved = ((pool_low <= 0) & (pool_high >= 0)) != ((low <= 0) & (high >= 0))
    return F.when(low.isNull() | high.isNull() | F.isnan(low) | F.isnan(high), F.lit(False)).otherwise(moved)


def measure_key(text: Column) -> Column:
    """A measure's name in snake case."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), F.lit("_"))


def term_tokens(term: Column) -> Column:
    return F.filter(F.split(F.lower(term), r"[\s-]+"), lambda w: w != "")


def first_mode(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """keys and the most frequent value that is neither null nor empty; of several the one seen first
    (of those seen at once the least value)."""
    counted = df.where(c(value).isNotNull() & (c(value).cast("string") != "")).groupBy(*keys, value).agg(F.count("*").alias("n"), F.min(order).alias("seen"))
    return counted.groupBy(*keys).agg(F.min_by(value, F.struct((-c("n")).alias("n"), "seen", value)).alias(value))


def fetch_order(df: DataFrame, state: str, route: str, order: list[str], most_unsure: int) -> DataFrame:
    """Rows to fetch with their turn: the wanted, then unsure ones with an open route up to a limit, then
    unread ones with an open route. The limit is the feature; the turn comes from ranks by state."""
    place = F.row_number().over(Window.partitionBy(state).orderBy(*order))
    open_route = F.coalesce(c(route), F.lit(False))
    rows = df.where((c(state) == "wanted") | c(state).isin("unsure", "unread") & open_route).withColumn("place", place)
    rows = rows.where((c(state) != "unsure") | (c("place") <= most_unsure))
    rank = F.when(c(state) == "wanted", 0).when(c(state) == "unsure", 1).otherwise(2)
    return rows.withColumn("stage", rank)

