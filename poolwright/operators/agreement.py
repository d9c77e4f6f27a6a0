"""Agreement of two readings of the same quantities, and ranking and calibration numerics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

c = F.col


def agreement(df: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """n, Lin's concordance (divisor n), MAE, RMSE, sign agreement and Bland-Altman limits of pairs.

    A zero has the sign of any other value. One pair has a bias and no limits.
    """
    pairs = df.where(c(x).isNotNull() & c(y).isNotNull()).withColumn("delta", c(x) - c(y))
    same = (F.signum(c(x)) == F.signum(c(y))) | (c(x) == 0) | (c(y) == 0)
    spread = F.var_pop(x) + F.var_pop(y) + (F.avg(x) - F.avg(y)) ** 2
    out = pairs.groupBy(*keys) if keys else pairs.groupBy()
    return out.agg(
        F.count("*").alias("n"),
        F.when(spread > 0, 2 * F.covar_pop(x, y) / spread).alias("ccc"),
        F.avg(F.abs("delta")).alias("mae"),
        F.sqrt(F.avg(c("delta") ** 2)).alias("rmse"),
        F.avg(same.cast("double")).alias("sign_agreement"),
        F.avg("delta").alias("bias"),
        F.when(F.count("*") > 1, F.stddev_samp("delta")).alias("sd"),
        F.when(F.count("*") > 1, F.avg("delta") - 1.96 * F.stddev_samp("delta")).alias("loa_low"),
        F.when(F.count("*") > 1, F.avg("delta") + 1.96 * F.stddev_samp("delta")).alias("loa_high"),
    )


def median_mad(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """Median and 1.4826 times the median absolute deviation: two passes, exact."""
    mid = df.groupBy(*keys).agg(F.median(x).alias("median"), F.count(x).alias("n"))
    return df.join(mid, keys).groupBy(*keys).agg(F.first("n").alias("n"), F.first("median").alias("median"), (1.4826 * F.median(F.abs(c(x) - c("median")))).alias("spread"))


def upper_median(values):
    """Column aggregate: the upper of the two middle values of an even count."""
    ordered = F.array_sort(F.collect_list(values))
    return F.get(ordered, F.floor(F.size(ordered) / 2).cast("int"))


def fit_axis(ticks: DataFrame, key: str, px: str = "px", value: str = "value", order: str = "tick") -> DataFrame:
    """Least-squares axis value = a * px + b; with four ticks or more the worst one is left out if its
    residual is over three times the median residual and a quarter pixel; RMSE in pixels."""
    from pyspark.sql.window import Window

    own = Window.partitionBy(key)

    def fit(rows: DataFrame) -> DataFrame:
        return rows.groupBy(key).agg(F.regr_slope(value, px).alias("a"), F.regr_intercept(value, px).alias("b"), F.count("*").alias("n"))

    rows = ticks.select(key, px, value, order)
    first = rows.join(fit(rows), key).withColumn("residual", F.abs((c(value) - c("a") * c(px) - c("b")) / c("a")))
    mid = first.groupBy(key).agg(F.median("residual").alias("middle"))
    ranked = first.join(mid, key).withColumn("rank", F.row_number().over(own.orderBy(F.desc("residual"), order)))
    out = (c("n") >= 4) & (c("rank") == 1) & (c("residual") > F.greatest(3 * c("middle"), F.lit(0.25)))
    kept = ranked.where(~F.coalesce(out, F.lit(False))).select(key, px, value, order)
    last = kept.join(fit(kept), key).withColumn("residual", (c(value) - c("a") * c(px) - c("b")) / c("a"))
    return last.groupBy(key).agg(
        F.first("a").alias("a"), F.first("b").alias("b"), F.first("n").alias("used"), F.sqrt(F.avg(c("residual") ** 2)).alias("rmse_px")
    )


def theil_sen(df: DataFrame, key: str, x: str, y: str, order: str) -> DataFrame:
    """Median of the slopes of all pairs of a small group (ticks of one axis), and the median intercept."""
    left = df.select(key, c(x).alias("x1"), c(y).alias("y1"), c(order).alias("o1"))
    right = df.select(key, c(x).alias("x2"), c(y).alias("y2"), c(order).alias("o2"))
    slopes = left.join(right, key).where("o1 < o2 and x1 <> x2").groupBy(key).agg(F.median((c("y2") - c("y1")) / (c("x2") - c("x1"))).alias("slope"))
    return df.join(slopes, key).groupBy(key).agg(F.first("slope").alias("slope"), F.median(c(y) - c("slope") * c(x)).alias("intercept"))


def monotone_runs(df: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Longest strictly rising stretch of each key: its length and first place (gaps and islands)."""
    from pyspark.sql.window import Window

    line = Window.partitionBy(key).orderBy(order)
    rows = df.withColumn("breaks", (~F.coalesce(c(value) > F.lag(value).over(line), F.lit(False))).cast("int"))
    rows = rows.withColumn("run", F.sum("breaks").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    runs = rows.groupBy(key, "run").agg(F.count("*").alias("length"), F.min(order).alias("start"))
    best = runs.groupBy(key).agg(F.max(F.struct("length", (-c("start")).alias("back"))).alias("best"))
    return best.select(key, c("best.length").alias("length"), (-c("best.back")).alias("start"))
