"""Pooling of effect sizes by group.

Closed forms are grouped sums. Only the between-study variance of the iterative methods and the
profile interval go through a grouped map, which gets the two columns of one group: a group is one
outcome's studies in one scenario, thousands at most. Everything after the variance is sums again.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poolwright.functions import special
from poolwright.functions.special import Z95

c = F.col


def poolable(df: DataFrame, y: str = "y", v: str = "v", finite: bool = True) -> DataFrame:
    """Rows with an effect and a positive variance; `finite` also refuses an infinite one."""
    good = c(y).isNotNull() & ~F.isnan(y) & c(v).isNotNull() & ~F.isnan(v) & (c(v) > 0)
    return df.where(good & (c(v) < float("inf")) & (F.abs(y) < float("inf"))) if finite else df.where(good)


def weighted(df: DataFrame, keys: list[str], w: Column) -> DataFrame:
    """k, sums of weights, weighted mean and weighted squares about it, for each group."""
    rows = df.select(*keys, "y", "v", w.alias("w"))
    first = rows.groupBy(*keys).agg(
        F.count("*").alias("k"), F.sum("w").alias("sw"), F.sum(c("w") * c("y")).alias("swy"), F.sum(c("w") * c("w")).alias("sw2")
    ).withColumn("mu", c("swy") / c("sw"))
    back = rows.join(first.select(*keys, "mu"), keys)
    second = back.groupBy(*keys).agg(F.sum(c("w") * (c("y") - c("mu")) ** 2).alias("ssw"))
    return first.join(second, keys).where("k >= 2")


def fixed_effects(df: DataFrame, keys: list[str]) -> DataFrame:
    """Inverse-variance estimate, se, z interval, z, p, Q, its df and p."""
    s = weighted(df, keys, 1 / c("v"))
    out = s.select(*keys, "k", c("mu").alias("estimate"), F.sqrt(1 / c("sw")).alias("se"), c("ssw").alias("q"), (c("k") - 1).alias("q_df"))
    out = out.withColumn("ci_low", c("estimate") - Z95 * c("se")).withColumn("ci_high", c("estimate") + Z95 * c("se"))
    out = out.withColumn("z", c("estimate") / c("se"))
    return out.withColumn("p", special.normal_p_value(c("z"))).withColumn("q_p", special.chi2_p_value(c("q"), c("q_df")))


def q_generalised(df: DataFrame, keys: list[str], tau2: Column) -> DataFrame:
    return weighted(df, keys, 1 / (c("v") + tau2)).select(*keys, c("ssw").alias("q_gen"))


def tau2_dl(df: DataFrame, keys: list[str]) -> DataFrame:
    s = weighted(df, keys, 1 / c("v"))
    return s.select(*keys, F.greatest(F.lit(0.0), (c("ssw") - (c("k") - 1)) / (c("sw") - c("sw2") / c("sw"))).alias("tau2"))


# ---- one group's iterations --------------------------------------------------------------------
def _q(y: np.ndarray, v: np.ndarray, tau2: float) -> float:
    w = 1 / (v + tau2)
    return float((w * (y - (w * y).sum() / w.sum()) ** 2).sum())


def _dl(y: np.ndarray, v: np.ndarray) -> float:
    w = 1 / v
    return max(0.0, (_q(y, v, 0.0) - (len(y) - 1)) / (w.sum() - (w**2).sum() / w.sum()))


def scoring(y: np.ndarray, v: np.ndarray, ml: bool, tolerance: float = 1e-8, most: int = 200) -> tuple[float, float | None, int, bool]:
    """Fisher scoring for REML or ML from the DL value: tau2, its se, rounds, settled."""
    tau2, settled, rounds = _dl(y, v), False, 0

    def traces(t: float):
        w = 1 / (v + t)
        s1, s2, s3 = w.sum(), (w**2).sum(), (w**3).sum()
        return w, s1, s2, s2 - 2 * s3 / s1 + s2 * s2 / s1**2

    while rounds < most and not settled:
        rounds += 1
        w, s1, s2, trace2 = traces(tau2)
        squares = (w**2 * (y - (w * y).sum() / s1) ** 2).sum()
        step = (squares - s1) / s2 if ml else (squares - (s1 - s2 / s1)) / trace2
        while tau2 + step < 0:
            step /= 2
        tau2, settled = tau2 + step, abs(step) < tolerance
    trace2 = traces(tau2)[3]
    return float(tau2), math.sqrt(2 / trace2) if trace2 > 0 else None, rounds, bool(settled)


def _falling_root(y: np.ndarray, v: np.ndarray, target: float, high: float) -> float:
    low = 0.0
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if _q(y, v, mid) > target else (low, mid)
    return (low + high) / 2


def paule_mandel(y: np.ndarray, v: np.ndarray) -> float:
    k = len(y)
    if _q(y, v, 0.0) <= k - 1:
        return 0.0
    high = 1.0
    while _q(y, v, high) > k - 1 and high <= 1e12:
        high *= 4
    return _falling_root(y, v, k - 1, high)


def q_profile(y: np.ndarray, v: np.ndarray, level: float = 0.95, upper: float = 1e5) -> tuple[float, float]:
    tail = (1 - level) / 2
    many, few = special.chi2_ppf(1 - tail, len(y) - 1), special.chi2_ppf(tail, len(y) - 1)
    at_zero = _q(y, v, 0.0)
    low = 0.0 if at_zero <= many else _falling_root(y, v, many, upper)
    if at_zero <= few:
        return low, 0.0
    return low, math.inf if _q(y, v, upper) > few else _falling_root(y, v, few, upper)


_TAU2_FIELDS = "tau2 double, se_tau2 double, iterations int, converged boolean, tau2_low double, tau2_high double"


def tau2_iterated(df: DataFrame, keys: list[str], method: str, interval: bool = False) -> DataFrame:
    """tau2 by REML, ML or PM for each group of two or more; its Q-profile interval on request."""
    if method not in ("REML", "ML", "PM"):
        raise ValueError(f"unknown method {method!r}")
    kinds = dict(df.select(*keys).dtypes)

    def one(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(["y", "v"], kind="stable")  # sums do not depend on the shuffle
        y, v = ordered["y"].to_numpy(float), ordered["v"].to_numpy(float)
        if len(y) < 2:
            return pd.DataFrame(columns=[*keys, "tau2", "se_tau2", "iterations", "converged", "tau2_low", "tau2_high"])
        found = (paule_mandel(y, v), None, 0, True) if method == "PM" else scoring(y, v, method == "ML")
        bounds = q_profile(y, v) if interval else (None, None)
        return pd.DataFrame([(*key, *found, *bounds)], columns=[*keys, "tau2", "se_tau2", "iterations", "converged", "tau2_low", "tau2_high"])

    schema = ", ".join([f"{k} {kinds[k]}" for k in keys] + [_TAU2_FIELDS])
    return df.select(*keys, "y", "v").groupBy(*keys).applyInPandas(one, schema)


# ---- random effects ----------------------------------------------------------------------------
def random_effects(df: DataFrame, keys: list[str], method: str = "REML", hartung_knapp: bool = False, interval: bool = False) -> DataFrame:
    """Random-effects pool of each group with two or more rows.

    method: DL, REML, ML, PM or FE. I² is Q-based; i2_tau and h2 use the typical variance. Under
    Hartung-Knapp a zero se falls back to the ordinary one (hk_fallback). Prediction intervals:
    hts on t(k - 2) from k = 3, v on t(k - 1), z.
    """
    if method == "DL":
        tau = tau2_dl(df, keys)
    elif method == "FE":
        tau = df.select(*keys).distinct().withColumn("tau2", F.lit(0.0))
    else:
        tau = tau2_iterated(df, keys, method, interval)
    fixed = weighted(df, keys, 1 / c("v")).select(*keys, c("sw").alias("f1"), c("sw2").alias("f2"), c("ssw").alias("q"))
    pooled = weighted(df.join(tau.select(*keys, "tau2"), keys), keys, 1 / (c("v") + c("tau2")))
    out = pooled.join(fixed, keys).join(tau, keys)
    typical = (c("k") - 1) * c("f1") / (c("f1") ** 2 - c("f2"))
    plain = F.sqrt(1 / c("sw"))
    out = out.withColumn("estimate", c("mu")).withColumn("q_df", c("k") - 1).withColumn("typical", typical)
    if hartung_knapp:
        out = out.withColumn("hk", F.sqrt(c("ssw") / ((c("k") - 1) * c("sw")))).withColumn("hk_fallback", F.isnan("hk") | (c("hk") == 0))
        out = out.withColumn("se", F.when(c("hk_fallback"), plain).otherwise(c("hk")))
        out = out.withColumn("quantile", F.when(c("hk_fallback"), F.lit(Z95)).otherwise(special.t_quantile(0.975, c("q_df"))))
        p = F.when(c("hk_fallback"), special.normal_p_value(c("estimate") / c("se"))).otherwise(special.t_p_value(c("estimate") / c("se"), c("q_df")))
    else:
        out = out.withColumn("hk_fallback", F.lit(False)).withColumn("se", plain).withColumn("quantile", F.lit(Z95))
        p = special.normal_p_value(c("estimate") / c("se"))
    out = out.withColumn("p", p).withColumn("z", c("estimate") / c("se")).withColumn("spread", F.sqrt(c("se") ** 2 + c("tau2")))
    out = out.withColumn("q_p", special.chi2_p_value(c("q"), c("q_df")))
    t_hts = F.when(c("k") >= 3, special.t_quantile(0.975, c("k") - 2))
    out = out.withColumn("t_hts", t_hts).withColumn("t_v", special.t_quantile(0.975, c("k") - 1))
    extra = [x for x in ("se_tau2", "iterations", "converged", "tau2_low", "tau2_high") if x in out.columns]
    return out.select(
        *keys,
        "k",
        "estimate",
        "se",
        (c("estimate") - c("quantile") * c("se")).alias("ci_low"),
        (c("estimate") + c("quantile") * c("se")).alias("ci_high"),
        "z",
        "p",
        "tau2",
        F.sqrt("tau2").alias("tau"),
        "q",
        "q_df",
        "q_p",
        F.when(c("q") > 0, F.greatest(F.lit(0.0), (c("q") - c("q_df")) / c("q"))).otherwise(0.0).alias("i2"),
        F.when(c("tau2") + c("typical") > 0, c("tau2") / (c("tau2") + c("typical"))).otherwise(0.0).alias("i2_tau"),
        F.when(c("typical") > 0, (c("tau2") + c("typical")) / c("typical")).alias("h2"),
        (c("estimate") - c("t_hts") * c("spread")).alias("pi_low_hts"),
        (c("estimate") + c("t_hts") * c("spread")).alias("pi_high_hts"),
        (c("estimate") - c("t_v") * c("spread")).alias("pi_low_v"),
        (c("estimate") + c("t_v") * c("spread")).alias("pi_high_v"),
        (c("estimate") - Z95 * c("spread")).alias("pi_low_z"),
        (c("estimate") + Z95 * c("spread")).alias("pi_high_z"),
        "hk_fallback",
        *extra,
    )


def weights(df: DataFrame, keys: list[str], tau: DataFrame) -> DataFrame:
    """Rows with their share of the random-effects weight in percent."""
    rows = df.join(tau.select(*keys, "tau2"), keys).withColumn("w", 1 / (c("v") + c("tau2")))
    total = rows.groupBy(*keys).agg(F.sum("w").alias("total"))
    return rows.join(total, keys).withColumn("weight_pct", 100 * c("w") / c("total")).drop("w", "total")


def cluster_robust(df: DataFrame, keys: list[str], cluster: str, rho: float = 0.8) -> DataFrame:
    """Correlated-effects pool with CR2 standard error and Satterthwaite df, two clusters at least.

    Two levels of sums: rows to clusters, clusters to groups. A cluster label that is null or empty
    is the caller's to fill (see aggregate.cluster_label).
    """
    rows = df.select(*keys, c(cluster).alias("cluster"), "y", "v")
    per = rows.groupBy(*keys, "cluster").agg(
        F.count("*").alias("kj"), F.avg("v").alias("vbar"), F.avg("y").alias("ybar"), F.sum("y").alias("sy"), F.sum(c("y") ** 2).alias("syy")
    )
    first = per.groupBy(*keys).agg(
        F.count("*").alias("m"),
        F.sum("kj").alias("k"),
        F.sum(1 / c("vbar")).alias("sum_w"),
        F.sum(1 / c("vbar") ** 2).alias("sum_w2"),
        F.sum(c("ybar") / c("vbar")).alias("sum_wy"),
        F.sum(1 / (c("kj") * c("vbar"))).alias("sum_a"),
        F.sum((c("kj") - 1) / (c("kj") * c("vbar"))).alias("sum_b"),
    ).where("m >= 2")
    first = first.withColumn("mu0", c("sum_wy") / c("sum_w"))
    back = rows.join(per.select(*keys, "cluster", "kj", "vbar"), [*keys, "cluster"]).join(first.select(*keys, "mu0"), keys)
    qe = back.groupBy(*keys).agg(F.sum((c("y") - c("mu0")) ** 2 / (c("kj") * c("vbar"))).alias("q"))
    s = first.join(qe, keys)
    d = c("sum_w") - c("sum_w2") / c("sum_w")
    a, b = c("sum_a") / c("sum_w"), c("sum_b") / c("sum_w")
    s = s.withColumn("tau2", F.greatest(F.lit(0.0), (c("q") - c("m") + a) / d + rho * b / d)).withColumn("q_df", c("m") - a - rho * b)
    w = per.join(s.select(*keys, "tau2"), keys).withColumn("w", 1 / (c("vbar") + c("tau2")))
    fit = w.groupBy(*keys).agg(F.sum("w").alias("s"), (F.sum(c("w") * c("ybar")) / F.sum("w")).alias("estimate"))
    lev = w.join(fit, keys).withColumn("h", c("w") / c("s")).withColumn("g", c("h") ** 2 / (1 - c("h")))
    last = lev.groupBy(*keys).agg(
        F.sqrt(F.sum(c("w") ** 2 * (c("ybar") - c("estimate")) ** 2 / (1 - c("h"))) / F.first("s") ** 2).alias("se"),
        (1 / (F.sum(c("h") ** 2) + F.sum("g") ** 2 - F.sum(c("g") ** 2))).alias("df"),
        (F.min(1 - c("h")) < 1e-8).alias("unstable"),
    )
    out = s.join(fit, keys).join(last, keys)
    out = out.withColumn("t", c("estimate") / c("se")).withColumn("p", special.t_p_value(c("t"), c("df")))
    out = out.withColumn("tq", special.t_quantile(0.975, c("df")))
    return out.select(
        *keys, "k", "m", "estimate", "se", "df", "t", "p",
        (c("estimate") - c("tq") * c("se")).alias("ci_low"), (c("estimate") + c("tq") * c("se")).alias("ci_high"),
        "tau2", "q", "q_df",
        F.when(c("q") > 0, F.greatest(F.lit(0.0), (c("q") - c("q_df")) / c("q"))).otherwise(0.0).alias("i2"),
        F.sqrt(1 / c("s")).alias("se_model"), (c("df") < 4).alias("small_sample"), "unstable",
    )


def egger_classic(df: DataFrame, keys: list[str]) -> DataFrame:
    """Least squares of y / se on 1 / se; the intercept is the bias. Three rows at least."""
    rows = df.withColumn("s", F.sqrt("v")).withColumn("u", c("y") / c("s")).withColumn("x", 1 / c("s"))
    g = rows.groupBy(*keys).agg(
        F.count("*").alias("k"), F.regr_slope("u", "x").alias("slope"), F.regr_intercept("u", "x").alias("intercept"),
        F.regr_sxx("u", "x").alias("sxx"), F.regr_syy("u", "x").alias("syy"), F.regr_sxy("u", "x").alias("sxy"), F.avg("x").alias("mx"),
    ).where("k >= 3")
    sigma2 = (c("syy") - c("slope") * c("sxy")) / (c("k") - 2)
    g = g.withColumn("intercept_se", F.sqrt(sigma2 * (1 / c("k") + c("mx") ** 2 / c("sxx")))).withColumn("df", c("k") - 2)
    g = g.withColumn("t", c("intercept") / c("intercept_se")).withColumn("p", special.t_p_value(c("t"), c("df")))
    return g.select(*keys, "k", "intercept", "intercept_se", "slope", "t", "df", "p")


def egger_sample_size(df: DataFrame, keys: list[str], n_a: str = "n_a", n_b: str = "n_b") -> DataFrame:
    """Weighted least squares of y on sqrt(1/n_a + 1/n_b), weights 1/v; the slope is the bias."""
    rows = df.withColumn("x", F.sqrt(1 / c(n_a) + 1 / c(n_b))).withColumn("w", 1 / c("v"))
    mean = rows.groupBy(*keys).agg(
        F.count("*").alias("k"), F.sum("w").alias("sw"), (F.sum(c("w") * c("x")) / F.sum("w")).alias("mx"), (F.sum(c("w") * c("y")) / F.sum("w")).alias("my")
    ).where("k >= 3")
    back = rows.join(mean, keys)
    s = back.groupBy(*keys).agg(
        F.first("k").alias("k"), F.first("sw").alias("sw"), F.first("mx").alias("mx"), F.first("my").alias("my"),
        F.sum(c("w") * (c("x") - c("mx")) ** 2).alias("sxx"), F.sum(c("w") * (c("x") - c("mx")) * (c("y") - c("my"))).alias("sxy"),
        F.sum(c("w") * (c("y") - c("my")) ** 2).alias("syy"),
    )
    s = s.withColumn("slope", c("sxy") / c("sxx")).withColumn("estimate", c("my") - c("slope") * c("mx")).withColumn("df", c("k") - 2)
    s = s.withColumn("sigma2", (c("syy") - c("slope") * c("sxy")) / c("df")).withColumn("slope_se", F.sqrt(c("sigma2") / c("sxx")))
    s = s.withColumn("t", c("slope") / c("slope_se")).withColumn("p", special.t_p_value(c("t"), c("df")))
    return s.select(*keys, "k", "estimate", F.sqrt(c("sigma2") * (1 / c("sw") + c("mx") ** 2 / c("sxx"))).alias("estimate_se"), "slope", "slope_se", "t", "df", "p")


def leave_one_out(df: DataFrame, keys: list[str], unit: str, method: str = "DL") -> DataFrame:
    """The pool without each unit in turn; groups with three units at least.

    Every unit's scenario holds the other rows of its group: k scenarios of k rows, all pooled by one
    grouped operator. A group is one outcome's studies.
    """
    units = df.select(*keys, c(unit).alias("omitted")).distinct()
    many = units.groupBy(*keys).agg(F.count("*").alias("n")).where("n >= 3").select(*keys)
    scenarios = units.join(many, keys).join(df, keys).where(c("omitted") != c(unit))
    return random_effects(scenarios, [*keys, "omitted"], method)


def funnel_contours(pools: DataFrame, df: DataFrame, keys: list[str], levels: dict[str, float], points: int = 50) -> DataFrame:
    """Low and high limits around the pooled estimate on an even grid of standard errors from 0 to the largest."""
    top = df.groupBy(*keys).agg(F.max(F.sqrt("v")).alias("se_max"))
    grid = pools.select(*keys, "estimate").join(top, keys).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    level = F.explode(F.array(*[F.struct(F.lit(k).alias("level"), F.lit(q).alias("q")) for k, q in levels.items()]))
    grid = grid.withColumn("l", level).withColumn("se", c("se_max") * c("i") / (points - 1))
    return grid.select(
        *keys, "i", c("l.level").alias("level"), "se", (c("estimate") - c("l.q") * c("se")).alias("low"), (c("estimate") + c("l.q") * c("se")).alias("high")
    )
