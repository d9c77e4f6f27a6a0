"""Published vectors and invariants of the pools."""

from __future__ import annotations

import random

import pytest

from poolwright.operators import pooling

#: the published cluster-robust fit: y, v, cluster
CLUSTERED = [
    (0.10, 0.04, "A"), (0.30, 0.05, "A"), (0.50, 0.06, "A"), (0.20, 0.08, "B"), (0.40, 0.10, "B"), (0.60, 0.05, "C"), (-0.10, 0.07, "D"), (0.15, 0.03, "D"), (0.45, 0.09, "E"),
]
#: two rows and their REML pool: y, se
PAIR = [(-1.6587405191948008, 0.4787472630672294), (0.11174628535906206, 0.3206248981749338)]


def _frame(spark, rows, names="y double, v double, cluster string"):
    return spark.createDataFrame([("g", *r) for r in rows], "grp string, " + names)


def test_cluster_robust_vector(spark):
    r = pooling.cluster_robust(_frame(spark, CLUSTERED), ["grp"], "cluster").first()
    want = {
        "estimate": 0.327006697455228, "se": 0.113902213196822, "t": 2.87094243629984, "df": 3.72857069735625, "p": 0.0493825783827924,
        "ci_low": 0.00147395971467, "ci_high": 0.652539435195791, "tau2": 0.00606703066914499, "i2": 0.0878639265795739, "q": 4.46234984984985, "q_df": 4.07027027027027,
    }
    for name, value in want.items():
        assert r[name] == pytest.approx(value, abs=1e-8), name
    assert (r["m"], r["grp"]) == (5, "g") or r["m"] == 5
    assert r["small_sample"]


def test_reml_pair(spark):
    df = _frame(spark, [(y, se * se) for y, se in PAIR], "y double, v double")
    r = pooling.random_effects(df, ["grp"], "REML").first()
    assert r["estimate"] == pytest.approx(-0.7378011105314994, abs=1e-9)
    assert r["se"] == pytest.approx(0.8845234176678994, abs=1e-8)
    assert r["tau2"] == pytest.approx(1.4013121289376493, abs=1e-7)
    assert r["q"] == pytest.approx(9.441657963009746, abs=1e-10)


def test_order_does_not_matter(spark):
    rows = [(y, v) for y, v, _ in CLUSTERED]
    seen = set()
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        df = _frame(spark, rows, "y double, v double").repartition(seed + 1)
        r = pooling.random_effects(df, ["grp"], "REML").first()
        seen.add((round(r["estimate"], 12), round(r["tau2"], 12)))
    assert len(seen) == 1


def test_small_and_odd_groups(spark):
    rows = [("one", 0.1, 0.2), ("two", 0.1, 0.2), ("two", 0.1, 0.2), ("bad", 0.1, 0.0), ("bad", None, 0.1), ("bad", 0.2, float("inf"))]
    df = pooling.poolable(spark.createDataFrame(rows, "k2 string, y double, v double"))
    assert df.where("k2 = 'bad'").count() == 0
    out = {r["k2"]: r for r in pooling.random_effects(df, ["k2"], "REML", hartung_knapp=True).collect()}
    assert set(out) == {"two"}  # no pool of one row
    assert out["two"]["hk_fallback"] and out["two"]["se"] == pytest.approx((0.2 / 2) ** 0.5)
    assert out["two"]["pi_low_hts"] is None


def test_empty(spark):
    df = spark.createDataFrame([], "k2 string, y double, v double, cluster string")
    assert pooling.random_effects(df, ["k2"], "DL").count() == 0
    assert pooling.cluster_robust(df, ["k2"], "cluster").count() == 0
    assert pooling.leave_one_out(df, ["k2"], "cluster").count() == 0


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        pooling.random_effects(_frame(spark, CLUSTERED), ["grp"], "XX")
