from __future__ import annotations

import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from poolwright.functions import special


@pytest.mark.parametrize(("df", "q"), [(1, 12.7062), (5, 2.5706), (10, 2.2281), (30, 2.0423)])
def test_t_quantiles_of_the_tables(df, q):
    assert special.t_ppf(0.975, df) == pytest.approx(q, abs=5e-5)


@pytest.mark.parametrize(("df", "q"), [(1, 3.8415), (4, 9.4877), (10, 18.3070)])
def test_chi2_quantiles_of_the_tables(df, q):
    assert special.chi2_ppf(0.95, df) == pytest.approx(q, abs=5e-5)


@given(st.floats(0.001, 0.999), st.floats(1, 200))
def test_quantile_and_tail_undo_each_other(p, df):
    assert 1 - special.t_sf(special.t_ppf(p, df), df) == pytest.approx(p, abs=1e-9)
    assert 1 - special.chi2_sf(special.chi2_ppf(p, df), df) == pytest.approx(p, abs=1e-9)


def test_normal_limit():
    assert special.t_ppf(0.975, 1e7) == pytest.approx(special.Z95, abs=1e-6)
    assert special.normal_ppf(0.975) == pytest.approx(special.Z95, abs=1e-12)


def test_lgamma_column(spark):
    xs = [0.1, 0.5, 1.0, 2.0, 7.3, 40.0, 1234.5]
    rows = spark.createDataFrame([(x,) for x in xs], "x double").select("x", special.lgamma(F.col("x")).alias("y")).collect()
    for r in rows:
        assert r["y"] == pytest.approx(math.lgamma(r["x"]), abs=1e-10, rel=1e-12)


def test_column_functions_take_nulls(spark):
    df = spark.createDataFrame([(None, 5.0), (2.0, None), (2.0, -1.0), (2.0, 5.0)], "t double, df double")
    got = [r[0] for r in df.select(special.t_p_value(F.col("t"), F.col("df"))).collect()]
    assert got[:3] == [None, None, None] and got[3] == pytest.approx(0.1019394, abs=1e-6)
