"""Named analyses: which rows each has, and the rows that it cannot pool."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from poolwright.operators.sensitivity import ANALYSES, is_figure_route, is_statistic_route, named_analyses

SCHEMA = "outcome string, cluster string, y double, v double, n_a long, n_b long, route string, metric string, digitised double, held boolean, admitted boolean"
ROWS = [
    ("o", "a", 0.1, 0.04, 10, 10, "figure:bars", "smd", 0.06, False, False),
    ("o", "a", 0.3, 0.05, 10, 10, "table", "smd", None, False, False),
    ("o", "b", 0.5, 0.04, 10, 10, "p_value", "smd", None, None, None),
    ("o", "c", 0.9, 0.04, 10, 10, None, "ratio", None, True, True),
    ("o", "d", 1.5, 0.04, 10, 10, "text:x", "smd", None, True, False),
    ("o", "e", None, 0.04, 10, 10, "table", "smd", None, False, False),
    ("o", "f", 0.2, 0.0, 10, 10, "table", "smd", None, False, False),
    ("lone", "a", 0.2, 0.1, 10, 10, "table", "smd", None, False, False),
]


@pytest.fixture(scope="module")
def found(spark):
    return {(r["outcome"], r["analysis"]): r for r in named_analyses(spark.createDataFrame(ROWS, SCHEMA), ["outcome"]).collect()}


def test_rows_of_each_analysis(found):
    want = {name: 3 for name in ANALYSES} | {
        "exclude_figure_derived": 2, "exclude_test_statistic_derived": 2, "include_needs_human": 5, "best_guess": 4, "one_row_per_paper": 2, "dependency": None,
        "by_analysis_metric:smd": 3, "by_analysis_metric:ratio": 0,
    }
    assert {name: r["k"] for (outcome, name), r in found.items() if outcome == "o"} == want
    assert found["o", "primary"]["clusters"] == 2


def test_figures_by_hand(found):
    y, v = [0.1, 0.3, 0.5], [0.04, 0.05, 0.04]
    mu = sum(a / b for a, b in zip(y, v)) / sum(1 / b for b in v)  # Q is below its df: tau2 is 0
    main = found["o", "primary"]
    assert main["tau2"] == 0 and main["estimate"] == pytest.approx(mu) and main["delta"] == 0
    read = [0.10, 0.05, 0.04]
    assert found["o", "with_digitization_variance"]["estimate"] == pytest.approx(sum(a / b for a, b in zip(y, read)) / sum(1 / b for b in read))
    sw = sum(1 / b for b in v)
    hk = (sum((a - mu) ** 2 / b for a, b in zip(y, v)) / (2 * sw)) ** 0.5
    t = 4.302652729911275  # of 2 degrees of freedom
    assert found["o", "hartung_knapp"]["estimate"] == pytest.approx(mu) and found["o", "hartung_knapp"]["ci_low"] == pytest.approx(mu - t * hk)
    assert main["ci_low"] == pytest.approx(mu - 1.959963984540054 * sw**-0.5)
    assert found["o", "best_guess"]["delta"] == pytest.approx(found["o", "best_guess"]["estimate"] - mu)
    assert found["o", "dependency"]["estimate"] is None


def test_one_row_is_counted_and_not_pooled(found):
    lone = found["lone", "primary"]
    assert lone["k"] == 1 and lone["estimate"] is None and lone["delta"] is None


def test_no_rows(spark):
    assert named_analyses(spark.createDataFrame([], SCHEMA), ["outcome"]).count() == 0


def test_routes(spark):
    rows = spark.createDataFrame([("figure:x",), ("digitize_bar",), ("test_statistic:t",), ("p_value",), ("table:figure",), (None,)], "r string")
    got = rows.select(is_figure_route(F.col("r")), is_statistic_route(F.col("r"))).collect()
    assert [tuple(r) for r in got] == [(True, False), (True, False), (False, True), (False, True), (False, False), (False, False)]
