"""sd_from_quantiles has no SQL: its groups, however large, against a plain computation."""

from __future__ import annotations

from collections import defaultdict
from statistics import NormalDist, median

import duckdb
import numpy as np
import pytest

from poolwright.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def test_all_suppliers_and_rows(spark):
    rows = defaultdict(list)
    for s, q in duckdb.sql(f"SELECT l_suppkey, l_quantity FROM '{SF}/lineitem.parquet'").fetchall():
        rows[s].append(q)
    got = {r["supplier"]: r for r in QUERIES["sd_from_quantiles"](spark, SF).collect()}
    assert set(got) == {s for s, x in rows.items() if len(x) > 1} and max(map(len, rows.values())) > 40
    z = NormalDist().inv_cdf
    for s, r in got.items():
        x = rows[s]
        n, (q1, q3) = len(x), np.quantile(x, [0.25, 0.75])
        xi, eta = 2 * z((n - 0.375) / (n + 0.25)), 2 * z((0.75 * n - 0.125) / (n + 0.25))
        assert r["n"] == n
        assert r["mean_three"] == pytest.approx((q1 + median(x) + q3) / 3, abs=2e-6)
        assert r["sd_iqr"] == pytest.approx((q3 - q1) / eta, abs=2e-6)
        assert r["sd_range"] == pytest.approx((max(x) - min(x)) / xi, abs=2e-6)
