"""Quotes shorter than the key are found by either way of search."""

from __future__ import annotations

import pytest

from poolwright.plans.text_queries import quote_places

TEXTS = {1: "alpha beta gamma delta", 2: "ab", 3: "", 4: None, 5: "xx beta gamma", 6: "beta gam"}
QUOTES = {1: "beta gamma", 2: "ab", 3: "a", 4: "", 5: "not there", 6: "eta", 7: "beta gam", 8: None, 9: "alpha b"}


@pytest.mark.parametrize("most_heads", [1000, 0])
def test_short_quotes_are_found_either_way(spark, most_heads):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id long, text string")
    quotes = spark.createDataFrame(list(QUOTES.items()), "item_id long, quote string")
    want = {}
    for k, q in QUOTES.items():
        at = [d for d, t in TEXTS.items() if q is not None and t is not None and q in t]
        want[k] = (len(at), min(at, default=None))
    assert {r["item_id"]: (r["places"], r["first"]) for r in quote_places(quotes, docs, most_heads).collect()} == want
