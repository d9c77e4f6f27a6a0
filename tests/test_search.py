from __future__ import annotations

import re

from pyspark.sql import functions as F

from poolwright.operators import figures, search


def test_prune_by_brute_force(spark):
    texts = ["the cat and dog", "The dog of war", "a cat of the house", "cats and dogs", "licensed of", "the and", None, ""]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    has = lambda t, w: t is not None and re.search(rf"(?<!\w){w}(?!\w)", t.lower()) is not None
    hits = lambda blocks: sum(all(any(has(t, w) for w in b) for b in blocks) for t in texts)
    blocks, dropped = search.prune(docs, "text", [["the", "cat", "licensed"], ["and", "of"]], {"cat"}, {"licensed"}, 2)
    assert hits(blocks) <= 2 or all(len(b) == 1 or set(b) <= {"licensed"} for b in blocks)
    assert dropped[0] == ("cat", 2)  # a variant within the margin goes before the wider term
    assert search.query_hits(docs, "text", blocks).count() == hits(blocks)


def test_snowball_stops_and_caps(spark):
    edges = spark.createDataFrame([(1, 2), (1, 3), (2, 4), (4, 5), (5, 1)], "a long, b long")
    seeds = spark.createDataFrame([(1,)], "id long")
    got = {r["id"]: r["round"] for r in search.snowball(edges, seeds, 9).collect()}
    assert got == {1: 0, 2: 1, 3: 1, 4: 2, 5: 3}
    assert {r["id"] for r in search.snowball(edges, seeds, 1, per_round=1).collect()} == {1, 2}


def test_tick_pairs(spark):
    labels = spark.createDataFrame([("x", 10.4, 0.0), ("x", 20.2, 5.0), ("x", 29.0, 10.0), ("x", 90.0, 99.0)], "axis string, at double, value double")
    lines = spark.createDataFrame([("x", 10.0), ("x", 20.0), ("x", 30.0), ("x", 40.0)], "axis string, px double")
    got = [(r["px"], r["value"]) for r in figures.pair_ticks(labels, lines, "axis").orderBy("px").collect()]
    assert got == [(10.0, 0.0), (20.0, 5.0), (30.0, 10.0)]


def test_ticks_off_the_trend(spark):
    read = [("x", 10.0 * k, 5.0 * k) for k in range(1, 8)]
    read[3] = ("x", 40.0, 900.0)  # a digit too many
    read += [("y", 12.0, 1.0), ("z", 10.0, 1.0), ("z", 20.0, 2.0)]
    labels = spark.createDataFrame(read, "axis string, at double, value double")
    lines = spark.createDataFrame([("x", 10.0 * k + 0.5) for k in range(1, 9)] + [("y", 12.0)], "axis string, px double")
    got = {(r["axis"], r["px"], r["value"]) for r in figures.pair_ticks(labels, lines, "axis").collect()}
    assert got == {("x", 10.0 * k + 0.5, 5.0 * k) for k in (1, 2, 3, 5, 6, 7)} | {("z", 10.0, 1.0), ("z", 20.0, 2.0)}  # y has one pair only


def test_nearest_pairs_first(spark):
    labels = spark.createDataFrame([("x", 10.0, 1.0), ("x", 12.0, 2.0), ("x", 31.0, 3.0)], "axis string, at double, value double")
    lines = spark.createDataFrame([("x", 11.5), ("x", 15.0), ("x", 30.0)], "axis string, px double")
    got = [(r["px"], r["value"]) for r in figures.pair_ticks(labels, lines, "axis").orderBy("px").collect()]
    assert got == [(11.5, 2.0), (30.0, 3.0)]


def test_arms(spark):
    rows = [(11.0, None), (7.8, 4.8), (5.0, 4.9), (None, None), (0.5, 3.0)]
    df = spark.createDataFrame(rows, "u double, d double").select(figures.resolve_arms(F.col("u"), F.col("d"), F.lit(1.0)).alias("x")).select("x.*")
    assert [(r["half"], r["side"]) for r in df.collect()] == [(11.0, "up"), (7.8, "up"), (4.95, None), (None, None), (3.0, "down")]
