"""Decision tables of the vote, the text functions, the log and the streams."""

from __future__ import annotations

import json
import random
import time

import pytest
from pyspark.sql import functions as F

from poolwright.functions import text as t
from poolwright.operators import graph, log, matching, voting
from poolwright.streaming import events as streams

READING = "cell int, ord int, route string, unit string, printed boolean, mean double, tolerance double, figure string, place string, spread double, spread_type string, n double"


def test_route_values(spark):
    cases = [
        ([1.0, 1.1], [0.1, 0.05], 1.05),  # within the looser one
        ([1.0, 2.0], [0.1, 0.1], None),  # nobody read the middle
        ([1.0, 1.05, 9.0], [0.1] * 3, 1.05),  # the median is a supported reading
        ([1.0, 1.05, 9.0, 20.0], [0.1] * 4, 1.025),  # the largest set votes
        ([5.0], [0.1], 5.0),
    ]
    rows = [(k, i, "r", None, True, m, t, None, None, None, None, None) for k, (means, tolerances, _) in enumerate(cases) for i, (m, t) in enumerate(zip(means, tolerances, strict=True))]
    rows += [(90, i, "r", None, False, 1.0, 0.5, "f1", p, None, None, None) for i, p in enumerate("ab")]
    rows += [(91, i, "r", None, False, 1.0, 0.5, f, "a", None, None, None) for i, f in enumerate(("f1", "f2"))]
    got = {r["cell"]: r["value"] for r in voting.route_values(spark.createDataFrame(rows, READING), ["cell"]).collect()}
    want = {k: v for k, (*_, v) in enumerate(cases)} | {90: None, 91: 1.0}  # two places in one figure are no reading
    assert got == {k: None if v is None else pytest.approx(v) for k, v in want.items()}


def test_vote(spark):
    p, f = True, False
    cases = [  # (value, printed, tolerance) by route, sd, verdict
        ([], None, ("none", "none", None)),
        ([(None, p, 0.1)], None, ("none", "none", None)),
        ([(3.0, p, 0.1)], None, ("single", "single", 3.0)),
        ([(3.0, p, 0.1), (3.05, p, 0.1)], None, ("agree", "printed_precision", 3.0)),
        ([(3.0, p, 0.1), (4.0, p, 0.1)], None, ("disagree", "printed_precision", None)),
        ([(3.0, p, 0.1), (3.4, f, 0.5)], None, ("agree", "figure_tolerance", 3.0)),  # a picture corroborates, never sets
        ([(3.0, p, 0.1), (9.0, f, 0.5)], None, ("single", "printed_uncorroborated", 3.0)),
        ([(3.0, f, 0.1), (3.08, f, 0.1)], None, ("agree", "figure_tolerance", 3.04)),
        ([(3.0, f, 0.1), (4.0, f, 0.1)], None, ("disagree", "figure_tolerance", None)),
        ([(3.0, f, 0.1), (4.0, f, 0.1)], 20.0, ("agree", "negligible_split", 3.0)),
        ([(-0.5, f, 0.1), (0.5, f, 0.1)], 20.0, ("disagree", "figure_tolerance", None)),
    ]
    rows = [(k, i, f"r{i}", "cm", pr, v, t, None, None, sd, "SD", None) for k, (routes, sd, _) in enumerate(cases) for i, (v, pr, t) in enumerate(routes)]
    rows.append((0, 0, None, None, None, None, None, None, None, None, None, None))
    # a route of two places in one figure does not vote; two such routes' places meet among the winners
    rows += [(20, i, "r", "cm", f, 1.0, 0.5, "f1", pl, None, None, None) for i, pl in enumerate("ab")]
    rows += [(21, i, f"r{i}", "cm", f, 1.0, 0.5, "f1", pl, None, None, None) for i, pl in enumerate("ab")]
    got = {r["cell"]: (r["agreement"], r["method"], r["value"]) for r in voting.vote(spark.createDataFrame(rows, READING), ["cell"]).collect()}
    want = {k: v for k, (*_, v) in enumerate(cases)} | {20: ("disagree", "locator_conflict", None), 21: ("disagree", "locator_conflict", None)}
    assert got == {k: (*v[:2], None if v[2] is None else pytest.approx(v[2])) for k, v in want.items()}


@pytest.mark.parametrize(
    ("text", "numbers"),
    [("mean 3.5 (SD 1.2), n = 20", [3.5, 1.2, 20.0]), ("a 95% CI of -2 to 4", [-2.0, 4.0]), ("no3 A4", []), ("", []), (None, None)],
)
def test_numbers(spark, text, numbers):
    df = spark.createDataFrame([(text,)], "s string").select(t.numbers_in(F.col("s")).alias("x"))
    assert df.first()["x"] == numbers


def test_titles(spark):
    rows = [("The Café: Généralisation of Behaviour!",), (None,), ("",)]
    got = [r[0] for r in spark.createDataFrame(rows, "s string").select(t.normalise_title(F.col("s"))).collect()]
    assert got == ["the cafe generalization of behavior", None, ""]


def test_components_by_brute_force(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in parent}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_duplicates_with_conflicting_dois(spark):
    rows = [(1, "10.1/a", "t", 2000), (2, "", "t", 2000), (3, "10.1/b", "u", 2001), (4, "10.1/c", "u", 2001), (5, "10.1/a", "z", 1999), (6, "", "", 2000), (7, None, None, None)]
    df = spark.createDataFrame(rows, "k long, doi string, title string, year int")
    got = {r["k"]: r["group"] for r in matching.duplicate_groups(df, "k", "doi", "title", "year").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1, 6: 6, 7: 7}


def test_log_lines(spark, tmp_path):
    lines = [
        json.dumps({"seq": 5, "kind": "value", "dataset": "d1", "outcome": "o", "arm": "A", "mean": 1.0}),
        "{broken",
        json.dumps({"kind": "value", "dataset": "d1", "outcome": "o", "arm": "A", "n": 1.0}),
        "",
    ]
    (tmp_path / "log.jsonl").write_text("\n".join(lines))
    rows = log.validate(log.read_log(spark, str(tmp_path / "log.jsonl"))).orderBy("seq").collect()
    assert [(r["seq"], r["kind"], r["problem"]) for r in rows] == [(2, "unreadable", "unknown kind"), (3, "value", "n too small"), (5, "value", None)]


def test_streams_equal_batches(spark, tmp_path):
    source = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    for part, cond in enumerate(("event_id < 400", "event_id >= 400 and event_id < 700", "event_id >= 700")):
        source.where(cond).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    stream = spark.readStream.schema(source.schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = streams.latest_values(stream).writeStream.outputMode("update").format("memory").queryName("latest").start()
    query.processAllAvailable()
    query.stop()
    streamed = {r["user_id"]: (r["last_seq"], r["last_value"]) for r in spark.sql("select user_id, max(last_seq) last_seq, max_by(last_value, last_seq) last_value from latest group by 1").collect()}
    batch = {r["user_id"]: (r["s"], r["v"]) for r in source.groupBy("user_id").agg(F.max("event_id").alias("s"), F.max_by("value", "event_id").alias("v")).collect()}
    assert streamed == batch
    query = streams.tumbling(stream).writeStream.outputMode("complete").format("memory").queryName("windows").start()
    query.processAllAvailable()
    query.stop()
    time.sleep(0.1)
    key = lambda r: (r["start"], r["event_type"])
    a = {key(r): (r["n"], round(r["total"], 6)) for r in spark.sql("select * from windows").collect()}
    b = {key(r): (r["n"], round(r["total"], 6)) for r in streams.tumbling(source).collect()}
    assert a == b
