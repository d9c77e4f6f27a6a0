from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from poolwright.sources import files


def test_discover(spark, tmp_path):
    (tmp_path / "a").mkdir()
    for name, data in (("b.pdf", b"one"), ("a/c.pdf", b"one"), ("d.pdf", b"two"), ("e.txt", b"three")):
        (tmp_path / name).write_bytes(data)
    rows = files.discover(spark, str(tmp_path)).collect()
    assert sorted(r["path"].rsplit("/", 1)[-1] for r in rows) == ["c.pdf", "d.pdf"]


def test_stages(spark, tmp_path):
    for paper, value in (("p1", 1), ("p2", 2)):
        (tmp_path / "papers" / paper).mkdir(parents=True)
        (tmp_path / "papers" / paper / "resolve.json").write_text('{"es": %d}' % value)
    df = files.read_stage(spark, str(tmp_path), "resolve")
    assert {(r["paper_id"], r["es"]) for r in df.collect()} == {("p1", 1), ("p2", 2)}
    files.write_stage(df, str(tmp_path / "out"), "pooled")
    files.write_stage(df.where("paper_id = 'p2'").withColumn("es", F.lit(9)), str(tmp_path / "out"), "pooled")
    again = spark.read.json(str(tmp_path / "out" / "pooled"))
    assert {(r["paper_id"], r["es"]) for r in again.collect()} == {("p1", 1), ("p2", 9)}
    assert files.pending(df, again.where("paper_id = 'p1'"), ["paper_id"]).count() == 1


def test_gold(spark, tmp_path):
    (tmp_path / "g.csv").write_text("# note\nAuthor , TE,n\nA,0.5,3\nB,,4\nC,x,5\n")
    aliases = {"te": ("TE",), "author": ("Author",), "n": ("N",)}
    rows = files.read_gold(spark, str(tmp_path / "g.csv"), aliases, ("te", "author"), ("te", "n")).collect()
    assert [(r["te"], r["author"], r["n"]) for r in rows] == [(0.5, "A", 3.0)]
    with pytest.raises(ValueError):
        files.resolve_columns(["x"], aliases, ("te",))


def test_settings():
    profiles = {"p": {"estimator": "hedges", "level": 0.95}}
    assert files.load_settings("profile: p\nlevel: 0.9\n", profiles) == {"profile": "p", "estimator": "hedges", "level": 0.9}
    with pytest.raises(ValueError):
        files.load_settings("a: 1\na: 2\n", {})
    assert files.settings_hash({"b": 1, "a": 2}) == files.settings_hash({"a": 2, "b": 1})


def test_cache_and_sinks(spark, tmp_path):
    requests = spark.createDataFrame([("k1",), ("k2",), ("k3",)], "key string")
    cache = spark.createDataFrame([("k1", "r"), ("k2", None)], "key string, reply string")
    hits, misses = files.cached(requests, cache, "key")
    assert hits.count() == 1 and {r["key"] for r in misses.collect()} == {"k2", "k3"}
    df = spark.createDataFrame([("a", float("nan"), {"x": "1"}), ("b", 2.0, {"y": "2"})], "id string, es double, mod map<string,string>")
    wide = files.extraction_table(df, ["id", "es"], "mod")
    assert wide.columns == ["id", "es", "mod_x", "mod_y"]
    files.write_rows(wide, str(tmp_path / "t"), ["id", "es"])
    assert {r["es"] for r in spark.read.json(str(tmp_path / "t.json")).collect()} == {None, 2.0}
    files.append_log(requests, str(tmp_path / "log"), F.col("key"), 4)
    assert sorted(r["seq"] for r in spark.read.json(str(tmp_path / "log")).collect()) == [5, 6, 7]
