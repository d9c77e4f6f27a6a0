"""Connected components of an edge table, without bringing nodes or edges to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from poolwright.session import discard, release, written


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(a, b) long pairs -> (node, component): the smallest node that links lead to.

    Large-star and small-star steps in turn (Kiveris et al., 2014): every node's neighbours are
    tied to the smallest one it knows, so stars form in a logarithmic number of rounds and no
    task holds a component. Nodes without an edge are not listed.
    """
    current = written(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = current.unionByName(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        large = large.distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("x"), "m", "u")
        small = small.select(F.col("x").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v")))
        older, current = current, written(small.where("u <> v").distinct(), "edges")
        discard(older)
        state = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        release(current.sparkSession)
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return roots.unionByName(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct().join(roots.select("node"), "node", "left_anti"))
