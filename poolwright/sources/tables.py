"""The driver's tables and their projection on the domain of evidence synthesis.

study = nation and market segment, cluster = nation, outcome = region; arm A = returned, arm B = not
returned line items; measure = extended price.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """study, cluster, outcome, arm, value, order date: one row a line item."""
    t = lambda name: table(spark, sf_dir, name)
    places = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        t("lineitem")
        .where(F.col("l_returnflag").isin("R", "N"))
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(places, F.col("o_custkey") == F.col("c_custkey"))
        .select(
            F.concat_ws(":", "n_name", "c_mktsegment").alias("study"),
            F.col("n_name").alias("cluster"),
            F.col("r_name").alias("outcome"),
            F.when(F.col("l_returnflag") == "R", "A").otherwise("B").alias("arm"),
            F.col("l_extendedprice").alias("value"),
        )
    )


def arms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a study: n, mean and SD of both arms. One aggregate; the arms are conditional sums."""

    def of(f, arm: str, name: str):
        return f(F.when(F.col("arm") == arm, F.col("value"))).alias(f"{name}_{arm.lower()}")

    columns = [of(f, arm, name) for arm in "AB" for f, name in ((F.count, "n"), (F.avg, "m"), (F.stddev_samp, "sd"))]
    return readings(spark, sf_dir).groupBy("outcome", "cluster", "study").agg(*columns).where("n_a > 1 and n_b > 1")


#: The same for the oracles.
ARMS_SQL = """
arms AS (
  SELECT r_name AS outcome, n_name AS cluster, n_name || ':' || c_mktsegment AS study,
         count(*) FILTER (WHERE l_returnflag = 'R') AS n_a, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS m_a,
         stddev_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'R') AS sd_a,
         count(*) FILTER (WHERE l_returnflag = 'N') AS n_b, avg(l_extendedprice) FILTER (WHERE l_returnflag = 'N') AS m_b,
         stddev_samp(l_extendedprice) FILTER (WHERE l_returnflag = 'N') AS sd_b
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
       JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE l_returnflag IN ('R', 'N') GROUP BY ALL HAVING n_a > 1 AND n_b > 1
)"""

#: d and its Borenstein variance for each study.
EFFECTS_SQL = (
    ARMS_SQL
    + """, smd AS (
  SELECT *, (m_a - m_b) / sqrt(((n_a - 1) * sd_a * sd_a + (n_b - 1) * sd_b * sd_b) / (n_a + n_b - 2)) AS y FROM arms
), effects AS (
  SELECT *, 1.0 / n_a + 1.0 / n_b + y * y / (2.0 * (n_a + n_b)) AS v FROM smd
)"""
)


def effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    from poolwright.functions import effects as e

    c = F.col
    smd = arms(spark, sf_dir).withColumn("y", e.cohens_d(c("m_a"), c("sd_a"), c("n_a"), c("m_b"), c("sd_b"), c("n_b")))
    return smd.withColumn("v", e.var_smd(c("y"), c("n_a"), c("n_b")))
