"""Derived inputs that several queries share, as DataFrames and as SQL text."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .registry import table

INV = "SELECT l_orderkey, l_linenumber, l_suppkey AS plot, p_brand AS species, l_extendedprice AS price, l_quantity AS qty FROM lineitem JOIN part ON l_partkey = p_partkey"
PTS = "SELECT CAST(label AS BIGINT) AS ds, vec_id AS id, CAST(embedding[1] AS DOUBLE) * 100.0 AS x, CAST(embedding[2] AS DOUBLE) * 100.0 AS y, 10.0 + abs(CAST(embedding[3] AS DOUBLE)) * 100.0 AS h FROM embeddings"
DSM = "SELECT l_partkey % 100 AS row, l_suppkey % 100 AS col, avg(l_extendedprice) AS value FROM lineitem GROUP BY 1, 2"
DTM = "SELECT o_custkey % 100 AS row, (o_orderkey // 7) % 100 AS col, avg(o_totalprice) / 10 AS value FROM orders GROUP BY 1, 2"
MISSIONS = """SELECT o_orderkey AS k, o_orderdate AS flown,
  CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE 60 + (o_orderkey * 7919) % 110 END AS alt,
  (o_orderkey * 104729) % 40 AS pitch, CAST((o_orderkey * 1299709) % 100 AS DOUBLE) / 100 AS corr,
  CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE 5 + (o_orderkey * 611953) % 20 END AS sd,
  65 + (o_orderkey * 15485863) % 31 AS front, 55 + (o_orderkey * 32452843) % 36 AS side,
  (o_orderkey * 37) % 1000 AS minx, (o_orderkey * 91) % 1000 AS miny FROM orders"""
LADDER = """CASE WHEN alt IS NULL THEN 'unknown'
  WHEN NOT (corr > 0.75 OR coalesce(sd < 12, false)) THEN 'low-terrain-fidelity'
  WHEN alt BETWEEN 100 AND 160 AND pitch BETWEEN 0 AND 10 AND ((front >= 90 AND side >= 80) OR (front >= 85 AND side >= 85)) THEN 'high-nadir'
  WHEN alt BETWEEN 60 AND 120 AND pitch BETWEEN 18 AND 38 AND front >= 70 AND side >= 60 THEN 'low-oblique'
  ELSE 'unclassified' END"""


def inventory(spark: SparkSession, d: str) -> DataFrame:
    part = table(spark, d, "part").select("p_partkey", F.col("p_brand").alias("species"))
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_suppkey").alias("plot"), F.col("l_extendedprice").alias("price"), F.col("l_quantity").alias("qty"))
    return lines.join(part, lines.l_partkey == part.p_partkey).drop("l_partkey", "p_partkey")


def points(spark: SparkSession, d: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, d, "embeddings").select(F.col("label").cast("long").alias("ds"), F.col("vec_id").alias("id"), (e(0) * 100.0).alias("x"), (e(1) * 100.0).alias("y"), (10.0 + F.abs(e(2)) * 100.0).alias("h"))


def surface(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "lineitem")
    return lines.groupBy((F.col("l_partkey") % 100).alias("row"), (F.col("l_suppkey") % 100).alias("col")).agg(F.avg("l_extendedprice").alias("value"))


def terrain(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders")
    return orders.groupBy((F.col("o_custkey") % 100).alias("row"), F.expr("(o_orderkey div 7) % 100").alias("col")).agg((F.avg("o_totalprice") / 10).alias("value"))


def missions(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select(
        k.alias("k"),
        F.col("o_orderdate").alias("flown"),
        F.when(k % 11 != 0, 60 + (k * 7919) % 110).alias("alt"),
        ((k * 104729) % 40).alias("pitch"),
        (((k * 1299709) % 100).cast("double") / 100).alias("corr"),
        F.when(k % 17 != 0, 5 + (k * 611953) % 20).alias("sd"),
        (65 + (k * 15485863) % 31).alias("front"),
        (55 + (k * 32452843) % 36).alias("side"),
        ((k * 37) % 1000).alias("minx"),
        ((k * 91) % 1000).alias("miny"),
    )
