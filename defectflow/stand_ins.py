"""Orders as commits and line items as changed lines, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _preds(spark: SparkSession, d: str) -> DataFrame:
    """``commit_hash, project, prob, real_label, loc`` of each order."""
    loc = _table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_quantity").cast("double").alias("loc"))
    o = _table(spark, d, "orders").join(loc, "o_orderkey", "left")
    prob = ((F.col("o_orderkey") * 7919) % 1000) / 1000.0
    real = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0)
    return o.select(F.col("o_orderkey").alias("commit_hash"), F.col("o_orderpriority").alias("project"), prob.alias("prob"), real.alias("real_label"), F.coalesce("loc", F.lit(0.0)).alias("loc"))


_PREDS = """
p AS (SELECT o_orderkey AS commit_hash, o_orderpriority AS project, ((o_orderkey * 7919) % 1000) / 1000.0::DOUBLE AS prob,
             CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS real_label, coalesce(q, 0)::DOUBLE AS loc
      FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity)::DOUBLE AS q FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey)"""


def _lines(spark: SparkSession, d: str) -> DataFrame:
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity")
    li = _table(spark, d, "lineitem").withColumn("idx", F.row_number().over(order))
    return li.select(F.col("l_orderkey").alias("commit_id"), "idx", F.col("l_extendedprice").cast("double").alias("score"), F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"))


_LINES = """
l AS (SELECT l_orderkey AS commit_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS idx,
             l_extendedprice::DOUBLE AS score, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY commit_id ORDER BY score DESC, idx) AS rank, count(*) OVER (PARTITION BY commit_id) AS n,
             sum(label) OVER (PARTITION BY commit_id) AS n_buggy, sum(label) OVER (PARTITION BY commit_id ORDER BY score DESC, idx ROWS UNBOUNDED PRECEDING) AS buggy_rank FROM l)"""
