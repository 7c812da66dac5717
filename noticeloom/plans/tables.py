"""The driver tables in the roles of notices, events, prices and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as notices."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("source"), F.col("o_orderpriority").alias("category"),
        F.col("o_orderpriority").alias("title"), F.col("o_orderdate").cast("date").alias("announcement_date"), F.col("o_custkey").alias("provider"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as events of notices: open lines are receptions, others contracts; N lines have no end, a tenth of those is open-ended."""
    start = F.col("l_shipdate").cast("date")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("notice_id"), F.col("l_linenumber").alias("pos"),
        F.when(F.col("l_linestatus") == "O", "general").otherwise("contract").alias("kind"),
        F.when(F.col("l_quantity") % 10 == 0, "상시 접수").otherwise("접수").alias("label"), start.alias("start_date"),
        F.when(F.col("l_returnflag") != "N", F.date_add(start, F.col("l_linenumber"))).alias("end_date"),
    )


NOTICES_SQL = """notices AS (
  SELECT o_orderkey AS id, o_orderstatus AS source, o_orderpriority AS category, o_orderpriority AS title,
    CAST(o_orderdate AS DATE) AS announcement_date, o_custkey AS provider FROM orders)"""
EVENTS_SQL = """notice_events AS (
  SELECT l_orderkey AS notice_id, l_linenumber AS pos, CASE WHEN l_linestatus = 'O' THEN 'general' ELSE 'contract' END AS kind,
    CASE WHEN l_quantity % 10 = 0 THEN '상시 접수' ELSE '접수' END AS label, CAST(l_shipdate AS DATE) AS start_date,
    CASE WHEN l_returnflag <> 'N' THEN CAST(CAST(l_shipdate AS DATE) + CAST(l_linenumber AS INTEGER) AS DATE) END AS end_date FROM lineitem)"""
