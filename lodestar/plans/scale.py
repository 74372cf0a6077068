"""The same kinds of operator over the star schema, whose tables grow with the scale factor."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators.ingest import latest
from lodestar.sources.tables import read


def orders_without_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Anti join: orders without a discounted line."""
    lines = read(spark, sf_dir, "lineitem").where("l_discount > 0.05").select(F.col("l_orderkey").alias("o_orderkey"))
    return read(spark, sf_dir, "orders").join(lines, "o_orderkey", "left_anti").groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def latest_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keep the latest per key: each customer's last order."""
    o = read(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return latest(o, "o_custkey", F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


def top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top two customers of each nation by money spent; sums first, so that the join and window see a row per customer."""
    spent = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.round(F.sum("o_totalprice"), 2).alias("spent"))
    c = read(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(spent, "c_custkey")
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("spent"), "c_custkey")
    return c.withColumn("place", F.row_number().over(w)).where("place <= 2").select("c_nationkey", "c_custkey", "spent", "place")


def line_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conditional aggregates in one pass."""
    p = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return read(spark, sf_dir, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.round(F.sum(p), 2).alias("revenue"), F.count_if(F.col("l_quantity") > 25).alias("large"), F.round(F.avg("l_discount"), 6).alias("mean_discount")
    )


def daily_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day and kind, distinct users among them."""
    return read(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


QUERIES = {"star_orders_without_items": orders_without_items, "star_latest_order": latest_order, "star_top_customers": top_customers, "star_line_summary": line_summary, "star_daily_events": daily_events}
ORACLE_SQL = {
    "star_orders_without_items": "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_discount > 0.05) GROUP BY 1",
    "star_latest_order": "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1",
    "star_top_customers": """SELECT * FROM (SELECT c_nationkey, c_custkey, spent, row_number() OVER (PARTITION BY c_nationkey ORDER BY spent DESC, c_custkey) AS place
      FROM customer JOIN (SELECT o_custkey AS c_custkey, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1) USING (c_custkey)) WHERE place <= 2""",
    "star_line_summary": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) FILTER (WHERE l_quantity > 25) AS large, round(avg(l_discount), 6) AS mean_discount FROM lineitem GROUP BY 1, 2",
    "star_daily_events": "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2",
}
