"""Collections drawn from ordinary tables in a folder of Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from setweave.operators.elements import distinct_pairs


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def order_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as sets of parts."""
    return distinct_pairs(table(spark, folder, "lineitem"), "l_orderkey", "l_partkey")


def customer_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as sets of the parts that they have ordered."""
    orders = table(spark, folder, "orders").select("o_orderkey", "o_custkey")
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_partkey")
    return distinct_pairs(lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")), "o_custkey", "l_partkey")


def supplier_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Suppliers as sets of parts."""
    return distinct_pairs(table(spark, folder, "lineitem"), "l_suppkey", "l_partkey")


def user_types(spark: SparkSession, folder: str) -> DataFrame:
    """Users as sets of the kinds and hours of their events, as text."""
    kind = F.concat_ws("|", "event_type", F.hour("ts").cast("string"))
    return distinct_pairs(table(spark, folder, "events").withColumn("kind", kind), "user_id", "kind")


COLLECTIONS = {"order_parts": order_parts, "customer_parts": customer_parts, "supplier_parts": supplier_parts, "user_types": user_types}
