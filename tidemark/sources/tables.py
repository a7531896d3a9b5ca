"""Star-schema tables as point views with typed columns: reads stay prunable and filterable."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.model import PointView


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ns(column: str):
    return F.unix_micros(F.col(column).cast("timestamp")) * F.lit(1000).cast("long")


def events(spark: SparkSession, sf_dir: str) -> PointView:
    """metric events; tags event_type, user_id; fields value, k (from props), note (the type, a string); seq event_id."""
    df = table(spark, sf_dir, "events").select(
        F.lit("events").alias("metric"), "event_type", F.col("user_id").cast("string").alias("user_id"), "ts", ns("ts").alias("ts_ns"),
        "value", F.get_json_object("props", "$.k").cast("long").alias("k"), F.col("event_type").alias("note"), F.col("event_id").alias("seq"), F.lit("E").alias("op"),
    )
    return PointView(df, {"event_type": "event_type", "user_id": "user_id"}, {"value": "value", "k": "k", "note": "note"}, "ts")


def orders(spark: SparkSession, sf_dir: str) -> PointView:
    """metric orders; tags status, priority; field totalprice; seq o_orderkey: points of one series and time overwrite."""
    df = table(spark, sf_dir, "orders").select(
        F.lit("orders").alias("metric"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"), F.col("o_orderdate").alias("ts"),
        ns("o_orderdate").alias("ts_ns"), F.col("o_totalprice").alias("totalprice"), F.col("o_orderkey").alias("seq"), F.lit("E").alias("op"),
    )
    return PointView(df, {"status": "status", "priority": "priority"}, {"totalprice": "totalprice"}, "ts")


def lineitem(spark: SparkSession, sf_dir: str) -> PointView:
    """metric lineitem; tags returnflag, linestatus; four numeric fields.  It has no write order: aggregates only."""
    fields = {"quantity": "l_quantity", "extendedprice": "l_extendedprice", "discount": "l_discount", "tax": "l_tax"}
    df = table(spark, sf_dir, "lineitem").select(
        F.lit("lineitem").alias("metric"), F.col("l_returnflag").alias("returnflag"), F.col("l_linestatus").alias("linestatus"),
        F.col("l_shipdate").alias("ts"), ns("l_shipdate").alias("ts_ns"), *fields.values(),
    )
    return PointView(df, {"returnflag": "returnflag", "linestatus": "linestatus"}, fields, "ts")


def keyed(view: PointView) -> DataFrame:
    """The view's rows with their series key, as the versioning operators want them."""
    return view.df.withColumn("series_key", view.key())
