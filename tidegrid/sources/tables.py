"""Series views of the given parquet tables: ``(series_id, ts, value)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.operators.grid import bucket_mean, complete
from tidegrid.operators.impute import calendar_fill
from tidegrid.session import use_utc

# The five region names that stand for weather stations.
STATIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return use_utc(spark).read.parquet(f"{folder}/{name}.parquet")


def event_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Irregular readings, one series per event type."""
    return table(spark, folder, "events").select(
        F.col("event_type").alias("series_id"), F.col("ts").cast("timestamp").alias("ts"), "value")


def shipment_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Daily stamps, one series per return flag and line status; value is the quantity."""
    return table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_returnflag", "l_linestatus").alias("series_id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        F.col("l_quantity").alias("value"))


def order_readings(spark: SparkSession, folder: str) -> DataFrame:
    """Daily stamps, one series per order priority."""
    return table(spark, folder, "orders").select(
        F.col("o_orderpriority").alias("series_id"),
        F.col("o_orderdate").cast("timestamp").alias("ts"), F.col("o_totalprice").alias("value"))


def hourly_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per hour over seven years, one series. The table has days only; the key's remainder stands for the hour."""
    at = F.col("o_orderdate").cast("timestamp") + F.make_dt_interval(hours=(F.col("o_orderkey") % 24).cast("int"))
    return table(spark, folder, "orders").groupBy(F.lit("orders").alias("series_id"), at.alias("ts")).agg(
        F.count("*").cast("double").alias("value"))


def filled_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Orders per hour without gaps; cells are the hours of the day."""
    return calendar_fill(complete(hourly_orders(spark, folder), "hour", mark=True), ("hour",))


def _customer_station(spark: SparkSession, folder: str) -> DataFrame:
    nation = table(spark, folder, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, folder, "region").select(
        F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("station"))
    home = nation.join(region, "n_regionkey").select(
        F.col("n_nationkey").alias("c_nationkey"), "station")
    return table(spark, folder, "customer").select("c_custkey", "c_nationkey").join(
        home, "c_nationkey").select("c_custkey", "station")


def station_readings(spark: SparkSession, folder: str) -> DataFrame:
    """(station, ts, value): events by the region of their user."""
    events = table(spark, folder, "events").select(
        F.col("user_id").alias("c_custkey"), F.col("ts").cast("timestamp").alias("ts"), "value")
    return events.join(_customer_station(spark, folder), "c_custkey").select("station", "ts", "value")


def station_days(spark: SparkSession, folder: str) -> DataFrame:
    """(station, ts, value): orders by the region of their customer, daily stamps."""
    orders = table(spark, folder, "orders").select(
        F.col("o_custkey").alias("c_custkey"), F.col("o_orderdate").cast("timestamp").alias("ts"),
        F.col("o_totalprice").alias("value"))
    return orders.join(_customer_station(spark, folder), "c_custkey").select("station", "ts", "value")


def hourly_events(spark: SparkSession, folder: str) -> DataFrame:
    return bucket_mean(event_readings(spark, folder), "hour")


def filled_events(spark: SparkSession, folder: str) -> DataFrame:
    """Hourly series without gaps; calendar cells are the hours of the day, as the
    table covers one month."""
    return calendar_fill(complete(hourly_events(spark, folder), "hour", mark=True), ("hour",))


def daily_shipments(spark: SparkSession, folder: str) -> DataFrame:
    return bucket_mean(shipment_readings(spark, folder), "day")


def filled_shipments(spark: SparkSession, folder: str) -> DataFrame:
    """Daily series without gaps over seven years; cells are (month, day)."""
    return calendar_fill(complete(daily_shipments(spark, folder), "day", mark=True), ("month", "day"))
