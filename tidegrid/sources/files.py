"""Landed files: explicit schemas, ``NA`` as null, no inference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.functions.text import clean_names, parse_minute
from tidegrid.session import use_utc

# Columns kept from a station file.
STATION_COLUMNS = ("tmpf", "dwpf", "relh", "drct", "sknt", "alti", "mslp", "vsby", "feel")

LOAD_SCHEMA = "Date string, load double, zone string"
MERGED_TEMPERATURE_SCHEMA = "_c0 int, date string, Means double"
DAILY_METRICS_SCHEMA = "_c0 int, Date date, MAPE double, RMSE double, peak string, peak_pred string"
PREDICTION_LOG_SCHEMA = "_c0 int, Date timestamp, load double, predict double"


def read_csv(spark: SparkSession, path, schema: str) -> DataFrame:
    """CSV with a header. An empty quoted text stays empty; ``NA`` is null."""
    return use_utc(spark).read.csv(path, header=True, schema=schema, nullValue="NA", emptyValue="",
                                   enforceSchema=True)


def read_load(spark: SparkSession, path, fmt: str = "csv", series: str | None = None) -> DataFrame:
    """Load table with text stamps -> (series_id, ts, value)."""
    raw = read_csv(spark, path, LOAD_SCHEMA) if fmt == "csv" else use_utc(spark).read.format(fmt).load(path)
    series_id = F.lit(series) if series is not None else F.col("zone")
    return raw.select(series_id.alias("series_id"), parse_minute("Date").alias("ts"),
                      F.col("load").alias("value"))


def read_daily_weather(spark: SparkSession, path, fmt: str = "csv", day: str = "Date") -> DataFrame:
    """Daily highs and lows; blanks and dashes are cleaned from the names."""
    reader = use_utc(spark).read
    if fmt == "csv":
        # Column names differ per landing; every column but the day is numeric.
        raw = clean_names(reader.csv(path, header=True, nullValue="NA"))
        return raw.select(F.to_date(day).alias(day), *[
            F.col(c).cast("double").alias(c) for c in raw.columns if c != day])
    return clean_names(reader.format(fmt).load(path))


def read_stations(spark: SparkSession, path, start=None, end=None,
                  columns=STATION_COLUMNS, ts: str = "valid") -> DataFrame:
    """All station folders (``.../station=XXX/day=YYYY-MM-DD/``) in one scan. The folders name station and day:
    a station filter and the stamp range prune whole folders, as the range is also said of the days."""
    schema = ", ".join(["station string", "day date", f"{ts} timestamp", *[f"{c} double" for c in columns]])
    out = use_utc(spark).read.csv(path, header=True, schema=schema, nullValue="NA")
    if start is not None:
        out = out.where((F.col(ts) >= F.lit(start)) & (F.col("day") >= F.to_date(F.lit(start))))
    if end is not None:
        out = out.where((F.col(ts) < F.lit(end)) & (F.col("day") <= F.to_date(F.lit(end))))
    return out.withColumnRenamed(ts, "ts").drop("day")


def read_metrics(spark: SparkSession, path) -> DataFrame:
    """Stored daily metrics; the row-id column is dropped."""
    return read_csv(spark, path, DAILY_METRICS_SCHEMA).drop("_c0")


def stations_of(catalogue: DataFrame, network: str, column: str = "network") -> DataFrame:
    return catalogue.where(F.col(column) == network)


def file_station(column: str = "station") -> Column:
    """Station code from a file name like ``.../LAXtemperature.csv``."""
    return F.regexp_extract(F.input_file_name(), r"([A-Z]+)[a-z]*(?:_2)?\.csv$", 1).alias(column)
