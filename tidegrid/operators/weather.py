"""Joining weather and daily tables to hourly rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.stats import row_mean
from tidegrid.operators.impute import calendar_fill
from tidegrid.operators.grid import grid_of


def join_hourly(df: DataFrame, other: DataFrame, other_ts: str, keys=()) -> DataFrame:
    """Left join on the stamp where the right side names it differently."""
    return df.join(other.withColumnRenamed(other_ts, "ts"), [*keys, "ts"], "left")


def join_daily(df: DataFrame, daily: DataFrame, day: str, keys=()) -> DataFrame:
    """Left join of a daily table to (sub-daily) rows on their date."""
    return (df.withColumn(day, F.to_date("ts")).join(daily, [*keys, day], "left").drop(day))


def stations_wide(readings: DataFrame, stations, value: str = "value") -> DataFrame:
    """One column per station on each stamp: one shuffle instead of a join per
    station. The station list is given, so no extra job looks for it."""
    return readings.groupBy("ts").pivot("station", list(stations)).agg(F.avg(value))


def stations_on_grid(readings: DataFrame, bounds: DataFrame, stations, step: str,
                     value: str = "value") -> DataFrame:
    """Every grid step with one (nullable) column per station."""
    return grid_of(bounds, step).join(stations_wide(readings, stations, value), "ts", "left")


def stations_wide_by_joins(readings: DataFrame, bounds: DataFrame, stations, step: str,
                           value: str = "value") -> DataFrame:
    """The same table as a chain of left joins, for stations landed as own tables."""
    out = grid_of(bounds, step)
    for s in stations:
        one = (readings.where(F.col("station") == s).groupBy("ts").agg(F.avg(value).alias(s)))
        out = out.join(one, "ts", "left")
    return out


def filled_station_mean(wide: DataFrame, stations, parts, name: str = "mean_temp") -> DataFrame:
    """Fill each station from its calendar means, then average across stations."""
    long = wide.select("ts", F.explode(F.array(*[
        F.struct(F.lit(s).alias("station"), F.col(s).cast("double").alias("value"))
        for s in stations])).alias("r")).select("ts", "r.station", "r.value")
    filled = calendar_fill(long, parts, keys=("station",), skip_null=True)
    return (stations_wide(filled, stations)
            .withColumn(name, row_mean(*stations)).select("ts", *stations, name))


def daily_high_low(readings: DataFrame, stations, value: str = "value") -> DataFrame:
    """(day, <station>_high, <station>_low ...) from station readings."""
    return (readings.groupBy(F.to_date("ts").alias("day")).pivot("station", list(stations))
            .agg(F.max(value).alias("high"), F.min(value).alias("low")))
