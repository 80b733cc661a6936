"""Aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.catalogue.joins import _COLS, _STATION_GRID, station_hours
from tidegrid.catalogue.registry import (DAILY, DAY_FILLED_CHAIN, DENSE_CHAIN, FILLED_CHAIN, HOURLY,
                                         STATION_HOURS, STATION_ROWS, query, r, render, txt, with_)
from tidegrid.functions.stats import row_mean
from tidegrid.operators import grid, impute, weather
from tidegrid.sources import tables


@query("a1_dedupe_mean", with_(HOURLY) + f"SELECT series_id, {txt('ts')} AS ts, {r('value')} AS value FROM hourly")
def a1(spark, folder):
    return render(tables.hourly_events(spark, folder))


@query("a2_calendar_mean", with_(DAILY) + f"""SELECT series_id, CAST(month(ts) AS INTEGER) AS month,
  CAST(day(ts) AS INTEGER) AS day, CAST(hour(ts) AS INTEGER) AS hour, {r('avg(value)', 6)} AS calendar_mean
  FROM (SELECT series_id, CAST(ts AS TIMESTAMP) AS ts, value FROM daily) GROUP BY 1, 2, 3, 4""")
def a2(spark, folder):
    return render(impute.calendar_mean(tables.daily_shipments(spark, folder)), 6)


@query("a3_pre_period_calendar_mean", with_(DAY_FILLED_CHAIN) + f"""SELECT series_id,
  CAST(month(ts) AS INTEGER) AS month, CAST(day(ts) AS INTEGER) AS day, {r('avg(value)', 6)} AS calendar_mean
  FROM day_filled WHERE ts < TIMESTAMP '1998-01-01' GROUP BY 1, 2, 3""")
def a3(spark, folder):
    return render(impute.calendar_mean(tables.filled_shipments(spark, folder), ("month", "day"),
                                       before="1998-01-01 00:00:00"), 6)


@query("a4_distinct_hours", f"""SELECT event_type AS series_id, {txt('min(ts)')} AS ts FROM events
  GROUP BY event_type, date_trunc('hour', ts)""")
def a4(spark, folder):
    return render(grid.distinct_steps(tables.event_readings(spark, folder), "hour"))


@query("a5_mean_temperature", with_(STATION_ROWS) + f"""SELECT {txt("date_trunc('hour', ts)")} AS ts,
  {r('avg(value)', 10)} AS value FROM station_rows GROUP BY date_trunc('hour', ts)""")
def a5(spark, folder):
    return render(grid.bucket_mean(tables.station_readings(spark, folder), "hour", ()), 10)


@query("a6_missing_cells", with_(DENSE_CHAIN) + """SELECT count(*) AS row_count,
  count(*) - count(value) AS missing_cells, count(*) - count(value) AS rows_with_missing,
  count(*) - count(value) AS missing_value FROM dense""")
def a6(spark, folder):
    return impute.missing_audit(grid.complete(tables.hourly_events(spark, folder), "hour"), "value")


@query("a7_row_count", "SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1")
def a7(spark, folder):
    return tables.table(spark, folder, "lineitem").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"))


@query("a8_grand_mean", with_(DENSE_CHAIN) + f"SELECT {r('avg(value)')} AS mean_value FROM dense")
def a8(spark, folder):
    return render(grid.complete(tables.hourly_events(spark, folder), "hour").agg(
        F.avg("value").alias("mean_value")))


@query("a9_row_mean", with_(STATION_ROWS, STATION_HOURS, _STATION_GRID) + f"""SELECT {txt('ts')} AS ts,
  {r('(africa + america + asia + europe + middle_east) / 5')} AS mean_temp FROM joined""")
def a9(spark, folder):
    hours = station_hours(spark, folder)
    wide = weather.stations_on_grid(hours, grid.span(hours, ()), tables.STATIONS, "hour").toDF("ts", *_COLS)
    return render(wide.select("ts", row_mean(*_COLS).alias("mean_temp")))


@query("a10_daily_max", with_(FILLED_CHAIN) + f"""SELECT series_id, {txt('CAST(ts AS DATE)')} AS day,
  {r('max(value)')} AS top FROM filled GROUP BY 1, 2""")
def a10(spark, folder):
    return render(tables.filled_events(spark, folder).groupBy("series_id", F.to_date("ts").alias("day")).agg(
        F.max("value").alias("top")))
