"""Scans, generated grids, sinks and chart feeds."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.catalogue.registry import (DAILY, DAY_FILLED_CHAIN, FILLED_CHAIN, HOURLY, STATION_HOURS,
                                         STATION_ROWS, query, r, render, txt, with_)
from tidegrid.operators import diagnostics, grid, lags, metrics, weather
from tidegrid.session import fresh_path
from tidegrid.sources import files, sinks, tables


def _land_load(spark, folder):
    """Event readings as a landed load file: text stamps to the minute."""
    path = fresh_path(spark, "load")
    rows = tables.event_readings(spark, folder).select(
        F.date_format("ts", "yyyy-MM-dd HH:mm").alias("Date"), F.col("value").alias("load"),
        F.col("series_id").alias("zone"))
    return sinks.write_csv(rows, path)


@query("s1_load_scan", f"""SELECT event_type AS series_id,
  {txt("date_trunc('minute', ts)")} AS ts, {r('value')} AS value FROM events""")
def s1(spark, folder):
    return render(files.read_load(spark, _land_load(spark, folder)))


@query("s2_daily_weather_scan", with_(STATION_ROWS) + f"""SELECT {txt("CAST(ts AS DATE)")} AS Date,
  {r("max(value) FILTER (station = 'ASIA')")} AS ASIA_High,
  {r("min(value) FILTER (station = 'ASIA')")} AS ASIA_Low,
  {r("max(value) FILTER (station = 'EUROPE')")} AS EUROPE_High,
  {r("min(value) FILTER (station = 'EUROPE')")} AS EUROPE_Low FROM station_rows GROUP BY 1""")
def s2(spark, folder):
    high_low = weather.daily_high_low(tables.station_readings(spark, folder), ["ASIA", "EUROPE"])
    landed = high_low.select(F.col("day").alias("Date"), *[
        F.col(f"{s}_{v.lower()}").alias(f"{s} -{v}") for s in ("ASIA", "EUROPE") for v in ("High", "Low")])
    path = sinks.write_csv(landed, fresh_path(spark, "weather"))
    return render(files.read_daily_weather(spark, path))


@query("s3_csv_scan", with_(HOURLY) + f"""SELECT {txt('ts')} AS date, {r('avg(value)')} AS mean_value
  FROM hourly GROUP BY ts""")
def s3(spark, folder):
    merged = tables.hourly_events(spark, folder).groupBy("ts").agg(F.avg("value").alias("Means"))
    landed = merged.select(F.lit(None).cast("int").alias("_c0"), F.col("ts").alias("date"), "Means")
    path = sinks.write_csv(landed.withColumn("date", F.date_format("date", "yyyy-MM-dd HH:mm:ss")),
                           fresh_path(spark, "merged"))
    back = files.read_csv(spark, path, files.MERGED_TEMPERATURE_SCHEMA)
    return render(back.select("date", F.col("Means").alias("mean_value")))


@query("s4_station_scan", with_(STATION_ROWS) + f"""SELECT station, {txt("date_trunc('second', ts)")} AS ts,
  {r('value')} AS tmpf FROM station_rows
  WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22'""")
def s4(spark, folder):
    rows = tables.station_readings(spark, folder).select(
        "station", F.date_trunc("second", "ts").alias("valid"), F.col("value").alias("tmpf"))
    path = sinks.write_stations(rows.withColumnRenamed("valid", "ts"), fresh_path(spark, "stations"))
    back = files.read_stations(spark, path, F.timestamp_seconds(F.lit(1704672000)),
                               F.timestamp_seconds(F.lit(1705881600)), columns=("tmpf",), ts="ts")
    return render(back.select("station", "ts", "tmpf"))


@query("s5_station_catalogue", """SELECT n_name AS code, r_name AS network, count(*) AS customers FROM customer
  JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'
  GROUP BY 1, 2""")
def s5(spark, folder):
    catalogue = tables.table(spark, folder, "nation").join(
        tables.table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        "n_nationkey", F.col("n_name").alias("code"), F.col("r_name").alias("network"))
    used = tables.table(spark, folder, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers"))
    return files.stations_of(catalogue, "ASIA").join(used, F.col("n_nationkey") == F.col("c_nationkey")).select(
        "code", "network", "customers")


@query("s6_hourly_grid", with_(HOURLY) + f"""SELECT series_id, {txt('ts')} AS ts FROM (
  SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts
  FROM hourly GROUP BY series_id)""")
def s6(spark, folder):
    return render(grid.grid_of(grid.span(tables.hourly_events(spark, folder)), "hour"))


@query("s7_grid_by_seconds", with_(HOURLY) + f"""SELECT series_id, {txt('ts')} AS ts FROM (
  SELECT series_id, unnest(generate_series(min(ts), max(ts), INTERVAL 3600 SECOND)) AS ts
  FROM hourly GROUP BY series_id)""")
def s7(spark, folder):
    return render(grid.grid_by_seconds(grid.span(tables.hourly_events(spark, folder)), 3600))


@query("s8_daily_grid", f"""SELECT series_id, {txt('CAST(ts AS DATE)')} AS day FROM (
  SELECT o_orderpriority AS series_id, unnest(generate_series(CAST(min(o_orderdate) AS TIMESTAMP),
    CAST(max(o_orderdate) AS TIMESTAMP), INTERVAL 1 DAY)) AS ts FROM orders GROUP BY 1)""")
def s8(spark, folder):
    days = grid.grid_of(grid.span(tables.order_readings(spark, folder)), "day")
    return render(days.select("series_id", F.to_date("ts").alias("day")))


@query("k1_cleaned_sink", with_(FILLED_CHAIN) + f"""SELECT series_id, {txt('ts')} AS ts,
  {r('value')} AS value FROM filled""")
def k1(spark, folder):
    path = sinks.write_series(tables.filled_events(spark, folder), fresh_path(spark, "cleaned"))
    return render(files.read_csv(spark, path, "series_id string, ts timestamp, value double"))


@query("k2_merged_weather_sink", with_(STATION_ROWS, STATION_HOURS) + f"""SELECT {txt('ts')} AS ts,
  {r('avg(value)')} AS mean_temp FROM station_hours GROUP BY station_hours.ts""")
def k2(spark, folder):
    hours = grid.bucket_mean(tables.station_readings(spark, folder), "hour", ("station",))
    merged = hours.groupBy("ts").agg(F.avg("value").alias("mean_temp")).orderBy("ts")
    path = sinks.write_csv(merged, fresh_path(spark, "temperature"))
    return render(files.read_csv(spark, path, "ts timestamp, mean_temp double"))


@query("k3_station_sink", with_(STATION_ROWS, STATION_HOURS) + f"""SELECT station, {txt('ts')} AS ts,
  {r('value')} AS tmpf FROM station_hours""")
def k3(spark, folder):
    hours = grid.bucket_mean(tables.station_readings(spark, folder), "hour", ("station",))
    path = sinks.write_stations(hours.withColumnRenamed("value", "tmpf"),
                                fresh_path(spark, "stations"), fmt="parquet")
    return render(spark.read.parquet(path).select("station", "ts", "tmpf"))


_NAIVE_WEEK = """naive AS (SELECT series_id, ts, value AS actual, lag(value, 7) OVER (
  PARTITION BY series_id ORDER BY ts) AS predicted FROM day_filled)"""


def weekly_naive(spark, folder):
    """Daily shipments against the value one week before."""
    return lags.add_lags(tables.filled_shipments(spark, folder), {"predicted": 7}, "day", pad=None).select(
        "series_id", "ts", F.col("value").alias("actual"), "predicted").where("predicted is not null")


def _month_scores(spark, folder):
    rows = weekly_naive(spark, folder).withColumns({
        "month": F.to_date(F.date_trunc("month", "ts")), "hour": F.dayofmonth("ts")})
    return metrics.daily_scores(rows, ("series_id", "month"))


_MONTH_SQL = with_(DAY_FILLED_CHAIN, _NAIVE_WEEK) + f"""SELECT series_id,
  {txt("CAST(date_trunc('month', ts) AS DATE)")} AS month, CAST(year(ts) AS INTEGER) AS year,
  {r('avg(abs(100 * (actual - predicted) / actual))', 6)} AS mape,
  {r('sqrt(avg((actual - predicted) * (actual - predicted)))', 6)} AS rmse
  FROM naive WHERE predicted IS NOT NULL GROUP BY 1, 2, 3"""


@query("k4_metrics_sink", _MONTH_SQL)
def k4(spark, folder):
    scores = _month_scores(spark, folder).select("series_id", "month", "mape", "rmse", "peak")
    path = sinks.write_by_year(scores, fresh_path(spark, "metrics"), "month")
    back = files.read_csv(spark, path, "series_id string, month date, mape double, rmse double, "
                                       "peak string, year int")
    return render(back.select("series_id", "month", "year", "mape", "rmse"), 6)


@query("k5_prediction_log_sink", with_(DAY_FILLED_CHAIN, _NAIVE_WEEK) + f"""SELECT series_id,
  {txt('ts')} AS ts, CAST(year(ts) AS INTEGER) AS year, {r('actual', 6)} AS load,
  {r('predicted', 6)} AS predict FROM naive WHERE predicted IS NOT NULL""")
def k5(spark, folder):
    log = weekly_naive(spark, folder).select(
        "series_id", "ts", F.col("actual").alias("load"), F.col("predicted").alias("predict"))
    path = sinks.write_by_year(log, fresh_path(spark, "log"), "ts", fmt="parquet")
    return render(spark.read.parquet(path).select(
        "series_id", "ts", F.col("year").cast("int").alias("year"), "load", "predict"), 6)


@query("k6_side_by_side_feed", with_(DAY_FILLED_CHAIN, _NAIVE_WEEK) + f"""SELECT series_id,
  {txt('ts')} AS ts, {r('actual', 6)} AS load, {r('predicted', 6)} AS predict FROM naive
  WHERE predicted IS NOT NULL AND ts >= TIMESTAMP '1998-01-01' AND ts < TIMESTAMP '1999-01-01'""")
def k6(spark, folder):
    log = weekly_naive(spark, folder)
    year = grid.between(log, F.make_date(F.lit(1998), F.lit(1), F.lit(1)),
                        F.make_date(F.lit(1999), F.lit(1), F.lit(1)))
    stamps = grid.grid_of(grid.span(year), "day")
    return render(grid.on_grid(stamps, year).select(
        "series_id", "ts", F.col("actual").alias("load"), F.col("predicted").alias("predict")), 6)


@query("k7_threshold_feed", f"""SELECT *, CAST(mape > 2 AS INTEGER) AS over_threshold FROM ({_MONTH_SQL})""")
def k7(spark, folder):
    scores = _month_scores(spark, folder).select(
        "series_id", "month", F.year("month").alias("year"), "mape", "rmse")
    return render(metrics.over_threshold(scores), 6)


@query("k8_scatter_feed", f"""SELECT CAST(floor(l_quantity) AS BIGINT) AS bin, count(*) AS n,
  {r('avg(l_extendedprice)', 4)} AS mean_value FROM lineitem GROUP BY 1""")
def k8(spark, folder):
    rows = tables.table(spark, folder, "lineitem")
    return render(diagnostics.binned_mean(rows, "l_quantity", "l_extendedprice"), 4)


@query("k9_raw_slice_feed", with_(DAILY) + f"""SELECT series_id, {txt('CAST(ts AS TIMESTAMP)')} AS ts,
  {r('value')} AS value FROM (SELECT *, min(ts) OVER (PARTITION BY series_id) AS t0 FROM daily)
  WHERE ts < t0 + INTERVAL 60 DAY""")
def k9(spark, folder):
    rows = tables.daily_shipments(spark, folder)
    start = grid.span(rows).select("series_id", "first_ts")
    first = rows.join(start, "series_id").where(F.col("ts") < F.col("first_ts") + F.expr("interval 60 day"))
    return render(first.drop("first_ts").orderBy("series_id", "ts"))
