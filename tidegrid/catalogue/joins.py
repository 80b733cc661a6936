"""Joins, including the backtest loop as data."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.catalogue.registry import (DAY_FILLED_CHAIN, DENSE_CHAIN, FILLED_CHAIN,
                                         STATION_HOURS, STATION_ROWS, query, r, render, txt, with_)
from tidegrid.operators import grid, impute, lags, weather, windows
from tidegrid.plans import backtest as bt
from tidegrid.sources import tables

# Small set-ups that fit the one-month hourly table and the seven-year daily table.
HOURLY_SPEC = bt.Backtest(train=14 * 24 + 8, valid=32)
EXPANDING_SPEC = bt.Backtest(train=14 * 24 + 8, expanding=True)
DAILY_SPEC = bt.Backtest(train=365, horizon=14, score_from=1, every=7, step="day")

# The same origins in SQL: midnight D, training up to 07:00 of D-1.
ORIGINS = """bounds AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM filled GROUP BY 1),
origins AS (SELECT series_id, origin, origin - INTERVAL 360 HOUR AS train_start,
  origin - INTERVAL 17 HOUR AS train_end, origin + INTERVAL 23 HOUR AS horizon_end FROM (
  SELECT series_id, lo, hi, unnest(generate_series(date_trunc('day', lo), hi, INTERVAL 1 DAY)) AS origin
  FROM bounds) WHERE origin - INTERVAL 360 HOUR >= lo AND origin + INTERVAL 23 HOUR <= hi)"""
# 7-day steps counted from the epoch, training on the 365 days before the origin.
DAY_ORIGINS = """day_bounds AS (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM day_filled GROUP BY 1),
day_origins AS (SELECT series_id, origin, origin - INTERVAL 365 DAY AS train_start,
  origin - INTERVAL 1 DAY AS train_end FROM (SELECT series_id, lo, hi,
  unnest(generate_series(TIMESTAMP '1970-01-01', hi, INTERVAL 7 DAY)) AS origin FROM day_bounds)
  WHERE origin - INTERVAL 365 DAY >= lo AND origin + INTERVAL 13 DAY <= hi)"""


@query("j1_grid_left_join", with_(DENSE_CHAIN) + f"""SELECT series_id, {txt('ts')} AS ts, {r('value')} AS value
  FROM dense""")
def j1(spark, folder):
    return render(grid.complete(tables.hourly_events(spark, folder), "hour"))


@query("j2_calendar_fill", with_(DAY_FILLED_CHAIN) + f"""SELECT series_id, {txt('ts')} AS ts,
  {r('value', 6)} AS value, fill_source FROM day_filled""")
def j2(spark, folder):
    dense = grid.complete(tables.daily_shipments(spark, folder), "day", mark=True)
    return render(impute.calendar_fill(dense, ("month", "day"), source=True).select(
        "series_id", "ts", "value", "fill_source"), 6)


@query("j3_hourly_weather_join", with_(FILLED_CHAIN, STATION_ROWS) + f""", temps AS (
  SELECT date_trunc('hour', ts) AS date, avg(value) AS temperature FROM station_rows GROUP BY 1)
  SELECT f.series_id, {txt('f.ts')} AS ts, {r('f.value', 10)} AS value, {r('t.temperature', 10)} AS temperature
  FROM filled f LEFT JOIN temps t ON f.ts = t.date""")
def j3(spark, folder):
    temps = grid.bucket_mean(tables.station_readings(spark, folder), "hour", ()).select(
        F.col("ts").alias("date"), F.col("value").alias("temperature"))
    return render(weather.join_hourly(tables.filled_events(spark, folder), temps, "date"), 10)


@query("j4_daily_weather_join", with_(FILLED_CHAIN, STATION_ROWS) + f""", days AS (
  SELECT CAST(ts AS DATE) AS day, max(value) AS high, min(value) AS low FROM station_rows GROUP BY 1)
  SELECT f.series_id, {txt('f.ts')} AS ts, {r('f.value')} AS value, {r('d.high')} AS high,
  {r('d.low')} AS low FROM filled f LEFT JOIN days d ON CAST(f.ts AS DATE) = d.day""")
def j4(spark, folder):
    days = tables.station_readings(spark, folder).groupBy(F.to_date("ts").alias("day")).agg(
        F.max("value").alias("high"), F.min("value").alias("low"))
    return render(weather.join_daily(tables.filled_events(spark, folder), days, "day").select(
        "series_id", "ts", "value", "high", "low"))


_STATION_GRID = """station_grid AS (SELECT unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts
  FROM station_hours),
joined AS (SELECT g.ts, a.value AS africa, b.value AS america, c.value AS asia, d.value AS europe,
  e.value AS middle_east FROM station_grid g
  LEFT JOIN station_hours a ON a.ts = g.ts AND a.station = 'AFRICA'
  LEFT JOIN station_hours b ON b.ts = g.ts AND b.station = 'AMERICA'
  LEFT JOIN station_hours c ON c.ts = g.ts AND c.station = 'ASIA'
  LEFT JOIN station_hours d ON d.ts = g.ts AND d.station = 'EUROPE'
  LEFT JOIN station_hours e ON e.ts = g.ts AND e.station = 'MIDDLE EAST')"""
_COLS = ("africa", "america", "asia", "europe", "middle_east")
_STATION_SQL = ", ".join(f"{r(c)} AS {c}" for c in _COLS)


def station_hours(spark, folder):
    return grid.bucket_mean(tables.station_readings(spark, folder), "hour", ("station",))


@query("j5_station_pivot", with_(STATION_ROWS, STATION_HOURS, _STATION_GRID) +
       f"SELECT {txt('ts')} AS ts, {_STATION_SQL} FROM joined")
def j5(spark, folder):
    hours = station_hours(spark, folder)
    wide = weather.stations_on_grid(hours, grid.span(hours, ()), tables.STATIONS, "hour")
    return render(wide.toDF("ts", *_COLS))


@query("j5_station_join_chain", with_(STATION_ROWS, STATION_HOURS, _STATION_GRID) +
       f"SELECT {txt('ts')} AS ts, {_STATION_SQL} FROM joined")
def j5_chain(spark, folder):
    hours = station_hours(spark, folder)
    wide = weather.stations_wide_by_joins(hours, grid.span(hours, ()), tables.STATIONS, "hour")
    return render(wide.toDF("ts", *_COLS))


_FILL_STATION = ",\n".join(f"""fill_{c} AS (SELECT hour(ts) AS hr, avg({c}) AS m FROM joined GROUP BY 1)"""
                           for c in _COLS)


@query("j5_filled_station_mean", with_(STATION_ROWS, STATION_HOURS, _STATION_GRID, _FILL_STATION) + f"""SELECT
  {txt('ts')} AS ts, {', '.join(f"{r(f'coalesce(j.{c}, f{i}.m)')} AS {c}" for i, c in enumerate(_COLS))},
  {r('(' + ' + '.join(f'coalesce(j.{c}, f{i}.m)' for i, c in enumerate(_COLS)) + ') / 5')} AS mean_temp
  FROM joined j {' '.join(f'JOIN fill_{c} f{i} ON f{i}.hr = hour(j.ts)' for i, c in enumerate(_COLS))}""")
def j5_filled(spark, folder):
    hours = station_hours(spark, folder)
    wide = weather.stations_on_grid(hours, grid.span(hours, ()), tables.STATIONS, "hour")
    return render(weather.filled_station_mean(wide, tables.STATIONS, ("hour",)).toDF(
        "ts", *_COLS, "mean_temp"))


@query("j6_pre_period_mean_join", with_(DAY_FILLED_CHAIN) + f""", pre AS (SELECT series_id, month(ts) AS mo,
  day(ts) AS dy, avg(value) AS m FROM day_filled WHERE ts < TIMESTAMP '1998-01-01' GROUP BY 1, 2, 3)
  SELECT f.series_id, {txt('f.ts')} AS ts, {r('f.value', 6)} AS value, {r('p.m', 6)} AS calendar_mean
  FROM day_filled f LEFT JOIN pre p ON p.series_id = f.series_id AND p.mo = month(f.ts) AND p.dy = day(f.ts)""")
def j6(spark, folder):
    rows = tables.filled_shipments(spark, folder)
    means = impute.calendar_mean(rows, ("month", "day"), before="1998-01-01 00:00:00")
    return render(impute.with_calendar_mean(rows, means, ("month", "day")).select(
        "series_id", "ts", "value", "calendar_mean"), 6)


def window_means(rows, spec, edges=False):
    """Rows, mean and, with ``edges``, first and last stamp of each origin's training window."""
    sums = windows.window_sums(rows, spec, {"n": F.lit(1), "total": F.col("value"), "known": F.col("value").isNotNull()})
    out = sums.select("series_id", "origin", F.col("n").cast("long").alias("n"), (F.col("total") / F.col("known")).alias("mean_value"))
    return out.join(windows.window_edges(rows, spec), ["series_id", "origin"]) if edges else out


@query("j7_origin_training_rows", with_(FILLED_CHAIN, ORIGINS) + f"""SELECT o.series_id, {txt('o.origin')} AS origin,
  count(*) AS n, {r('avg(f.value)')} AS mean_value, {txt('min(f.ts)')} AS first_ts, {txt('max(f.ts)')} AS last_ts
  FROM origins o JOIN filled f ON f.series_id = o.series_id AND f.ts BETWEEN o.train_start AND o.train_end
  GROUP BY 1, 2""")
def j7(spark, folder):
    return render(window_means(tables.filled_events(spark, folder), HOURLY_SPEC, edges=True))


@query("j8_origin_horizon_rows", with_(FILLED_CHAIN, ORIGINS) + f"""SELECT o.series_id, {txt('o.origin')} AS origin,
  CAST(date_diff('hour', o.origin, f.ts) + 17 AS INTEGER) AS step, {txt('f.ts')} AS ts, {r('f.value')} AS value
  FROM origins o JOIN filled f ON f.series_id = o.series_id AND f.ts > o.train_end AND f.ts <= o.horizon_end""")
def j8(spark, folder):
    return render(bt.horizon_rows(tables.filled_events(spark, folder), HOURLY_SPEC).select(
        "series_id", "origin", "step", "ts", "value"))


@query("j9_lag_by_join", with_(FILLED_CHAIN) + f"""SELECT series_id, {txt('ts')} AS ts, {r('value')} AS value,
  {r('coalesce(lag(value, 48) OVER (PARTITION BY series_id ORDER BY ts), 0)')} AS l2 FROM filled""")
def j9(spark, folder):
    return render(lags.lag_by_join(tables.filled_events(spark, folder), "l2", 48, "hour"))
