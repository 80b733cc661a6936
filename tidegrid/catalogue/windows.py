"""Window and positional operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.catalogue.registry import (DAY_FILLED_CHAIN, DENSE_CHAIN, FILLED_CHAIN, STATION_ROWS, query, r,
                                         render, txt, with_)
from tidegrid.operators import grid, impute, lags, weather
from tidegrid.sources import tables

_HOUR_LAGS = {"l2": 48, "l3": 72, "l4": 96, "l5": 120, "l6": 144, "l7": 168, "l14": 336, "l21": 504}
_DAY_LAGS = {"w4": 28, "w8": 56, "w24": 168, "y1": 365, "y1_1a": 366, "y1_1b": 364, "y2": 730}
_OVER = "OVER (PARTITION BY series_id ORDER BY ts)"


def _lag_sql(lag_map, digits):
    return ", ".join(f"{r(f'coalesce(lag(value, {k}) {_OVER}, 0)', digits)} AS {n}" for n, k in lag_map.items())


@query("w1_zero_lag", with_(FILLED_CHAIN) + f"""SELECT series_id, {txt('ts')} AS ts, {r('value')} AS value,
  {_lag_sql(_HOUR_LAGS, 8)} FROM filled""")
def w1(spark, folder):
    return render(lags.add_lags(tables.filled_events(spark, folder), _HOUR_LAGS, "hour"))


@query("w1_yearly_lag", with_(DAY_FILLED_CHAIN) + f"""SELECT series_id, {txt('ts')} AS ts, {r('value', 6)} AS value,
  {_lag_sql(_DAY_LAGS, 6)} FROM day_filled""")
def w1_yearly(spark, folder):
    return render(lags.add_lags(tables.filled_shipments(spark, folder), _DAY_LAGS, "day"), 6)


@query("w2_weather_lag", with_(FILLED_CHAIN, STATION_ROWS) + f""", days AS (SELECT CAST(ts AS DATE) AS day,
  max(value) AS high FROM station_rows GROUP BY 1), joined AS (SELECT f.series_id, f.ts, d.high FROM filled f
  LEFT JOIN days d ON CAST(f.ts AS DATE) = d.day) SELECT series_id, {txt('ts')} AS ts, {r('high')} AS high,
  {r(f'lag(high, 24, 0.0) {_OVER}')} AS high_d1, {r(f'lag(high, 48, 0.0) {_OVER}')} AS high_d2 FROM joined""")
def w2(spark, folder):
    days = tables.station_readings(spark, folder).groupBy(F.to_date("ts").alias("day")).agg(
        F.max("value").alias("high"))
    rows = weather.join_daily(tables.filled_events(spark, folder), days, "day").select("series_id", "ts", "high")
    return render(lags.add_lags(rows, {"high_d1": 24, "high_d2": 48}, "hour", value="high"))


@query("w3_trend_index", with_(FILLED_CHAIN) + f"""SELECT series_id, {txt('ts')} AS ts,
  row_number() {_OVER} AS trend FROM filled""")
def w3(spark, folder):
    return render(grid.step_index(tables.filled_events(spark, folder), "hour").select("series_id", "ts", "trend"))


@query("w4_first_and_last", f"""SELECT event_type, {txt('ts')} AS ts, event_id, {r('value')} AS value FROM (
  SELECT *, row_number() OVER (PARTITION BY event_type, date_trunc('hour', ts) ORDER BY ts, event_id) AS a,
  count(*) OVER (PARTITION BY event_type, date_trunc('hour', ts)) AS n FROM events) WHERE a = 1 OR a = n""")
def w4(spark, folder):
    rows = tables.table(spark, folder, "events").select(
        "event_type", F.date_trunc("hour", "ts").alias("hour"), "ts", "event_id", "value")
    return render(grid.first_and_last(rows, ["event_type", "hour"], ["ts", "event_id"]).drop("hour"))


# The nearest two values on either side by ranks among the non-null rows.
_NEAR = """pos AS (SELECT series_id, ts, value, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS p,
  count(value) OVER (PARTITION BY series_id ORDER BY ts) AS k FROM dense),
pts AS (SELECT series_id, p, value, k FROM pos WHERE value IS NOT NULL),
near AS (SELECT pos.series_id, pos.ts, pts.value AS v, abs(pts.p - pos.p) AS d,
  row_number() OVER (PARTITION BY pos.series_id, pos.ts ORDER BY abs(pts.p - pos.p)) AS nth FROM pos
  JOIN pts ON pts.series_id = pos.series_id AND pts.k BETWEEN pos.k - 1 AND pos.k + 2 WHERE pos.value IS NULL),
radius AS (SELECT series_id, ts, d AS r FROM near WHERE nth = 2),
fill AS (SELECT n.series_id, n.ts, sum(n.v / (n.d + 1)) / sum(1.0 / (n.d + 1)) AS v FROM near n
  JOIN radius q ON q.series_id = n.series_id AND q.ts = n.ts AND n.d <= q.r GROUP BY 1, 2)"""


@query("w5_moving_average_fill", with_(DENSE_CHAIN, _NEAR) + f"""SELECT d.series_id, {txt('d.ts')} AS ts,
  {r('coalesce(d.value, f.v)')} AS value FROM dense d LEFT JOIN fill f ON f.series_id = d.series_id AND f.ts = d.ts""")
def w5(spark, folder):
    dense = grid.complete(tables.hourly_events(spark, folder), "hour")
    return render(impute.moving_average_fill(dense, ["value"]))


@query("w6_trailing_mean", with_(DAY_FILLED_CHAIN) + f"""SELECT series_id, {txt('ts')} AS ts,
  {r('CASE WHEN count(value) OVER w = 30 THEN avg(value) OVER w END', 6)} AS trailing FROM day_filled
  WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 29 PRECEDING AND CURRENT ROW)""")
def w6(spark, folder):
    return render(lags.trailing_mean(tables.filled_shipments(spark, folder), "trailing", 30, "day").drop("value"), 6)


@query("w7_centred_mean", with_(DAY_FILLED_CHAIN) + f"""SELECT series_id, {txt('ts')} AS ts,
  {r('''CASE WHEN count(value) OVER w = 31 THEN (sum(value) OVER w - (first_value(value) OVER w
  + last_value(value) OVER w) / 2) / 30 END''', 6)} AS centred FROM day_filled
  WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 15 PRECEDING AND 15 FOLLOWING)""")
def w7(spark, folder):
    return render(lags.centred_mean(tables.filled_shipments(spark, folder), "centred", 30, "day").drop("value"), 6)


@query("w8_sub_series", with_(DAY_FILLED_CHAIN) + f"""SELECT series_id, {txt('ts')} AS ts, {r('value', 6)} AS value
  FROM day_filled WHERE ts >= TIMESTAMP '1997-01-01' AND ts < TIMESTAMP '1998-01-01'""")
def w8(spark, folder):
    return render(grid.between(tables.filled_shipments(spark, folder), F.make_date(F.lit(1997), F.lit(1), F.lit(1)),
                               F.make_date(F.lit(1998), F.lit(1), F.lit(1))), 6)


@query("w9_differences", with_(FILLED_CHAIN) + f"""SELECT series_id, {txt('ts')} AS ts,
  {r(f'value - lag(value, 1) {_OVER}')} AS d1, {r(f'value - lag(value, 24) {_OVER}')} AS d24 FROM filled""")
def w9(spark, folder):
    return render(lags.add_differences(tables.filled_events(spark, folder), {"d1": 1, "d24": 24}, "hour").drop("value"))
