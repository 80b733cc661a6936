"""Diagnostics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.catalogue.joins import _COLS, _STATION_GRID, station_hours
from tidegrid.catalogue.registry import (DAY_FILLED_CHAIN, FILLED_CHAIN, STATION_HOURS, STATION_ROWS, query, r,
                                         render, txt, with_)
from tidegrid.operators import diagnostics, grid, impute, weather
from tidegrid.sources import tables

_LAGS = 24
_ACF = f"""x AS (SELECT series_id, ts, value - avg(value) OVER (PARTITION BY series_id) AS x FROM filled),
numbered AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ts) AS p FROM x),
c0 AS (SELECT series_id, sum(x * x) AS c0, count(*) AS n FROM x GROUP BY 1),
acf AS (SELECT a.series_id, a_k.k AS lag, sum(a.x * b.x) / any_value(c0) AS acf, any_value(n) AS n
  FROM numbered a JOIN range(1, {_LAGS + 1}) a_k(k) ON true
  JOIN numbered b ON b.series_id = a.series_id AND b.p = a.p - a_k.k
  JOIN c0 ON c0.series_id = a.series_id GROUP BY 1, 2)"""
# Durbin-Levinson on lists, one recursion step per lag.
_PACF = f"""lists AS (SELECT series_id, list(acf ORDER BY lag) AS rho, any_value(n) AS n FROM acf GROUP BY 1),
dl AS (SELECT series_id, rho, n, 1 AS k, [rho[1]] AS phi FROM lists
  UNION ALL SELECT series_id, rho, n, k + 1, list_concat(
    list_transform(range(1, k + 1), lambda i: phi[i] - last * phi[k + 1 - i]), [last]) FROM (
    SELECT *, (rho[k + 1] - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * rho[k + 1 - i])))
      / (1 - list_sum(list_transform(range(1, k + 1), lambda i: phi[i] * rho[i]))) AS last FROM dl)
  WHERE k < {_LAGS})"""


def _recursive(*fragments):
    return "WITH RECURSIVE " + ",\n".join(fragments) + "\n"


@query("g1_autocorrelation", with_(FILLED_CHAIN, _ACF) + f"""SELECT series_id, CAST(lag AS INTEGER) AS lag,
  {r('acf')} AS acf FROM acf""")
def g1(spark, folder):
    return render(diagnostics.autocorrelation(tables.filled_events(spark, folder), _LAGS, "hour"))


@query("g2_partial_autocorrelation", _recursive(FILLED_CHAIN, _ACF, _PACF) + f"""SELECT series_id,
  CAST(k AS INTEGER) AS lag, {r('phi[k]')} AS pacf FROM dl""")
def g2(spark, folder):
    return render(diagnostics.partial_autocorrelation(tables.filled_events(spark, folder), _LAGS, "hour"))


def _kpss(source, name):
    """Level statistic in SQL, with 3 sqrt(n) / 13 Bartlett lags."""
    return f"""{name}_x AS (SELECT series_id, ts, v - avg(v) OVER (PARTITION BY series_id) AS x,
  row_number() OVER (PARTITION BY series_id ORDER BY ts) AS p FROM {source}),
{name}_n AS (SELECT series_id, count(*) AS n, greatest(1, floor(3 * sqrt(count(*)) / 13)) AS l, sum(x * x) AS c0
  FROM {name}_x GROUP BY 1),
{name}_w AS (SELECT series_id, sum(s * s) AS walk FROM (SELECT series_id, sum(x) OVER (PARTITION BY series_id
  ORDER BY ts) AS s FROM {name}_x) GROUP BY 1),
{name}_c AS (SELECT a.series_id, sum(a.x * b.x * (1 - (a.p - b.p) / (l + 1.0))) AS c FROM {name}_x a
  JOIN {name}_n USING (series_id) JOIN {name}_x b ON b.series_id = a.series_id AND b.p < a.p AND b.p >= a.p - l
  GROUP BY 1),
{name} AS (SELECT series_id, n, walk / (n * n) / ((c0 + 2 * c) / n) AS kpss FROM {name}_n JOIN {name}_w USING (series_id)
  JOIN {name}_c USING (series_id))"""


_LEVELS = "lv AS (SELECT series_id, ts, value AS v FROM day_filled)"
_FIRST_DIFF = """fd AS (SELECT * FROM (SELECT series_id, ts, v - lag(v) OVER (PARTITION BY series_id ORDER BY ts) AS v
  FROM lv) WHERE v IS NOT NULL)"""


@query("g3_difference_order", with_(DAY_FILLED_CHAIN, _LEVELS, _FIRST_DIFF, _kpss("lv", "k0"), _kpss("fd", "k1")) +
       """SELECT k0.series_id, CAST(CASE WHEN k0.kpss <= 0.463 THEN 0 WHEN k1.kpss <= 0.463 THEN 1 ELSE 2 END
  AS INTEGER) AS ndiffs FROM k0 JOIN k1 USING (series_id)""")
def g3(spark, folder):
    return diagnostics.difference_order(tables.filled_shipments(spark, folder), "day")


@query("g3_level_test", with_(DAY_FILLED_CHAIN, _LEVELS, _kpss("lv", "k0")) +
       f"SELECT series_id, n, {r('kpss')} AS kpss FROM k0")
def g3_level(spark, folder):
    return render(diagnostics.kpss_statistic(tables.filled_shipments(spark, folder), "day"))


@query("g4_seasonal_strength", with_(FILLED_CHAIN) + f""", t AS (SELECT series_id, ts, value,
  CASE WHEN count(*) OVER w = 25 THEN (sum(value) OVER w - (first_value(value) OVER w + last_value(value) OVER w) / 2)
  / 24 END AS trend FROM filled WINDOW w AS (PARTITION BY series_id ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
  d AS (SELECT series_id, hour(ts) AS hr, value - trend AS d FROM t WHERE trend IS NOT NULL),
  f AS (SELECT series_id, hr, avg(d) AS s FROM d GROUP BY 1, 2),
  g AS (SELECT series_id, hr, s - avg(s) OVER (PARTITION BY series_id) AS s FROM f),
  q AS (SELECT series_id, greatest(0, 1 - var_samp(d - s) / var_samp(d)) AS strength FROM d JOIN g USING (series_id, hr)
  GROUP BY 1) SELECT series_id, {r('strength')} AS strength, CAST(strength > 0.64 AS INTEGER) AS nsdiffs FROM q""")
def g4(spark, folder):
    return render(diagnostics.seasonal_strength(tables.filled_events(spark, folder), 24, "hour"))


@query("g5_residual_check", with_(FILLED_CHAIN, _ACF) + f""", q AS (SELECT series_id, any_value(n) AS n,
  any_value(n) * (any_value(n) + 2) * sum(acf * acf / (n - lag)) AS q FROM acf GROUP BY 1)
  SELECT series_id, n, {r('q')} AS q, {_LAGS} AS df, {r(f'''exp(-q / 2) * list_sum(list_transform(range(0, {_LAGS // 2}),
  lambda i: pow(q / 2, i) / gamma(i + 1)))''')} AS p_value FROM q""")
def g5(spark, folder):
    return render(diagnostics.ljung_box(tables.filled_events(spark, folder), _LAGS, "hour"))


@query("g6_residual_feed", _recursive(FILLED_CHAIN, _ACF, _PACF) + f"""SELECT acf.series_id,
  CAST(lag AS INTEGER) AS lag, {r('acf')} AS acf, {r('phi[k]')} AS pacf, {r('1.96 / sqrt(acf.n)')} AS "limit"
  FROM acf JOIN dl ON dl.series_id = acf.series_id AND dl.k = acf.lag""")
def g6(spark, folder):
    return render(diagnostics.residual_feed(tables.filled_events(spark, folder), _LAGS, "hour"))


_TEMPS = """temps AS (SELECT date_trunc('hour', ts) AS date, avg(value) AS temperature FROM station_rows GROUP BY 1),
joined_t AS (SELECT f.series_id, f.value, t.temperature FROM filled f LEFT JOIN temps t ON f.ts = t.date)"""


def _with_temperature(spark, folder):
    temps = grid.bucket_mean(tables.station_readings(spark, folder), "hour", ()).select(
        F.col("ts").alias("date"), F.col("value").alias("temperature"))
    return weather.join_hourly(tables.filled_events(spark, folder), temps, "date")


@query("g7_weather_relation", with_(FILLED_CHAIN, STATION_ROWS, _TEMPS) + f"""SELECT series_id,
  count(*) FILTER (temperature IS NOT NULL AND value IS NOT NULL) AS n, {r('corr(temperature, value)')} AS corr,
  {r('regr_slope(value, temperature)')} AS slope, {r('regr_intercept(value, temperature)', 7)} AS intercept,
  {r('regr_r2(value, temperature)')} AS r2 FROM joined_t GROUP BY 1""")
def g7(spark, folder):
    return render(diagnostics.relation(_with_temperature(spark, folder), "temperature", "value", ("series_id",)),
                  intercept=7)


@query("g7_weather_bins", with_(FILLED_CHAIN, STATION_ROWS, _TEMPS) + f"""SELECT series_id,
  CAST(floor(temperature / 5) AS BIGINT) AS bin, count(value) AS n, {r('avg(value)')} AS mean_value FROM joined_t
  WHERE temperature IS NOT NULL GROUP BY 1, 2""")
def g7_bins(spark, folder):
    return render(diagnostics.binned_mean(_with_temperature(spark, folder), "temperature", "value", 5.0, ("series_id",)))


@query("g8_missing_audit", with_(STATION_ROWS, STATION_HOURS, _STATION_GRID) + f"""SELECT count(*) AS row_count,
  CAST({' + '.join(f'(count(*) - count({c}))' for c in _COLS)} AS BIGINT) AS missing_cells,
  count(*) FILTER ({' OR '.join(f'{c} IS NULL' for c in _COLS)}) AS rows_with_missing,
  {', '.join(f'count(*) - count({c}) AS missing_{c}' for c in _COLS)} FROM joined""")
def g8(spark, folder):
    hours = station_hours(spark, folder)
    wide = weather.stations_on_grid(hours, grid.span(hours, ()), tables.STATIONS, "hour").toDF("ts", *_COLS)
    return impute.missing_audit(wide, *_COLS)
