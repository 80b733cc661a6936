"""Backtest frames and evaluation."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from tidegrid.catalogue.joins import (DAILY_SPEC, DAY_ORIGINS, EXPANDING_SPEC, HOURLY_SPEC, ORIGINS, window_means)
from tidegrid.catalogue.registry import DAY_FILLED_CHAIN, FILLED_CHAIN, query, r, render, txt, with_
from tidegrid.operators import lags, metrics, windows
from tidegrid.plans import backtest as bt
from tidegrid.sources import tables

_IN_TRAIN = "f.series_id = o.series_id AND f.ts BETWEEN o.train_start AND o.train_end"


@query("b1_year_anchors", """SELECT CAST(y AS INTEGER) AS year, count(o_orderkey) AS orders_in_year,
  date_diff('day', DATE '1995-01-01', make_date(y, 1, 1)) * 24 + 1 AS anchor
  FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders) LEFT JOIN orders ON year(o_orderdate) = y GROUP BY y""")
def b1(spark, folder):
    years = tables.table(spark, folder, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count(F.lit(1)).alias("orders_in_year"))
    return years.select("year", "orders_in_year", bt.year_anchor(F.col("year"), 1995).alias("anchor"))


@query("b2_origin_list", with_(FILLED_CHAIN, ORIGINS) + f"""SELECT series_id, {txt('origin')} AS origin,
  {txt('train_start')} AS train_start, {txt('train_end')} AS train_end, {txt('horizon_end')} AS horizon_end
  FROM origins""")
def b2(spark, folder):
    return render(bt.origin_list(tables.filled_events(spark, folder), HOURLY_SPEC))


@query("b3_rolling_window", with_(DAY_FILLED_CHAIN, DAY_ORIGINS) + f"""SELECT o.series_id, {txt('o.origin')} AS origin,
  count(*) AS n, {r('avg(f.value)')} AS mean_value, {txt('min(f.ts)')} AS first_ts, {txt('max(f.ts)')} AS last_ts
  FROM day_origins o JOIN day_filled f ON {_IN_TRAIN} GROUP BY 1, 2""")
def b3(spark, folder):
    return render(window_means(tables.filled_shipments(spark, folder), DAILY_SPEC, edges=True))


@query("b4_expanding_window", with_(FILLED_CHAIN, ORIGINS) + f""", firsts AS (SELECT series_id,
  min(train_start) AS train_start FROM origins GROUP BY 1) SELECT o.series_id, {txt('o.origin')} AS origin,
  count(*) AS n, {r('avg(f.value)')} AS mean_value FROM origins o JOIN firsts s ON s.series_id = o.series_id
  JOIN filled f ON f.series_id = o.series_id AND f.ts BETWEEN s.train_start AND o.train_end GROUP BY 1, 2""")
def b4(spark, folder):
    return render(window_means(tables.filled_events(spark, folder), EXPANDING_SPEC))


@query("b5_validation_tail", with_(FILLED_CHAIN, ORIGINS) + f"""SELECT o.series_id, {txt('o.origin')} AS origin,
  CAST(f.ts > o.train_end - INTERVAL 32 HOUR AS INTEGER) AS is_valid, count(*) AS n,
  {r('avg(f.value)', 10)} AS mean_value FROM origins o JOIN filled f ON {_IN_TRAIN} GROUP BY 1, 2, 3""")
def b5(spark, folder):
    # The tail is a short window of its own; the head is what the whole window has besides it.
    rows = tables.filled_events(spark, folder)
    figures = {"n": F.lit(1), "total": F.col("value")}
    whole, tail = (windows.window_sums(rows, replace(HOURLY_SPEC, train=t), figures) for t in (HOURLY_SPEC.train, HOURLY_SPEC.valid))
    tail = tail.select("series_id", "origin", F.col("n").alias("tail_n"), F.col("total").alias("tail_total"))
    parts = whole.join(tail, ["series_id", "origin"]).select("series_id", "origin", F.explode(F.array(
        F.struct(F.lit(True).alias("is_valid"), F.col("tail_n").alias("n"), F.col("tail_total").alias("total")),
        F.struct(F.lit(False).alias("is_valid"), (F.col("n") - F.col("tail_n")).alias("n"), (F.col("total") - F.col("tail_total")).alias("total")))).alias("p"))
    return render(parts.select("series_id", "origin", "p.is_valid", F.col("p.n").cast("long").alias("n"), (F.col("p.total") / F.col("p.n")).alias("mean_value")), 10)


@query("b6_scored_steps", with_(FILLED_CHAIN, ORIGINS) + f"""SELECT o.series_id, {txt('o.origin')} AS origin,
  CAST(date_diff('hour', o.origin, f.ts) + 17 AS INTEGER) AS step, {r('f.value')} AS value FROM origins o
  JOIN filled f ON f.series_id = o.series_id AND f.ts >= o.origin AND f.ts <= o.horizon_end""")
def b6(spark, folder):
    rows = bt.horizon_rows(tables.filled_events(spark, folder), HOURLY_SPEC, scored_only=True)
    return render(rows.select("series_id", "origin", "step", "value"))


@query("b7_single_holdout", with_(FILLED_CHAIN, ORIGINS) + f"""SELECT o.series_id, {txt('o.origin')} AS origin,
  count(*) AS n, {r('avg(f.value)')} AS mean_value FROM origins o JOIN filled f ON {_IN_TRAIN}
  WHERE o.origin = TIMESTAMP '2024-01-20' GROUP BY 1, 2""")
def b7(spark, folder):
    spec = bt.Backtest(train=HOURLY_SPEC.train, first="2024-01-20", last="2024-01-20")
    rows = bt.training_rows(tables.filled_events(spark, folder), spec)
    return render(rows.groupBy("series_id", "origin").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value")))


# Seasonal naive forecasts: the value 48 hours before, scored by day.
_NAIVE = """naive AS (SELECT * FROM (SELECT series_id, ts, CAST(ts AS DATE) AS day, hour(ts) AS hr, value AS actual,
  lag(value, 48) OVER (PARTITION BY series_id ORDER BY ts) AS predicted FROM filled) WHERE predicted IS NOT NULL)"""
_ERRORS = f"""{r('avg(actual - predicted)', 6)} AS me,
  {r('sqrt(avg((actual - predicted) * (actual - predicted)))', 6)} AS rmse,
  {r('avg(abs(actual - predicted))', 6)} AS mae, {r('avg(100 * (actual - predicted) / nullif(actual, 0))', 6)} AS mpe,
  {r('avg(abs(100 * (actual - predicted) / nullif(actual, 0)))', 6)} AS mape"""
_PEAKS = """tops AS (SELECT *, max(actual) OVER d AS top_a, max(predicted) OVER d AS top_p FROM naive
  WINDOW d AS (PARTITION BY series_id, day)),
peaks AS (SELECT series_id, day,
  list_sort(list(hr) FILTER (actual = top_a)) AS pa, list_sort(list(hr) FILTER (predicted = top_p)) AS pp,
  array_to_string(list_sort(list(hr) FILTER (actual = top_a)), ' ') AS peak,
  array_to_string(list_sort(list(hr) FILTER (predicted = top_p)), ' ') AS peak_pred FROM tops GROUP BY 1, 2)"""


def naive(spark, folder):
    rows = lags.add_lags(tables.filled_events(spark, folder), {"predicted": 48}, "hour", pad=None)
    return rows.where("predicted is not null").select(
        "series_id", "ts", F.to_date("ts").alias("day"), F.hour("ts").alias("hour"),
        F.col("value").alias("actual"), "predicted")


@query("e1_error_set", with_(FILLED_CHAIN, _NAIVE) + f"""SELECT series_id, {txt('day')} AS day, {_ERRORS}
  FROM naive GROUP BY 1, 2""")
def e1(spark, folder):
    return render(metrics.errors(naive(spark, folder), ["series_id", "day"]), 6)


@query("e1_error_set_by_prediction", with_(FILLED_CHAIN, _NAIVE) + f"""SELECT series_id, {txt('day')} AS day,
  {r('avg(predicted - actual)', 6)} AS me, {r('sqrt(avg((actual - predicted) * (actual - predicted)))', 6)} AS rmse,
  {r('avg(abs(actual - predicted))', 6)} AS mae, {r('avg(100 * (predicted - actual) / nullif(predicted, 0))', 6)} AS mpe,
  {r('avg(abs(100 * (predicted - actual) / nullif(predicted, 0)))', 6)} AS mape FROM naive GROUP BY 1, 2""")
def e1_pred(spark, folder):
    return render(metrics.errors(naive(spark, folder), ["series_id", "day"], denominator="predicted"), 6)


@query("e2_named_errors", with_(FILLED_CHAIN, _NAIVE) + f"""SELECT series_id,
  {r('sqrt(avg((actual - predicted) * (actual - predicted)))', 6)} AS rmse,
  {r('avg(abs(100 * (actual - predicted) / nullif(actual, 0)))', 6)} AS mape FROM naive GROUP BY 1""")
def e2(spark, folder):
    return render(metrics.errors(naive(spark, folder), ["series_id"]).select("series_id", "rmse", "mape"), 6)


@query("e3_daily_peaks", with_(FILLED_CHAIN, _NAIVE, _PEAKS) + f"""SELECT series_id, {txt('day')} AS day, peak,
  peak_pred FROM peaks""")
def e3(spark, folder):
    return render(metrics.daily_scores(naive(spark, folder)).select("series_id", "day", "peak", "peak_pred"))


@query("e4_peak_hits", with_(FILLED_CHAIN, _NAIVE, _PEAKS) + f"""SELECT series_id, {txt('day')} AS day,
  CAST(peak = peak_pred AS INTEGER) AS hit_exact, CAST(list_has_any(pa, pp) AS INTEGER) AS hit_any,
  CAST(abs(pa[1] - pp[1]) <= 1 AS INTEGER) AS hit_near, CAST(len(pa) > 1 AS INTEGER) AS tied FROM peaks""")
def e4(spark, folder):
    scores = metrics.with_peak_hits(metrics.daily_scores(naive(spark, folder)))
    return render(scores.select("series_id", "day", "hit_exact", "hit_any", "hit_near", "tied"))


# One week naive forecasts of the daily table, scored by month and year.
_WEEK = """week AS (SELECT * FROM (SELECT series_id, ts, value AS actual, lag(value, 7) OVER (
  PARTITION BY series_id ORDER BY ts) AS predicted FROM day_filled) WHERE predicted IS NOT NULL),
months AS (SELECT series_id, year(ts) AS yr, month(ts) AS mo,
  avg(abs(100 * (actual - predicted) / nullif(actual, 0))) AS mape,
  sqrt(avg((actual - predicted) * (actual - predicted))) AS rmse FROM week GROUP BY 1, 2, 3)"""


def _months(spark, folder):
    rows = lags.add_lags(tables.filled_shipments(spark, folder), {"predicted": 7}, "day", pad=None).where(
        "predicted is not null").withColumns({"actual": F.col("value"), "month": F.date_trunc("month", "ts")})
    return metrics.errors(rows, ["series_id", "month"]).withColumn("year", F.year("month"))


@query("e5_yearly_means", with_(DAY_FILLED_CHAIN, _WEEK) + f"""SELECT CAST(yr AS INTEGER) AS year, count(*) AS days,
  {r('avg(mape)', 6)} AS mean_mape, {r('avg(rmse)', 6)} AS mean_rmse FROM months GROUP BY 1""")
def e5(spark, folder):
    return render(metrics.yearly_summary(_months(spark, folder)).drop("days_under_threshold"), 6)


@query("e6_days_under_threshold", with_(FILLED_CHAIN, _NAIVE) + f""", days AS (SELECT series_id, day,
  avg(abs(100 * (actual - predicted) / nullif(actual, 0))) AS mape FROM naive GROUP BY 1, 2)
  SELECT series_id, count(*) AS days, count(*) FILTER (mape <= 100) AS days_under_threshold FROM days GROUP BY 1""")
def e6(spark, folder):
    scores = metrics.daily_scores(naive(spark, folder))
    return metrics.yearly_summary(scores, ("series_id",), threshold=100.0).select(
        "series_id", "days", "days_under_threshold")


_DAY_RESULT = with_(FILLED_CHAIN, _NAIVE, _PEAKS) + f"""SELECT n.series_id, {txt('n.day')} AS day,
  {_ERRORS}, any_value(peak) AS peak, any_value(peak_pred) AS peak_pred FROM naive n
  JOIN peaks p ON p.series_id = n.series_id AND p.day = n.day GROUP BY 1, 2"""


@query("b8_daily_result_rows", _DAY_RESULT)
def b8(spark, folder):
    return e7(spark, folder)


@query("e7_seasonal_naive", _DAY_RESULT)
def e7(spark, folder):
    return render(metrics.daily_scores(naive(spark, folder)).drop("peaks", "peaks_pred"), 6)
