"""The four end-to-end jobs: clean, merge weather, boosted backtest, smoothing backtests."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators import boosted, ets, grid, impute, smoothing, weather
from tidegrid.operators.features import FINAL_FEATURES, final_frame
from tidegrid.plans import published
from tidegrid.plans.backtest import PUBLISHED, Backtest
from tidegrid.sources import sinks

# Residual orders of the final model.
FINAL_ORDER, FINAL_SEASONAL = (1, 0, 1), (1, 0, 0)


def clean_load(readings: DataFrame, temperature: DataFrame | None = None, step: str = "hour",
               parts=impute.CALENDAR, keys=("series_id",)) -> DataFrame:
    """Readings (keys, ts, value) -> one row per step without gaps, with the hourly
    temperature (ts, temperature) joined if given."""
    once = grid.collapse_duplicates(readings, (*keys, "ts"))
    filled = impute.calendar_fill(grid.complete(once, step, keys, mark=True), parts, keys=keys)
    if temperature is None:
        return filled
    mean = grid.collapse_duplicates(temperature, ("ts",), "temperature")
    return filled.join(mean, "ts", "left").select(*filled.columns, "temperature")


def merge_weather(readings: DataFrame, stations, columns=("tmpf",), value: str = "tmpf", step: str = "hour",
                  parts=impute.CALENDAR) -> DataFrame:
    """Station readings (station, ts, columns) -> (ts, <station> ..., mean_temp) on a
    full grid: gaps between readings by moving average, hours by mean, empty hours by
    calendar mean, then the mean across stations."""
    filled = impute.moving_average_fill(readings.select("station", "ts", *columns), list(columns), key="station")
    hours = grid.bucket_mean(filled.select("station", "ts", F.col(value).alias("value")), step, ("station",),
                             skip_null=True)
    wide = weather.stations_on_grid(hours, grid.span(hours, ()), stations, step)
    return weather.filled_station_mean(wide, stations, parts)


def boosted_year(frame: DataFrame, year: int, spec: Backtest = PUBLISHED["boosted_three_years"],
                 boosting: boosted.Boosting = boosted.Boosting(), features=FINAL_FEATURES,
                 keys=("series_id",)) -> tuple[DataFrame, DataFrame]:
    """(daily metrics, hourly prediction log) of one year of origins. Percent errors
    are relative to the prediction, as in the published daily metrics."""
    limits = replace(spec, first=f"{year}-01-01", last=f"{year}-12-31")
    out, _ = boosted.boosted_backtest(frame, features, limits, boosting, FINAL_ORDER, FINAL_SEASONAL, keys=keys)
    metrics = published.score_days(out, limits, keys, denominator="predicted").select(
        *keys, "day", "mape", "rmse", "peak", "peak_pred")
    log = out.where(F.col("step") >= limits.score_from).select(
        *keys, "ts", F.col("actual").alias("load"), F.col("predicted").alias("predict"))
    return metrics, log


def boosted_years(load: DataFrame, daily_weather: DataFrame, day: str, years, out: str, keys=("series_id",),
                  **options) -> tuple[str, str]:
    """The final model over several years: features stored once, then metrics and
    logs written below ``out``, one folder per year."""
    frame = boosted.store_features(final_frame(weather.join_daily(load, daily_weather, day), keys))
    results = [boosted_year(frame, y, keys=keys, **options) for y in years]
    metrics = reduce(DataFrame.unionByName, [m for m, _ in results])
    logs = reduce(DataFrame.unionByName, [g for _, g in results])
    return (sinks.write_by_year(metrics, f"{out}/metrics", "day"),
            sinks.write_by_year(logs, f"{out}/prediction_log", "ts"))


def smoothing_backtests(frame: DataFrame, spec: Backtest = PUBLISHED["smoothing_year"],
                        alpha: float = 0.1, keys=("series_id",)) -> dict[str, DataFrame]:
    """Daily scores of smoothing, smoothing with regression on its errors, and damped
    trend smoothing on Box-Cox values. ``frame`` holds the smoothing formula's columns."""
    plan = replace(published.REGRESSIONS["smoothing_layer"], backtest=spec, smoothing=alpha)
    series = frame.select(*keys, "ts", "value")
    forecasts = {
        "smoothing": smoothing.smoothing_forecast(series, spec, alpha, keys),
        "smoothing_layer": published.run_regression(frame, plan, keys),
        "damped_trend": ets.ets_forecast(series, spec, ("AAdN",), lam="auto", keys=keys),
    }
    return {n: published.score_days(f, spec, keys) for n, f in forecasts.items()}
