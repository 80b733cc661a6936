"""Autocorrelation, difference tests, residual checks and relations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.special import chi_square_tail
from tidegrid.operators.blocks import BLOCK, STEP_SECONDS, add_framed, block_window, epoch
from tidegrid.operators.lags import add_differences, centred_mean

KPSS_5_PERCENT = 0.463        # Fixed value: critical value of the level test.
SEASONAL_STRENGTH = 0.64      # Fixed value: strength that asks for a seasonal difference.


def centred(df: DataFrame, value: str = "value", keys=("series_id",)) -> DataFrame:
    """Adds ``_x``, the value minus the mean of its series."""
    means = df.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    return df.join(means, list(keys)).withColumn("_x", F.col(value) - F.col("_mean")).drop("_mean")


def autocovariance_sums(df: DataFrame, max_lag: int, step: str, value: str = "value",
                        keys=("series_id",)) -> DataFrame:
    """One row per series: n, and sums of x_t * x_(t-k) for k = 0 .. max_lag as an
    array. Lags look back over haloed blocks; the sums combine before the shuffle."""
    w = block_window(*keys)
    x = centred(df, value, keys).select(*keys, "ts", "_x")
    lagged = add_framed(x, {f"_l{k}": F.lag("_x", k).over(w) for k in range(1, max_lag + 1)}, step, keys,
                        before=max_lag)
    sums = [F.sum(F.col("_x") * F.col("_x"))] + [
        F.coalesce(F.sum(F.col("_x") * F.col(f"_l{k}")), F.lit(0.0)) for k in range(1, max_lag + 1)]
    return lagged.groupBy(*keys).agg(F.count("_x").alias("n"), F.array(*sums).alias("sums"))


def autocorrelation(df: DataFrame, max_lag: int, step: str, value: str = "value",
                    keys=("series_id",)) -> DataFrame:
    """(keys, lag, acf) for lag 1 .. max_lag."""
    sums = autocovariance_sums(df, max_lag, step, value, keys)
    return sums.select(*keys, F.posexplode("sums").alias("lag", "_c"), F.element_at("sums", 1).alias("_c0")).where(
        "lag > 0").select(*keys, "lag", (F.col("_c") / F.nullif(F.col("_c0"), F.lit(0.0))).alias("acf"))


def partial_autocorrelation(df: DataFrame, max_lag: int, step: str, value: str = "value",
                            keys=("series_id",)) -> DataFrame:
    """(keys, lag, pacf) by the Durbin-Levinson recursion on the short array of
    autocorrelations of each series."""
    sums = autocovariance_sums(df, max_lag, step, value, keys)
    rho = F.transform("sums", lambda c: c / F.nullif(F.element_at("sums", 1), F.lit(0.0)))
    start = F.struct(F.array().cast("array<double>").alias("phi"), F.array().cast("array<double>").alias("out"))

    def dot(a: Column, b: Column) -> Column:
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)

    def move(s: Column, k: Column) -> Column:
        known = F.slice("_rho", F.lit(2), k - 1)
        last = (F.element_at("_rho", k + 1) - dot(s["phi"], F.reverse(known))) / (
            F.lit(1.0) - dot(s["phi"], known))
        kept = F.zip_with(s["phi"], F.reverse(s["phi"]), lambda a, b: a - last * b)
        return F.struct(F.concat(kept, F.array(last)).alias("phi"), F.concat(s["out"], F.array(last)).alias("out"))

    pacf = F.aggregate(F.sequence(F.lit(1), F.lit(max_lag)), start, move, lambda s: s["out"])
    return (sums.withColumn("_rho", rho).select(*keys, F.posexplode(pacf).alias("lag", "pacf"))
            .withColumn("lag", F.col("lag") + 1))


def cumulative(df: DataFrame, column: str, name: str, step: str, keys=("series_id",),
               block: int = 1024) -> DataFrame:
    """Running sum over a whole series in two levels: inside time blocks, plus the
    totals of the earlier blocks (one row per block)."""
    width = block * STEP_SECONDS[step]
    blocked = df.withColumn(BLOCK, F.floor(epoch() / width)).repartition(*keys, BLOCK)
    inside = block_window(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    totals = blocked.groupBy(*keys, BLOCK).agg(F.sum(column).alias("_total")).withColumn(
        "_before", F.coalesce(F.sum("_total").over(Window.partitionBy(*keys).orderBy(BLOCK).rowsBetween(
            Window.unboundedPreceding, -1)), F.lit(0.0))).drop("_total")
    return (blocked.withColumn("_run", F.sum(column).over(inside)).join(totals, [*keys, BLOCK])
            .withColumn(name, F.col("_run") + F.col("_before")).drop("_run", "_before", BLOCK))


def kpss_statistic(df: DataFrame, step: str, value: str = "value", keys=("series_id",),
                   max_lag: int | None = None, n_max: int | None = None) -> DataFrame:
    """(keys, n, kpss): level stationarity statistic with a Bartlett long-run
    variance of ``max_lag`` lags (default: 3 sqrt(n) / 13 of each series)."""
    if max_lag is None:
        n_max = n_max or df.groupBy(*keys).count().agg(F.max("count")).first()[0]
        widest = max(1, int(3 * math.sqrt(n_max) / 13))
        lags = F.greatest(F.lit(1), F.floor(F.lit(3.0) * F.sqrt("n") / 13).cast("int"))
    else:
        widest, lags = max_lag, F.lit(max_lag)
    x = centred(df, value, keys).select(*keys, "ts", "_x")
    walk = cumulative(x, "_x", "_sum", step, keys).groupBy(*keys).agg(
        F.sum(F.col("_sum") * F.col("_sum")).alias("_walk"))
    sums = autocovariance_sums(df, widest, step, value, keys).withColumn("_lags", lags)
    weighted = F.aggregate(
        F.sequence(F.lit(1), F.col("_lags")), F.lit(0.0),
        lambda s, k: s + (F.lit(1.0) - k / (F.col("_lags") + 1.0)) * F.element_at("sums", k + 1))
    long_run = (F.element_at("sums", 1) + F.lit(2.0) * weighted) / F.col("n")
    return sums.join(walk, list(keys)).select(
        *keys, "n", (F.col("_walk") / (F.col("n") * F.col("n")) / F.nullif(long_run, F.lit(0.0))).alias("kpss"))


def difference_order(df: DataFrame, step: str, value: str = "value", keys=("series_id",),
                     critical: float = KPSS_5_PERCENT, most: int = 2) -> DataFrame:
    """(keys, ndiffs): differences until the level test passes, at most ``most``.
    All orders are tested in one plan; no decision goes through the driver."""
    n_max = df.groupBy(*keys).count().agg(F.max("count")).first()[0]
    out, rows = None, df.select(*keys, "ts", F.col(value).alias("_v"))
    for order in range(most):
        if order:
            rows = add_differences(rows, {"_d": 1}, step, "_v", keys).where("_d is not null").select(
                *keys, "ts", F.col("_d").alias("_v"))
        stat = kpss_statistic(rows, step, "_v", keys, n_max=n_max).select(
            *keys, (F.col("kpss") > critical).alias(f"_fails{order}"))
        out = stat if out is None else out.join(stat, list(keys), "left")
    count, still = F.lit(0), F.lit(True)
    for order in range(most):
        still = still & F.coalesce(F.col(f"_fails{order}"), F.lit(False))
        count = count + still.cast("int")
    return out.select(*keys, count.alias("ndiffs"))


def seasonal_strength(df: DataFrame, period: int, step: str, value: str = "value",
                      keys=("series_id",)) -> DataFrame:
    """(keys, strength, nsdiffs): 1 - var(remainder) / var(season + remainder) of a
    classical decomposition."""
    trend = centred_mean(df.select(*keys, "ts", F.col(value).alias("_v")), "_trend", period, step, "_v", keys)
    loose = trend.where("_trend is not null").select(
        *keys, F.pmod(F.floor(epoch() / STEP_SECONDS[step]), F.lit(period)).alias("_pos"),
        (F.col("_v") - F.col("_trend")).alias("_d"))
    figure = loose.groupBy(*keys, "_pos").agg(F.avg("_d").alias("_season"))
    level = figure.groupBy(*keys).agg(F.avg("_season").alias("_level"))
    figure = figure.join(level, list(keys)).withColumn("_season", F.col("_season") - F.col("_level")).drop("_level")
    parts = loose.join(figure, [*keys, "_pos"])
    strength = F.greatest(F.lit(0.0), 1 - F.var_samp(F.col("_d") - F.col("_season")) / F.nullif(
        F.var_samp("_d"), F.lit(0.0)))
    return parts.groupBy(*keys).agg(strength.alias("strength")).withColumn(
        "nsdiffs", (F.col("strength") > SEASONAL_STRENGTH).cast("int"))


def ljung_box(df: DataFrame, lags: int, step: str, value: str = "value", fitted: int = 0,
              keys=("series_id",)) -> DataFrame:
    """(keys, n, q, df, p_value) of the residual autocorrelation test."""
    sums = autocovariance_sums(df, lags, step, value, keys)
    n = F.col("n").cast("double")
    rho2 = F.transform(F.slice("sums", F.lit(2), F.lit(lags)),
                       lambda c, i: F.pow(c / F.nullif(F.element_at("sums", 1), F.lit(0.0)), F.lit(2.0)) / (n - i - 1))
    q = n * (n + 2) * F.aggregate(rho2, F.lit(0.0), lambda s, v: s + v)

    return sums.select(*keys, "n", q.alias("q")).withColumns(
        {"df": F.lit(lags - fitted), "p_value": chi_square_tail(F.col("q"), F.lit(lags - fitted))})


def residual_feed(df: DataFrame, max_lag: int, step: str, value: str = "value", keys=("series_id",)) -> DataFrame:
    """Autocorrelation and partial autocorrelation side by side, with the limit of
    two standard errors: the table behind the residual charts."""
    both = autocorrelation(df, max_lag, step, value, keys).join(
        partial_autocorrelation(df, max_lag, step, value, keys), [*keys, "lag"])
    n = df.groupBy(*keys).agg((F.lit(1.96) / F.sqrt(F.count(value))).alias("limit"))
    return both.join(n, list(keys))


def relation(df: DataFrame, x: str, y: str, keys=()) -> DataFrame:
    """Correlation and straight line of y on x."""
    return df.groupBy(*keys).agg(
        F.count(F.when(F.col(x).isNotNull() & F.col(y).isNotNull(), 1)).alias("n"), F.corr(x, y).alias("corr"),
        F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def binned_mean(df: DataFrame, x: str, y: str, width: float = 1.0, keys=()) -> DataFrame:
    """Mean of y per bin of x."""
    return df.where(F.col(x).isNotNull()).groupBy(*keys, F.floor(F.col(x) / width).alias("bin")).agg(
        F.count(y).alias("n"), F.avg(y).alias("mean_value"))
