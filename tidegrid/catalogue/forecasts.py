"""Forecasters over rolling origins."""

from __future__ import annotations

from dataclasses import replace

from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tidegrid.catalogue.features import with_station_weather
from tidegrid.catalogue.joins import EXPANDING_SPEC, HOURLY_SPEC, ORIGINS
from tidegrid.catalogue.registry import DAY_FILLED_CHAIN, FILLED_CHAIN, query, r, render, txt, with_
from tidegrid.operators import (additive, autoregression, boosted, ets, ets_search, features, grid, impute, lags, linear,
                                metrics, smoothing, weather, windows)
from tidegrid.plans import published
from tidegrid.plans.backtest import Backtest
from tidegrid.sources import tables

# One-feature regressions on the two-day lag: everything about them is plain SQL.
_L2 = """l2 AS (SELECT series_id, ts, value, coalesce(lag(value, 48) OVER (PARTITION BY series_id ORDER BY ts), 0)
  AS l2 FROM filled)"""
_TRAIN = """train AS (SELECT o.series_id, o.origin, f.ts, f.value, f.l2, row_number() OVER (
  PARTITION BY o.series_id, o.origin ORDER BY f.ts) AS p FROM origins o JOIN l2 f ON f.series_id = o.series_id
  AND f.ts BETWEEN o.train_start AND o.train_end)"""
_COEF = """coef AS (SELECT series_id, origin, count(*) AS n, regr_slope(value, l2) AS b, regr_intercept(value, l2) AS a
  FROM train GROUP BY 1, 2)"""
_FUTURE = """future AS (SELECT o.series_id, o.origin, CAST(date_diff('hour', o.origin, f.ts) + 17 AS INTEGER) AS step,
  f.ts, f.value, f.l2 FROM origins o JOIN l2 f ON f.series_id = o.series_id AND f.ts > o.train_end
  AND f.ts <= o.horizon_end)"""
_RESID = """resid AS (SELECT t.series_id, t.origin, t.ts, t.p, t.value - c.a - c.b * t.l2 AS x FROM train t
  JOIN coef c ON c.series_id = t.series_id AND c.origin = t.origin)"""
_AR1 = """centred AS (SELECT *, x - avg(x) OVER (PARTITION BY series_id, origin) AS e FROM resid),
pairs AS (SELECT *, lag(e) OVER (PARTITION BY series_id, origin ORDER BY p) AS e1 FROM centred),
ar AS (SELECT series_id, origin, avg(x) AS mu, sum(e * e1) / sum(e1 * e1) FILTER (e1 IS NOT NULL) AS phi,
  arg_max(e, p) AS last FROM pairs GROUP BY 1, 2)"""
_CHAIN = (FILLED_CHAIN, ORIGINS, _L2, _TRAIN, _COEF)


def with_l2(spark, folder):
    return lags.add_lags(tables.filled_events(spark, folder), {"l2": 48}, "hour")


def _coefficients(spark, folder):
    return linear.rolling_coefficients(with_l2(spark, folder), ["l2"], HOURLY_SPEC)


@query("f1_rolling_ols", with_(*_CHAIN) + f"""SELECT series_id, {txt('origin')} AS origin, n,
  {r('a')} AS intercept, {r('b')} AS slope FROM coef""")
def f1(spark, folder):
    return render(_coefficients(spark, folder).select(
        "series_id", "origin", "n", "intercept", F.element_at("coefficients", 1).alias("slope")))


# Expanding windows: every origin trains on all rows from the first origin's window on.
_GROWING = """firsts AS (SELECT series_id, min(train_start) AS train_start FROM origins GROUP BY 1),
grown AS (SELECT o.series_id, o.origin, count(*) AS n, regr_slope(f.value, f.l2) AS b, regr_intercept(f.value, f.l2) AS a
  FROM origins o JOIN firsts s ON s.series_id = o.series_id JOIN l2 f ON f.series_id = o.series_id
  AND f.ts BETWEEN s.train_start AND o.train_end GROUP BY 1, 2)"""


def _growing_coefficients(spark, folder):
    return windows.window_coefficients(with_l2(spark, folder), ["l2"], EXPANDING_SPEC)


@query("f1_expanding_ols", with_(FILLED_CHAIN, ORIGINS, _L2, _GROWING) + f"""SELECT series_id, {txt('origin')} AS origin, n,
  {r('a')} AS intercept, {r('b')} AS slope FROM grown""")
def f1_expanding(spark, folder):
    return render(_growing_coefficients(spark, folder).select(
        "series_id", "origin", "n", "intercept", F.element_at("coefficients", 1).alias("slope")))


@query("backtest_expanding_ols_scores", with_(FILLED_CHAIN, ORIGINS, _L2, _GROWING, _FUTURE) + f""", fc AS (SELECT f.series_id, f.origin,
  f.value AS actual, g.a + g.b * f.l2 AS predicted FROM future f JOIN grown g ON g.series_id = f.series_id AND g.origin = f.origin
  WHERE f.step BETWEEN 17 AND 40)
  SELECT series_id, {txt('CAST(origin AS DATE)')} AS day, {r('avg(actual - predicted)', 6)} AS me,
  {r('sqrt(avg((actual - predicted) * (actual - predicted)))', 6)} AS rmse,
  {r('avg(abs(100 * (actual - predicted) / nullif(actual, 0)))', 6)} AS mape FROM fc GROUP BY 1, 2""")
def expanding_scores(spark, folder):
    out = linear.predict_rows(with_l2(spark, folder), _growing_coefficients(spark, folder), ["l2"], EXPANDING_SPEC)
    return render(published.score_days(out, EXPANDING_SPEC).select("series_id", "day", "me", "rmse", "mape"), 6)


@query("f2_ols_prediction", with_(*_CHAIN, _FUTURE) + f"""SELECT f.series_id, {txt('f.origin')} AS origin, f.step,
  {txt('f.ts')} AS ts, {r('f.value')} AS actual, {r('c.a + c.b * f.l2')} AS predicted FROM future f
  JOIN coef c ON c.series_id = f.series_id AND c.origin = f.origin""")
def f2(spark, folder):
    return render(linear.predict_rows(with_l2(spark, folder), _coefficients(spark, folder), ["l2"], HOURLY_SPEC))


@query("f6_training_residuals", with_(*_CHAIN, _RESID) + f"""SELECT series_id, {txt('origin')} AS origin,
  {txt('ts')} AS ts, {r('x')} AS residual FROM resid""")
def f6(spark, folder):
    return render(linear.training_residuals(with_l2(spark, folder), _coefficients(spark, folder), ["l2"], HOURLY_SPEC))


@query("f7_residual_autoregression", with_(*_CHAIN, _RESID, _AR1) + f"""SELECT series_id, {txt('origin')} AS origin,
  CAST(step AS INTEGER) AS step, {r('mu + pow(phi, step) * last')} AS residual FROM ar, range(1, 41) s(step)""")
def f7(spark, folder):
    left = linear.training_residuals(with_l2(spark, folder), _coefficients(spark, folder), ["l2"], HOURLY_SPEC)
    return render(linear.residual_forecast(left, HOURLY_SPEC, (1, 0, 0), (0, 0, 0)))


def _formula_frame(spark, folder, formula):
    """The columns a published formula names, on the hourly events."""
    need = features.formula_columns(formula)
    hours = grid.bucket_mean(tables.station_readings(spark, folder), "hour", ())
    temps = impute.calendar_fill(grid.complete(hours, "hour", ()), ("hour",), keys=(), skip_null=True).select(
        F.col("ts").alias("date"), F.col("value").alias("temperature"))
    rows = tables.filled_events(spark, folder)
    if "temperature" in need:
        rows = weather.join_hourly(rows, temps, "date")
    if need & set(features.FINAL_WEATHER):
        rows = with_station_weather(spark, folder, rows)
    # Lags beyond the month of data are zero padded everywhere.
    known = {n: k for n, k in {**lags.LOAD_LAGS, **lags.REGRESSION_LAGS}.items() if n in need}
    return features.load_frame(rows, lags=known, need=need)


@query("f7_seasonal_residual_layer")
def f7_seasonal(spark, folder):
    """The residual set-up of the final model: (1,0,1)(1,0,0) with period 24."""
    left = linear.training_residuals(with_l2(spark, folder), _coefficients(spark, folder), ["l2"], HOURLY_SPEC)
    return render(linear.residual_forecast(left, HOURLY_SPEC, (1, 0, 1), (1, 0, 0)))


@query("f8_seasonal_steps", with_(*_CHAIN, _RESID) + f""", e AS (SELECT *, x - avg(x) OVER (
  PARTITION BY series_id, origin) AS e, avg(x) OVER (PARTITION BY series_id, origin) AS mu FROM resid),
  s AS (SELECT *, lag(e, 24) OVER (PARTITION BY series_id, origin ORDER BY p) AS e24,
  max(p) OVER (PARTITION BY series_id, origin) AS top FROM e),
  f AS (SELECT series_id, origin, sum(e * e24) / sum(e24 * e24) AS phi FROM s WHERE e24 IS NOT NULL GROUP BY 1, 2)
  SELECT s.series_id, {txt('s.origin')} AS origin, CAST(step AS INTEGER) AS step,
  {r('mu + pow(phi, 1 + (step - 1) // 24) * e')} AS residual FROM range(1, 41) h(step)
  JOIN s ON s.p = s.top - 23 + (step - 1) % 24 JOIN f ON f.series_id = s.series_id AND f.origin = s.origin""")
def f8(spark, folder):
    left = linear.training_residuals(with_l2(spark, folder), _coefficients(spark, folder), ["l2"], HOURLY_SPEC)
    return render(linear.residual_forecast(left, HOURLY_SPEC, (0, 0, 0), (1, 0, 0)))


@query("f9_two_layer_sum", with_(*_CHAIN, _FUTURE, _RESID, _AR1) + f"""SELECT f.series_id, {txt('f.origin')} AS origin,
  f.step, {r('c.a + c.b * f.l2')} AS base, {r('r.mu + pow(r.phi, f.step) * r.last')} AS residual,
  {r('c.a + c.b * f.l2 + r.mu + pow(r.phi, f.step) * r.last')} AS predicted FROM future f
  JOIN coef c ON c.series_id = f.series_id AND c.origin = f.origin
  JOIN ar r ON r.series_id = f.series_id AND r.origin = f.origin""")
def f9(spark, folder):
    out = linear.rolling_regression(with_l2(spark, folder), ["l2"], HOURLY_SPEC, residual_order=(1, 0, 0))
    return render(out.select("series_id", "origin", "step", "base", "residual", "predicted"))


_SES = """level AS (SELECT t.series_id, t.origin, sum(t.value * CASE WHEN t.p = 1 THEN pow(0.9, m.n - 1)
  ELSE 0.1 * pow(0.9, m.n - t.p) END) AS level FROM train t JOIN (SELECT series_id, origin, max(p) AS n FROM train
  GROUP BY 1, 2) m ON m.series_id = t.series_id AND m.origin = t.origin GROUP BY 1, 2)"""


@query("f10_simple_smoothing", with_(FILLED_CHAIN, ORIGINS, _L2, _TRAIN, _FUTURE, _SES) + f"""SELECT f.series_id,
  {txt('f.origin')} AS origin, f.step, {r('f.value')} AS actual, {r('l.level')} AS predicted FROM future f
  JOIN level l ON l.series_id = f.series_id AND l.origin = f.origin""")
def f10(spark, folder):
    return render(smoothing.smoothing_forecast(tables.filled_events(spark, folder), HOURLY_SPEC, 0.1).select(
        "series_id", "origin", "step", "actual", "predicted"))


@query("f10_smoothing_levels", "WITH RECURSIVE " + ",\n".join([DAY_FILLED_CHAIN, """num AS (SELECT *, row_number() OVER (
  PARTITION BY series_id ORDER BY ts) AS p FROM day_filled),
ses AS (SELECT series_id, p, value AS level, CAST(NULL AS DOUBLE) AS error FROM num WHERE p = 1
  UNION ALL SELECT n.series_id, n.p, 0.2 * n.value + 0.8 * s.level, n.value - s.level FROM ses s JOIN num n
  ON n.series_id = s.series_id AND n.p = s.p + 1)"""]) + f""" SELECT s.series_id, {txt('n.ts')} AS ts,
  {r('s.level')} AS level, {r('s.error')} AS error FROM ses s JOIN num n ON n.series_id = s.series_id AND n.p = s.p""")
def f10_levels(spark, folder):
    # With a weight of 0.1 the first levels are short decimals that end in 5: exact
    # ties of the comparison's rounding. With 0.2 they end in even digits.
    return render(smoothing.smoothing_levels(tables.filled_shipments(spark, folder), 0.2, "day").select(
        "series_id", "ts", "level", "error"))


# Smoothing errors of each window by recursion, then a one-feature regression on them.
_SES_ERRORS = """steps AS (SELECT series_id, origin, p, l2, value AS level, CAST(0 AS DOUBLE) AS error FROM train WHERE p = 1
  UNION ALL SELECT t.series_id, t.origin, t.p, t.l2, 0.1 * t.value + 0.9 * s.level, t.value - s.level FROM steps s
  JOIN train t ON t.series_id = s.series_id AND t.origin = s.origin AND t.p = s.p + 1),
ses_fit AS (SELECT series_id, origin, regr_slope(error, l2) AS b, regr_intercept(error, l2) AS a,
  arg_max(level, p) AS level FROM steps GROUP BY 1, 2)"""


@query("f11_smoothing_with_regression", "WITH RECURSIVE " + ",\n".join([
    FILLED_CHAIN, ORIGINS, _L2, _TRAIN, _FUTURE, _SES_ERRORS]) + f""" SELECT f.series_id, {txt('f.origin')} AS origin,
  f.step, {r('s.level')} AS level, {r('s.a + s.b * f.l2')} AS base, {r('s.level + s.a + s.b * f.l2')} AS predicted
  FROM future f JOIN ses_fit s ON s.series_id = f.series_id AND s.origin = f.origin""")
def f11(spark, folder):
    rows = smoothing.smoothed_sums(with_l2(spark, folder), 0.1, "hour")
    out = linear.rolling_regression(rows, ["l2"], HOURLY_SPEC, smoothing=0.1)
    return render(out.select("series_id", "origin", "step", "level", "base", "predicted"))


def _grid_values(forms):
    return ", ".join(f"('{f}', {a}::DOUBLE, {b!r}::DOUBLE, {p}::DOUBLE, {k})" for f, a, b, p, k in ets.candidates(forms))


def _ets_sql(forms):
    """State recursion of every candidate over every window, then the best one."""
    return f"""cand(form, alpha, beta, phi, k) AS (VALUES {_grid_values(forms)}),
slopes AS (SELECT series_id, origin, (max(value) FILTER (p = 11) - max(value) FILTER (p = 1)) / 10 AS b0,
  max(value) FILTER (p = 1) AS l0, max(p) AS n FROM train GROUP BY 1, 2),
run AS (SELECT s.series_id, s.origin, c.*, 1 AS p, s.l0 AS l, CASE WHEN c.form = 'ANN' THEN 0 ELSE s.b0 END AS b,
    CAST(0 AS DOUBLE) AS sse FROM slopes s, cand c
  UNION ALL SELECT q.series_id, q.origin, q.form, q.alpha, q.beta, q.phi, q.k, q.p + 1,
    q.l + q.phi * q.b + q.alpha * (t.value - q.l - q.phi * q.b), q.phi * q.b + q.beta * (t.value - q.l - q.phi * q.b),
    q.sse + (t.value - q.l - q.phi * q.b) * (t.value - q.l - q.phi * q.b)
  FROM run q JOIN train t ON t.series_id = q.series_id AND t.origin = q.origin AND t.p = q.p + 1),
ends AS (SELECT run.*, run.p - 1 AS n, (run.p - 1) * ln(sse + 1e-300) + 2 * k + 2.0 * k * (k + 1) / (run.p - 1 - k - 1) AS aicc
  FROM run JOIN slopes s ON s.series_id = run.series_id AND s.origin = run.origin AND s.n = run.p),
best AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY series_id, origin ORDER BY aicc, form, alpha, beta, phi) = 1)"""


_ETS_CHAIN = (FILLED_CHAIN, ORIGINS, _L2, _TRAIN, _FUTURE)


@query("f12_smoothing_with_trend", "WITH RECURSIVE " + ",\n".join([*_ETS_CHAIN, _ets_sql(ets.FORMS)]) + f""" SELECT
  f.series_id, {txt('f.origin')} AS origin, f.step, b.form, {r('f.value')} AS actual,
  {r('b.l + b.b * CASE WHEN b.phi = 1 THEN f.step ELSE b.phi * (1 - pow(b.phi, f.step)) / (1 - b.phi) END')} AS predicted
  FROM future f JOIN best b ON b.series_id = f.series_id AND b.origin = f.origin""")
def f12(spark, folder):
    return render(ets.ets_forecast(tables.filled_events(spark, folder), HOURLY_SPEC).select(
        "series_id", "origin", "step", "form", "actual", "predicted"))


# The same recursion on Box-Cox values, whose parameter is that of the least variation over pairs of rows of the window.
_BOXED = (_TRAIN.replace("train AS", "raw AS", 1), """lams AS (SELECT (i - 10) / 10.0::DOUBLE AS lam FROM range(0, 31) t(i))""",
    """twos AS (SELECT series_id, origin, (p - 1) // 2 AS b, avg(value) AS m, stddev_samp(value) AS s FROM raw GROUP BY ALL HAVING count(*) = 2)""",
    """chosen AS (SELECT series_id, origin, lam FROM (SELECT series_id, origin, lam, stddev_samp(s / pow(m, 1 - lam)) / avg(s / pow(m, 1 - lam)) AS cv
      FROM twos, lams GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY series_id, origin ORDER BY cv, lam) = 1)""",
    """train AS (SELECT series_id, origin, ts, CASE WHEN abs(lam) < 1e-12 THEN ln(value) ELSE (pow(value, lam) - 1) / lam END AS value, p
      FROM raw JOIN chosen USING (series_id, origin))""")
_BACK = "CASE WHEN abs(lam) < 1e-12 THEN exp({z}) WHEN ({z}) * lam + 1 > 0 THEN pow(({z}) * lam + 1, 1 / lam) END"


@query("f12_damped_box_cox", "WITH RECURSIVE " + ",\n".join([FILLED_CHAIN, ORIGINS, _L2, *_BOXED, _FUTURE, _ets_sql(("AAdN",))]) + f""",
  ahead AS (SELECT f.*, b.form, lam, b.l + b.b * b.phi * (1 - pow(b.phi, f.step)) / (1 - b.phi) AS c, 1.959963984540054 * sqrt(b.sse / b.n * (1
    + coalesce(list_sum(list_transform(range(1, f.step), lambda j: pow(b.alpha + b.beta * b.phi * (1 - pow(b.phi, j)) / (1 - b.phi), 2))), 0))) AS w
    FROM future f JOIN best b ON b.series_id = f.series_id AND b.origin = f.origin
    JOIN chosen k ON k.series_id = f.series_id AND k.origin = f.origin)
  SELECT series_id, {txt('origin')} AS origin, step, {txt('ts')} AS ts, {r('value', 6)} AS actual, form, {r(_BACK.format(z='c'), 6)} AS predicted,
    {r(_BACK.format(z='c - w'), 6)} AS lower, {r(_BACK.format(z='c + w'), 6)} AS upper FROM ahead""")
def f12_box_cox(spark, folder):
    """Damped trend on Box-Cox values whose parameter is chosen per window."""
    out = ets.ets_forecast(tables.filled_events(spark, folder), HOURLY_SPEC, ("AAdN",), lam="auto")
    return render(out, 6)


@query("f12_growing_windows")
def f12_growing(spark, folder):
    """Damped trend on Box-Cox values, weights found by search, on windows that grow from origin to origin."""
    return render(ets_search.search_forecast(tables.filled_events(spark, folder), EXPANDING_SPEC, ("AAdN",), lam="auto"), 4)


@query("f12_searched_form")
def f12_searched(spark, folder):
    """The form with the best AICc, weights found by search, per rolling window."""
    return render(ets_search.search_forecast(tables.filled_events(spark, folder), HOURLY_SPEC), 4)


@query("f18_forecast_interval", "WITH RECURSIVE " + ",\n".join([*_ETS_CHAIN, _ets_sql(("ANN",))]) + f""" SELECT
  f.series_id, {txt('f.origin')} AS origin, f.step, {r('b.l')} AS predicted,
  {r('b.l - 1.959963984540054 * sqrt(b.sse / b.n * (1 + (f.step - 1) * b.alpha * b.alpha))')} AS lower,
  {r('b.l + 1.959963984540054 * sqrt(b.sse / b.n * (1 + (f.step - 1) * b.alpha * b.alpha))')} AS upper
  FROM future f JOIN best b ON b.series_id = f.series_id AND b.origin = f.origin""")
def f18(spark, folder):
    return render(ets.ets_forecast(tables.filled_events(spark, folder), HOURLY_SPEC, ("ANN",)).select(
        "series_id", "origin", "step", "predicted", "lower", "upper"))


# P(|T| > |t|) by Simpson's rule over the density from 0 to |t|, in 4,000 stretches.
_T_TAIL = """greatest(0, 1 - 2 * exp(lgamma((df + 1) / 2.0) - lgamma(df / 2.0)) / sqrt(df * pi()) * least(abs({t}), 60.0) / 12000 * list_sum(
  list_transform(range(0, 4001), lambda i: (CASE WHEN i IN (0, 4000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END)
  * pow(1 + pow(least(abs({t}), 60.0) * i / 4000, 2) / df, -(df + 1) / 2.0))))"""


@query("f17_model_summary", with_(DAY_FILLED_CHAIN) + f""", x AS (SELECT series_id, value AS y, row_number() OVER (
  PARTITION BY series_id ORDER BY ts) AS t FROM day_filled), f AS (SELECT series_id, count(*) AS n, count(*) - 2 AS df,
  regr_slope(y, t) AS b, regr_intercept(y, t) AS a, regr_r2(y, t) AS r2, regr_sxx(y, t) AS sxx, avg(t) AS mt,
  sqrt((regr_syy(y, t) - regr_slope(y, t) * regr_sxy(y, t)) / (count(*) - 2)) AS s FROM x GROUP BY 1),
  terms AS (SELECT *, 'trend' AS term, b AS estimate, s / sqrt(sxx) AS std_error FROM f
    UNION ALL SELECT *, '(Intercept)', a, s * sqrt(1.0 / n + mt * mt / sxx) FROM f)
  SELECT series_id, term, n, {r('estimate')} AS estimate, {r('std_error')} AS std_error, {r('estimate / std_error', 6)} AS t_value, {r('r2')} AS r2,
    CAST(1 AS BIGINT) AS df_fit, df, {r('r2 / ((1 - r2) / df)', 6)} AS f_value, {r(_T_TAIL.format(t="(estimate / std_error)"))} AS p_value,
    {r(_T_TAIL.format(t="sqrt(r2 / ((1 - r2) / df))"))} AS f_p_value FROM terms""")
def f17(spark, folder):
    rows = grid.step_index(tables.filled_shipments(spark, folder), "day")
    return render(linear.regression_summary(rows, ["trend"]), t_value=6, f_value=6)


# The whole chain in SQL: window fit, residual layer, forecast of the day, daily scores.
@query("backtest_two_layer_scores", with_(*_CHAIN, _FUTURE, _RESID, _AR1) + f""", fc AS (SELECT f.series_id, f.origin,
  f.value AS actual, c.a + c.b * f.l2 + r.mu + pow(r.phi, f.step) * r.last AS predicted FROM future f
  JOIN coef c ON c.series_id = f.series_id AND c.origin = f.origin
  JOIN ar r ON r.series_id = f.series_id AND r.origin = f.origin WHERE f.step BETWEEN 17 AND 40)
  SELECT series_id, {txt('CAST(origin AS DATE)')} AS day, {r('avg(actual - predicted)', 6)} AS me,
  {r('sqrt(avg((actual - predicted) * (actual - predicted)))', 6)} AS rmse,
  {r('avg(abs(100 * (actual - predicted) / nullif(actual, 0)))', 6)} AS mape FROM fc GROUP BY 1, 2""")
def two_layer_scores(spark, folder):
    out = linear.rolling_regression(with_l2(spark, folder), ["l2"], HOURLY_SPEC, residual_order=(1, 0, 0))
    return render(published.score_days(out, HOURLY_SPEC).select("series_id", "day", "me", "rmse", "mape"), 6)


def _plan_query(name, plan_name, **changes):
    """A published regression set-up on windows that fit the one-month table."""
    @query(name)
    def run(spark, folder):
        plan = published.with_backtest(published.REGRESSIONS[plan_name], **changes)
        out = published.run_regression(_formula_frame(spark, folder, plan.formula), plan)
        return render(published.score_days(out, plan.backtest).drop("peaks", "peaks_pred"), 6)
    return run


_plan_query("backtest_single_holdout", "single_holdout", train=14 * 24, first="2024-01-20", last="2024-01-20")
_plan_query("backtest_expanding_window", "expanding", train=14 * 24 + 8)
_plan_query("backtest_rolling_window", "rolling_quarter", train=14 * 24 + 8)
_plan_query("backtest_rich_formula", "rolling_two_years", train=21 * 24 + 8)
_plan_query("backtest_smoothing_layer", "smoothing_layer", train=14 * 24 + 8)


# The boosted model on the daily table, with lags and calendar terms in days.
_DAY_LAGS = {"d2": 2, "d3": 3, "d4": 4, "d5": 5, "d6": 6, "l7": 7, "l14": 14, "l21": 21, "w4": 28, "y1_1b": 364}
_DAY_FEATURES = [*_DAY_LAGS, "day_week", "day_year", "month", "day_month", "holiday", "trend",
                 "day_week_sin1", "day_week_cos1", "day_year_sin1", "day_year_cos1", "month_sin1", "month_cos1"]
# Every weekly origin the table allows, each with its own model of the published rounds.
BOOSTED_SPEC = Backtest(train=1095 + 40, valid=40, horizon=9, score_from=3, every=7, step="day")
BOOSTING = boosted.Boosting()


def _boosted_table(spark, folder):
    frame = features.load_frame(tables.filled_shipments(spark, folder), "day", _DAY_LAGS, need=_DAY_FEATURES)
    return boosted.store_features(frame.select("series_id", "ts", "value", *_DAY_FEATURES))


_daily_models: dict = {}


def _boosted_daily(spark, folder):
    """The daily table and the models of all weekly origins: fitted and stored once a session, read by several queries."""
    key = spark.sparkContext.applicationId, folder
    if key not in _daily_models:
        table = _boosted_table(spark, folder)
        _daily_models[key] = table, boosted.fit_origins(table, _DAY_FEATURES, BOOSTED_SPEC, BOOSTING)
    return _daily_models[key]


def _last(models):
    """The model of the last origin."""
    return models.join(models.agg(F.max("_o").alias("_o")), "_o")


def _week_scores(out):
    rows = out.where("step >= 3").withColumns({"week": F.to_date("origin"), "hour": F.dayofweek("ts")})
    return metrics.daily_scores(rows, ("series_id", "week"), denominator="predicted").drop("peaks", "peaks_pred")


@query("f3_boosted_trees")
def f3(spark, folder):
    table, models = _boosted_daily(spark, folder)
    return render(boosted.forecasts(table, _DAY_FEATURES, BOOSTED_SPEC, models, BOOSTING), 6)


@query("f4_validation_curve")
def f4(spark, folder):
    """Error per round of every origin, up to the round where its early stop is settled."""
    return render(boosted.validation_curve(_boosted_daily(spark, folder)[1]))


@query("f5_boosted_prediction")
def f5(spark, folder):
    table, models = _boosted_daily(spark, folder)
    return render(_week_scores(boosted.forecasts(table, _DAY_FEATURES, BOOSTED_SPEC, models, BOOSTING)), 6)


@query("f16_feature_importance")
def f16(spark, folder):
    return render(boosted.importance(_boosted_daily(spark, folder)[1], _DAY_FEATURES, BOOSTING))


@query("o4_feature_ranking")
def o4(spark, folder):
    """Inputs ranked by their share of the gain in the last origin's model; one row per input."""
    return render(boosted.ranked(boosted.importance(_last(_boosted_daily(spark, folder)[1]), _DAY_FEATURES, BOOSTING)))


@query("backtest_boosted_residual_layer")
def boosted_layer(spark, folder):
    """Boosted trees plus the seasonal residual layer, percent errors relative to
    the prediction, as the published daily metrics are."""
    table, models = _boosted_daily(spark, folder)
    out = boosted.forecasts(table, _DAY_FEATURES, BOOSTED_SPEC, models, BOOSTING, (1, 0, 1), (1, 0, 0), period=7)
    return render(_week_scores(out), 6)


# Two rounds of stumps on inputs of few values: a boosted model that plain SQL can grow, for every origin.
_STUMPS = boosted.Boosting(rounds=2, depth=1, row_share=1.0, tree_share=1.0, column_share=1.0)
_STUMP_FEATURES = ["day_week", "month", "day_month"]


def _stump_round(k: int) -> str:
    """Histograms of all inputs, their cumulative sums, the best cut of each origin, new predictions p{k}."""
    return f"""h{k} AS (SELECT o, i, v, sum(p{k - 1} - value) AS g, count(*) AS n FROM (SELECT o, p{k - 1}, value,
    unnest([0, 1, 2, 3, 4]) AS i, unnest([f0, f1, f2, m, s]) AS v FROM r{k - 1} WHERE d <= o - 43) GROUP BY ALL),
c{k} AS (SELECT o, i, v, sum(g) OVER w AS gl, sum(n) OVER w AS nl, sum(g) OVER a AS gt, sum(n) OVER a AS nt FROM h{k}
    WINDOW w AS (PARTITION BY o, i ORDER BY v), a AS (PARTITION BY o, i)),
g{k} AS (SELECT *, 0.5 * (gl * gl / (nl + 0.1) + (gt - gl) * (gt - gl) / (nt - nl + 0.1) - gt * gt / (nt + 0.1)) AS gain
    FROM c{k} WHERE nl >= 2 AND nt - nl >= 2),
t{k} AS (SELECT * FROM (SELECT *, max(gain) OVER (PARTITION BY o) AS top FROM g{k}) WHERE gain >= top * (1 - 1e-9) AND gain > 0.6
    QUALIFY row_number() OVER (PARTITION BY o ORDER BY i, v) = 1),
w{k} AS (SELECT o, any_value(gt) AS gt, any_value(nt) AS nt FROM c{k} WHERE i = 0 GROUP BY o),
r{k} AS (SELECT r.*, p{k - 1} + CASE WHEN t.o IS NULL THEN -0.1 * w.gt / (w.nt + 0.1)
    WHEN CASE t.i WHEN 0 THEN f0 WHEN 1 THEN f1 WHEN 2 THEN f2 WHEN 3 THEN m ELSE s END <= t.v THEN -0.1 * t.gl / (t.nl + 0.1)
    ELSE -0.1 * (t.gt - t.gl) / (t.nt - t.nl + 0.1) END AS p{k}
    FROM r{k - 1} r JOIN w{k} w ON w.o = r.o LEFT JOIN t{k} t ON t.o = r.o)"""


_STUMP_SQL = with_(DAY_FILLED_CHAIN, """days AS (SELECT series_id, ts, value, date_diff('day', DATE '1970-01-01', CAST(ts AS DATE)) AS d,
    dayofweek(ts) + 1.0 AS f0, month(ts) + 0.0 AS f1, day(ts) + 0.0 AS f2 FROM day_filled),
starts AS (SELECT series_id, unnest(range(CAST(ceil((min(d) + 1137) / 7.0) * 7 AS BIGINT), CAST(floor((max(d) - 6) / 7.0) * 7 AS BIGINT) + 1, 7)) AS o
    FROM days GROUP BY series_id),
win AS (SELECT o, f.* FROM starts s JOIN days f ON f.series_id = s.series_id AND f.d BETWEEN s.o - 1137 AND s.o + 6),
scale AS (SELECT o, series_id, avg(value) AS m, stddev_samp(value) AS s FROM win WHERE d <= o - 43 GROUP BY 1, 2),
r0 AS (SELECT win.*, m, s, CAST(0.5 AS DOUBLE) AS p0 FROM win JOIN scale USING (o, series_id))""", _stump_round(1), _stump_round(2),
    """errors AS (SELECT o, sqrt(avg((p1 - value) ** 2)) AS e1, sqrt(avg((p2 - value) ** 2)) AS e2 FROM r2 WHERE d > o - 43 AND d <= o - 3 GROUP BY o),
kept AS (SELECT *, CASE WHEN e2 < e1 THEN 2 ELSE 1 END AS kept, DATE '1970-01-01' + CAST(o AS INTEGER) AS origin FROM errors),
ahead AS (SELECT r.series_id, CAST(k.origin AS TIMESTAMP) AS origin, CAST(d - r.o + 3 AS INTEGER) AS step, ts, value, CASE WHEN kept = 2 THEN p2 ELSE p1 END AS p
    FROM r2 r JOIN kept k ON k.o = r.o WHERE d > r.o - 3),
gains AS (SELECT o, i, sum(gain) AS gain FROM (SELECT o, i, gain FROM t1 UNION ALL SELECT t2.o, i, gain FROM t2 JOIN kept k ON k.o = t2.o WHERE kept = 2) GROUP BY 1, 2),
shares AS (SELECT o, i, gain / sum(gain) OVER (PARTITION BY o) AS share FROM gains),
names AS (SELECT unnest(['day_week', 'month', 'day_month', 'series_mean', 'series_sd']) AS feature, unnest([0, 1, 2, 3, 4]) AS i)""")


def _stumps(spark, folder):
    table = _boosted_table(spark, folder)
    return table, boosted.fit_origins(table, _STUMP_FEATURES, BOOSTED_SPEC, _STUMPS)


@query("f3_boosted_stumps", _STUMP_SQL + f"""SELECT series_id, {txt('origin')} AS origin, step, {txt('ts')} AS ts, {r('value', 6)} AS actual,
  {r('p', 6)} AS base, CAST(0 AS DOUBLE) AS residual, {r('p', 6)} AS predicted FROM ahead""")
def f3_stumps(spark, folder):
    table, models = _stumps(spark, folder)
    return render(boosted.forecasts(table, _STUMP_FEATURES, BOOSTED_SPEC, models, _STUMPS), 6)


@query("f4_stump_curve", _STUMP_SQL + f"""SELECT {txt('CAST(origin AS TIMESTAMP)')} AS origin, CAST(1 AS INTEGER) AS round, {r('e1', 6)} AS valid_error,
  CAST(kept = 1 AS INTEGER) AS kept FROM kept UNION ALL SELECT {txt('CAST(origin AS TIMESTAMP)')}, 2, {r('e2', 6)}, CAST(kept = 2 AS INTEGER) FROM kept""")
def f4_stumps(spark, folder):
    return render(boosted.validation_curve(_stumps(spark, folder)[1]), 6)


@query("f5_stump_prediction", _STUMP_SQL + f"""SELECT series_id, {txt('origin')} AS origin, {r('100 * avg(abs(value - p) / p)', 6)} AS mape,
  {r('sqrt(avg((value - p) ** 2))', 6)} AS rmse FROM ahead WHERE step >= 3 GROUP BY 1, 2""")
def f5_stumps(spark, folder):
    table, models = _stumps(spark, folder)
    out = boosted.forecasts(table, _STUMP_FEATURES, BOOSTED_SPEC, models, _STUMPS).where("step >= 3")
    apart = F.col("actual") - F.col("predicted")
    return render(out.groupBy("series_id", "origin").agg((100 * F.avg(F.abs(apart) / F.col("predicted"))).alias("mape"),
                                                         F.sqrt(F.avg(apart * apart)).alias("rmse")), 6)


@query("f16_stump_importance", _STUMP_SQL + f"""SELECT feature, {r('coalesce(sum(share), 0) / (SELECT count(*) FROM kept)', 6)} AS importance
  FROM names LEFT JOIN shares USING (i) GROUP BY feature""")
def f16_stumps(spark, folder):
    return render(boosted.importance(_stumps(spark, folder)[1], _STUMP_FEATURES, _STUMPS), 6)


@query("o4_stump_ranking", _STUMP_SQL + f"""SELECT feature, {r('importance', 6)} AS importance,
  CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INTEGER) AS position FROM (SELECT feature, coalesce(share, 0) AS importance
  FROM names LEFT JOIN (SELECT * FROM shares WHERE o = (SELECT max(o) FROM kept)) USING (i))""")
def o4_stumps(spark, folder):
    return render(boosted.ranked(boosted.importance(_last(_stumps(spark, folder)[1]), _STUMP_FEATURES, _STUMPS)), 6)


# One lag, one straight line for all series on scaled values: the recursion in closed form.
@query("f13_linear_recursion", with_(FILLED_CHAIN) + f""", sc AS (SELECT series_id, avg(value) AS m,
  stddev_samp(value) AS sd, max(ts) AS last FROM filled GROUP BY 1), z AS (SELECT f.series_id, f.ts, (value - m) / sd AS z,
  lag((value - m) / sd) OVER (PARTITION BY f.series_id ORDER BY f.ts) AS z1 FROM filled f JOIN sc USING (series_id)),
  line AS (SELECT regr_slope(z, z1) AS b, regr_intercept(z, z1) AS a FROM z WHERE z1 IS NOT NULL)
  SELECT sc.series_id, CAST(step AS INTEGER) AS step, {txt('sc.last + step * INTERVAL 1 HOUR')} AS ts,
  {r('m + sd * (a * (1 - pow(b, step)) / (1 - b) + pow(b, step) * z.z)', 6)} AS predicted FROM sc
  JOIN z ON z.series_id = sc.series_id AND z.ts = sc.last, line, range(1, 9) s(step)""")
def f13_linear(spark, folder):
    rows = tables.filled_events(spark, folder)
    line = LinearRegression(featuresCol="features", labelCol="_z", predictionCol="_p", solver="normal")
    model, scale = autoregression.fit_autoregression(rows, [1], "hour", line)
    return render(autoregression.recursive_forecast(rows, model, scale, [1], 8, "hour"), 6)


@query("f13_recursive_autoregression")
def f13(spark, folder):
    rows = tables.filled_events(spark, folder)
    used = [1, 2, 3, 24, 25, 48]
    model, scale = autoregression.fit_autoregression(rows, used, "hour")
    return render(autoregression.recursive_forecast(rows, model, scale, used, 62, "hour"), 6)


@query("f14_additive_model")
def f14(spark, folder):
    rows = tables.filled_shipments(spark, folder)
    model = additive.fit_additive(rows, ("yearly", "weekly"))
    out = additive.additive_forecast(rows, model, 40, "day", ("yearly", "weekly"))
    return render(out.select("series_id", "ts", "value", "predicted"), 4)


@query("f15_additive_components")
def f15(spark, folder):
    rows = tables.filled_events(spark, folder)
    model = additive.fit_additive(rows, ("weekly", "daily"))
    return render(additive.additive_components(rows, model, ("weekly", "daily")), 4)


# The boosted set-ups on the hourly table: windows of two weeks, a model for each origin.
HOURLY_BOOSTED = Backtest(train=14 * 24 + 8, valid=40)


def _hourly_boosted(rows, name):
    plan = replace(published.BOOSTED[name], backtest=HOURLY_BOOSTED)
    out = published.run_boosted(rows, plan)
    return render(published.score_days(out, HOURLY_BOOSTED, denominator="predicted").drop("peaks", "peaks_pred"), 6)


@query("backtest_final_model")
def final_model(spark, folder):
    """All 90 inputs, boosted trees, seasonal residual layer."""
    return _hourly_boosted(with_station_weather(spark, folder, tables.filled_events(spark, folder)), "three_years")


@query("backtest_boosted_weekday_columns")
def early_model(spark, folder):
    """One column per weekday, all columns in every tree."""
    return _hourly_boosted(with_station_weather(spark, folder, tables.filled_events(spark, folder)), "two_years")


@query("backtest_boosted_dummies")
def dummy_model(spark, folder):
    """0/1 columns and the highs of the day before, 100 rounds."""
    rows = with_station_weather(spark, folder, tables.filled_events(spark, folder))
    return _hourly_boosted(rows.withColumn("CQT_High", F.col("WJF_High")), "summer")
