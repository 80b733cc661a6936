"""Forecasters against brute force on small series, and no look-ahead."""

import math
import random

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from tests.conftest import hours
from tidegrid.functions.solve import lag_set, seasonal_arma_forecast, stable
from tidegrid.operators import (additive, autoregression, diagnostics, ets, features, lags, linear,
                                smoothing)
from tidegrid.plans import published
from tidegrid.plans.backtest import Backtest, horizon_rows, origin_list

SPEC = Backtest(train=24 * 10 + 8)


def wave(n, seed=3, noise=2.0):
    rng = random.Random(seed)
    return [100 + 20 * math.sin(2 * math.pi * i / 24) + 0.05 * i + rng.gauss(0, noise) for i in range(n)]


@pytest.fixture(scope="module")
def load(series):
    return series({"a": hours("2020-01-01 00:00:00", wave(24 * 20)),
                   "b": hours("2020-01-01 00:00:00", wave(24 * 20, seed=9))}).cache()


@pytest.fixture(scope="module")
def frame(load):
    return features.load_frame(load, lags={"l2": 48, "l3": 72}).cache()


def pandas_window(pdf, origin, spec=SPEC):
    """Training and horizon rows of one origin, by position."""
    pdf = pdf.sort_values("ts").reset_index(drop=True)
    at = pdf.index[pdf["ts"] == origin][0] - (spec.score_from - 1)
    return pdf.iloc[at - spec.train:at], pdf.iloc[at:at + spec.horizon]


def test_rolling_fit_equals_plain_least_squares(frame):
    cols = ["l2", "l3", "hour_sin1", "hour_cos1", "hour_3", "trend", "cca"]      # cca is constant
    got = linear.rolling_regression(frame, cols, SPEC, per_chunk=3).toPandas()
    pdf = frame.toPandas()
    assert got.groupby("series_id")["origin"].nunique().min() >= 7
    for (s, o), part in got.groupby(["series_id", "origin"]):
        train, future = pandas_window(pdf[pdf["series_id"] == s], o)
        x = np.column_stack([train[cols].astype(float), np.ones(len(train))])
        beta = np.linalg.lstsq(x, train["value"], rcond=None)[0]
        want = np.column_stack([future[cols].astype(float), np.ones(len(future))]) @ beta
        assert np.allclose(part.sort_values("step")["predicted"], want, rtol=1e-6)


def test_chunk_size_does_not_change_forecasts(frame):
    a = linear.rolling_regression(frame, ["l2", "hour"], SPEC, residual_order=(1, 0, 0), per_chunk=2)
    b = linear.rolling_regression(frame, ["l2", "hour"], SPEC, residual_order=(1, 0, 0), per_chunk=50)
    both = a.join(b.select("series_id", "origin", "step", F.col("predicted").alias("p2")), ["series_id", "origin", "step"])
    assert both.count() == a.count()
    assert both.agg(F.max(F.abs(F.col("predicted") - F.col("p2")))).first()[0] < 1e-8


def test_rolling_fit_equals_spark_ml_on_one_origin(frame):
    spec = Backtest(train=SPEC.train, first="2020-01-15", last="2020-01-15")
    mine = linear.rolling_coefficients(frame.where("series_id = 'a'"), ["l2", "hour"], spec).first()
    o = origin_list(frame.where("series_id = 'a'"), spec).first()
    rows = VectorAssembler(inputCols=["l2", "hour"], outputCol="features").transform(
        frame.where("series_id = 'a'").where(F.col("ts").between(o["train_start"], o["train_end"])))
    theirs = LinearRegression(labelCol="value", solver="normal").fit(rows)
    assert mine["n"] == rows.count()
    assert mine["coefficients"] == pytest.approx(list(theirs.coefficients), rel=1e-6)
    assert mine["intercept"] == pytest.approx(theirs.intercept, rel=1e-6)
    left = linear.training_residuals(frame.where("series_id = 'a'"), linear.rolling_coefficients(
        frame.where("series_id = 'a'"), ["l2", "hour"], spec), ["l2", "hour"], spec)
    joined = left.join(frame, ["series_id", "ts"])
    r = joined.agg(F.sum("residual"), F.sum(F.col("residual") * F.col("l2")), F.sum(F.col("residual") * F.col("hour"))).first()
    assert max(abs(v) for v in r) < 1e-5


def test_expanding_window_fit(frame):
    spec = Backtest(train=24 * 8 + 8, expanding=True)
    got = linear.rolling_regression(frame.where("series_id = 'a'"), ["l2", "hour"], spec, per_chunk=4).toPandas()
    pdf = frame.where("series_id = 'a'").toPandas().sort_values("ts").reset_index(drop=True)
    start = origin_list(frame.where("series_id = 'a'"), spec).first()["train_start"]
    for o, part in got.groupby("origin"):
        at = pdf.index[pdf["ts"] == o][0] - 16
        train = pdf.iloc[pdf.index[pdf["ts"] == start][0]:at]
        x = np.column_stack([train[["l2", "hour"]].astype(float), np.ones(len(train))])
        beta = np.linalg.lstsq(x, train["value"], rcond=None)[0]
        want = np.column_stack([pdf.iloc[at:at + 40][["l2", "hour"]].astype(float), np.ones(40)]) @ beta
        assert np.allclose(part.sort_values("step")["predicted"], want, rtol=1e-6)


def test_rows_with_missing_features_do_not_train(frame):
    holed = frame.withColumn("l2", F.when(F.hour("ts") != 3, F.col("l2")))
    spec = Backtest(train=SPEC.train, first="2020-01-15", last="2020-01-15")
    got = linear.rolling_coefficients(holed, ["l2"], spec).where("series_id = 'a'").first()
    o = origin_list(frame.where("series_id = 'a'"), spec).first()
    want = holed.where("series_id = 'a' and l2 is not null").where(
        F.col("ts").between(o["train_start"], o["train_end"])).agg(F.count("l2"), F.regr_slope("value", "l2")).first()
    assert got["n"] == want[0] and got["coefficients"][0] == pytest.approx(want[1], rel=1e-9)


def test_incomplete_grid_is_refused(frame):
    with pytest.raises(Exception, match="complete grid"):
        linear.rolling_regression(frame.where(F.col("trend") != 200), ["l2"], SPEC).collect()


@pytest.mark.parametrize("name", ["expanding", "rolling_quarter", "smoothing_layer"])
def test_no_look_ahead(load, name):
    """Changing every value after the cut-off leaves the forecast as it is. Lags of
    two days or more keep even the inputs of the horizon behind the cut-off."""
    day = "2020-01-15"
    plan = published.with_backtest(published.REGRESSIONS[name], train=SPEC.train, first=day, last=day)
    cut = F.to_timestamp(F.lit("2020-01-14 07:00:00"))
    changed = load.withColumn("value", F.when(F.col("ts") > cut, F.col("value") * 3 + 7).otherwise(F.col("value")))

    def forecast(rows):
        made = features.load_frame(rows.withColumn("temperature", F.hour("ts") * 1.0), lags={"l2": 48, "l3": 72, "l7": 168})
        out = published.run_regression(made, plan).orderBy("series_id", "step").collect()
        return [r["predicted"] for r in out]

    assert forecast(load) == pytest.approx(forecast(changed), rel=1e-9)
    assert len(forecast(load)) == 80


def test_smoothing_equals_the_recursion(series, load):
    tiny = series({"t": hours("2020-01-01 00:00:00", [1, 2, 3])})
    got = smoothing.smoothing_levels(tiny, 0.1, "hour").orderBy("ts").collect()
    assert [r["level"] for r in got] == pytest.approx([1, 1.1, 1.29])
    assert got[0]["error"] is None and [r["error"] for r in got[1:]] == pytest.approx([1, 1.9])
    for alpha in (0.1, 0.5, 0.95, 1.0):
        pdf = load.where("series_id = 'a'").toPandas().sort_values("ts")
        out = smoothing.smoothing_forecast(load, SPEC, alpha).where("series_id = 'a'").toPandas()
        for o, part in out.groupby("origin"):
            train, _ = pandas_window(pdf, o)
            level = train["value"].iloc[0]
            for y in train["value"].iloc[1:]:
                level = alpha * y + (1 - alpha) * level
            assert part["predicted"].tolist() == pytest.approx([level] * 40, rel=1e-10)


def test_smoothing_over_many_blocks(series):
    rng = random.Random(1)
    y = [rng.random() * 100 for _ in range(3000)]
    df = series({"a": hours("2020-01-01 00:00:00", y)})
    got = [r["level"] for r in smoothing.smoothing_levels(df, 0.8, "hour").orderBy("ts").collect()]   # blocks of 248 rows
    level, want = y[0], [y[0]]
    for v in y[1:]:
        level = 0.8 * v + 0.2 * level
        want.append(level)
    assert got == pytest.approx(want, rel=1e-10)


@pytest.mark.parametrize("alpha", [0.001, 0.1])
def test_smoothing_forgets_nothing(spark, alpha):
    """Seven years of hours and a hole of two of them: sums equal the recursion from the first row on."""
    rng = np.random.default_rng(5)
    at = np.concatenate([np.arange(30_000), np.arange(48_000, 61_320)])
    y = rng.random(len(at)) * 100 + 1e6 * (at < 100)
    df = spark.createDataFrame([("a", int(t), float(v)) for t, v in zip(at, y)], "series_id string, h long, value double").select(
        "series_id", F.timestamp_seconds(F.col("h") * 3600).alias("ts"), "value")
    got = [r["smoothed"] for r in smoothing.smoothed_sums(df, alpha, "hour").orderBy("ts").collect()]
    total, want, last = 0.0, [], at[0]
    for t, v in zip(at, y):
        total = total * (1 - alpha) ** int(t - last) + alpha * v
        want.append(total)
        last = t
    assert got == pytest.approx(want, rel=1e-8)


def test_smoothing_layer_equals_the_recursion(frame):
    """Regression on one-step errors of each window, plus the last level."""
    rows = smoothing.smoothed_sums(frame.select("series_id", "ts", "value", "l2"), 0.1, "hour")
    out = linear.rolling_regression(rows, ["l2"], SPEC, smoothing=0.1).where("series_id = 'a'").toPandas()
    pdf = frame.where("series_id = 'a'").toPandas()
    for o, part in out.groupby("origin"):
        train, future = pandas_window(pdf, o)
        level, errors = train["value"].iloc[0], [0.0]
        for y in train["value"].iloc[1:]:
            errors.append(y - level)
            level = 0.1 * y + 0.9 * level
        slope, intercept = np.polyfit(train["l2"].astype(float), errors, 1)
        want = level + intercept + slope * future["l2"].to_numpy(dtype=float)
        assert part.sort_values("step")["predicted"].tolist() == pytest.approx(want.tolist(), rel=1e-8)


def test_ets_equals_a_plain_loop(load):
    spec = Backtest(train=60, first="2020-01-12", last="2020-01-14")
    got = ets.ets_models(load, spec).where("series_id = 'a'").toPandas()
    pdf = load.where("series_id = 'a'").toPandas()
    assert len(got) == 3
    for row in got.to_dict("records"):
        z = pandas_window(pdf, row["origin"], spec)[0]["value"].tolist()
        best = None
        for form, alpha, beta, phi, k in ets.candidates():
            l, b, sse, n = z[0], 0.0 if form == "ANN" else (z[10] - z[0]) / 10, 0.0, len(z) - 1
            for y in z[1:]:
                e = y - l - phi * b
                l, b, sse = l + phi * b + alpha * e, phi * b + beta * e, sse + e * e
            score = n * math.log(sse) + 2 * k + 2 * k * (k + 1) / (n - k - 1)
            if best is None or score < best[0]:
                best = (score, form, alpha, beta, phi, l, b)
        assert (row["form"], row["alpha"], row["beta"], row["phi"]) == best[1:5]
        assert (row["aicc"], row["l"], row["b"]) == pytest.approx((best[0], best[5], best[6]), rel=1e-9)


def test_ets_box_cox_parameter_matches_the_relational_one(load):
    spec = Backtest(train=240, first="2020-01-14", last="2020-01-14")
    one = load.where("series_id = 'a'")
    per_window = ets.ets_models(one, spec, ("AAdN",), lam="auto", lambda_period=24).first()["lam"]
    o = origin_list(one, spec).first()
    whole = smoothing.guerrero_lambda(one.where(F.col("ts").between(o["train_start"], o["train_end"])), 24, "hour")
    assert per_window == pytest.approx(whole.first()["lam"])
    out = ets.ets_forecast(one, spec, ("AAdN",), lam="auto").collect()
    assert all(r["lower"] <= r["predicted"] <= r["upper"] for r in out) and len(out) == 40


def test_interval_level_zero_is_degenerate(load):
    out = ets.ets_forecast(load, Backtest(train=60, first="2020-01-12", last="2020-01-12"), ("ANN",), z=0.0).collect()
    assert all(r["lower"] == r["predicted"] == r["upper"] for r in out)


def test_residual_arma_recovers_an_autoregression():
    rng = np.random.default_rng(5)
    x = np.zeros(6000)
    for t in range(25, len(x)):
        x[t] = 0.6 * x[t - 1] + 0.3 * x[t - 24] - 0.18 * x[t - 25] + rng.normal()
    got = seasonal_arma_forecast(x + 50, 40, (1, 0, 0), (1, 0, 0), 24)
    want, past = [], list(x)
    for _ in range(40):
        past.append(0.6 * past[-1] + 0.3 * past[-24] - 0.18 * past[-25])
        want.append(past[-1] + 50)
    assert np.abs(got - want).max() < 0.6
    assert lag_set(1, 1, 24) == [1, 24, 25] and lag_set(2, 0, 24) == [1, 2]


def test_residual_arma_with_shocks_and_differences():
    rng = np.random.default_rng(2)
    e = rng.normal(size=5000)
    x = np.zeros(5000)
    for t in range(1, 5000):
        x[t] = 0.5 * x[t - 1] + e[t] + 0.4 * e[t - 1]
    assert seasonal_arma_forecast(x, 1, (1, 0, 1), (0, 0, 0))[0] == pytest.approx(0.5 * x[-1] + 0.4 * e[-1], abs=0.25)
    season = np.tile(np.arange(24.0), 30)
    assert seasonal_arma_forecast(season, 48, (0, 0, 0), (0, 1, 0), 24) == pytest.approx(np.tile(np.arange(24.0), 2))
    line = np.arange(100.0)
    assert seasonal_arma_forecast(line, 5, (1, 1, 0), (0, 0, 0))[-1] == pytest.approx(104.0)
    assert np.isfinite(seasonal_arma_forecast(np.arange(5.0), 40, (2, 0, 1), (2, 1, 0))).all()
    assert abs(stable(np.array([1.2]), [1])[0]) < 1


def test_summary_equals_spark_ml(frame):
    one = frame.where("series_id = 'a'")
    got = {r["term"]: r for r in linear.regression_summary(one, ["l2", "hour_sin1"]).collect()}
    rows = VectorAssembler(inputCols=["l2", "hour_sin1"], outputCol="features").transform(one)
    s = LinearRegression(labelCol="value", solver="normal").fit(rows).summary
    assert got["l2"]["r2"] == pytest.approx(s.r2, rel=1e-8)
    assert [got[t]["std_error"] for t in ("l2", "hour_sin1", "(Intercept)")] == pytest.approx(
        s.coefficientStandardErrors, rel=1e-6)
    assert [got[t]["t_value"] for t in ("l2", "hour_sin1", "(Intercept)")] == pytest.approx(s.tValues, rel=1e-5)


def test_additive_components_sum_and_follow_the_series(load):
    model = additive.fit_additive(load, ("daily",), hinges=5)
    out = additive.additive_forecast(load, model, 40, "hour", ("daily",), hinges=5)
    assert out.where("value is null").count() == 80
    r = out.agg(F.max(F.abs(F.col("trend") + F.col("daily") - F.col("predicted"))),
                F.avg(F.abs(F.col("value") - F.col("predicted"))), F.avg("value")).first()
    assert r[0] < 1e-9 and r[1] < 0.03 * r[2]


def test_autoregression_with_a_linear_regressor(series):
    """On a noise-free autoregression the recursion continues the series."""
    y = [0.0, 1.0]
    for _ in range(200):
        y.append(1.6 * y[-1] - 0.95 * y[-2] + 1.0)
    df = series({"a": hours("2020-01-01 00:00:00", y[:180])})
    model, scale = autoregression.fit_autoregression(df, [1, 2], "hour", LinearRegression(
        featuresCol="features", labelCol="_z", predictionCol="_p", solver="normal"))
    got = autoregression.recursive_forecast(df, model, scale, [1, 2], 10, "hour", cut_every=4).orderBy("step").collect()
    assert [r["predicted"] for r in got] == pytest.approx(y[180:190], rel=1e-5)
    assert str(got[0]["ts"]) == "2020-01-08 12:00:00"


def test_autocorrelation_and_partial(load):
    pdf = load.where("series_id = 'a'").toPandas().sort_values("ts")["value"].to_numpy()
    x = pdf - pdf.mean()
    got = {r["lag"]: r["acf"] for r in diagnostics.autocorrelation(load.where("series_id = 'a'"), 30, "hour").collect()}
    for k in (1, 2, 24, 30):
        assert got[k] == pytest.approx((x[k:] * x[:-k]).sum() / (x * x).sum())
    rho = np.array([1.0] + [got[k] for k in range(1, 6)])
    pacf = {r["lag"]: r["pacf"] for r in diagnostics.partial_autocorrelation(load.where("series_id = 'a'"), 5, "hour").collect()}
    for k in range(1, 6):
        r = np.array([[rho[abs(i - j)] for j in range(k)] for i in range(k)])
        assert pacf[k] == pytest.approx(np.linalg.solve(r, rho[1:k + 1])[-1])


def test_difference_order_tells_a_walk_from_noise(series):
    rng = random.Random(4)
    noise = [rng.gauss(0, 1) for _ in range(600)]
    walk = list(np.cumsum(noise))
    df = series({"noise": hours("2020-01-01 00:00:00", noise), "walk": hours("2020-01-01 00:00:00", walk)})
    got = {r["series_id"]: r["ndiffs"] for r in diagnostics.difference_order(df, "hour").collect()}
    assert got == {"noise": 0, "walk": 1}
    strong = diagnostics.seasonal_strength(series({"s": hours("2020-01-01 00:00:00", wave(480, noise=1.0))}), 24, "hour").first()
    assert strong["nsdiffs"] == 1 and strong["strength"] > 0.9
