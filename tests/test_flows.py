"""The end-to-end jobs on a small made series."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import hours
from tidegrid.operators import boosted, features
from tidegrid.plans import flows, published
from tidegrid.plans.backtest import Backtest


def readings(days, seed=1):
    rng = random.Random(seed)
    return [100 + 20 * math.sin(2 * math.pi * i / 24) + rng.gauss(0, 1) for i in range(24 * days)]


def test_clean_and_merge(spark, series):
    load = series({"a": [p for i, p in enumerate(hours("2020-01-01 00:00:00", readings(10))) if i not in (30, 31, 77)]})
    station = series({"LAX": hours("2020-01-01 00:20:00", [None if i % 7 == 3 else 60 + i % 24 for i in range(240)]),
                      "RIV": hours("2020-01-01 00:40:00", [70 + i % 24 for i in range(240)])})
    merged = flows.merge_weather(station.select(F.col("series_id").alias("station"), "ts", F.col("value").alias("tmpf")),
                                 ["LAX", "RIV"], parts=("hour",))
    assert merged.count() == 240 and merged.where("mean_temp is null").count() == 0
    clean = flows.clean_load(load, merged.select("ts", F.col("mean_temp").alias("temperature")), parts=("hour",))
    assert clean.columns == ["series_id", "ts", "value", "temperature"]
    assert clean.count() == 240 and clean.where("value is null or temperature is null").count() == 0


def test_boosted_years_write_metrics_and_logs(spark, series, tmp_path):
    load = series({"a": hours("2019-12-01 00:00:00", readings(36))})
    days = load.select(F.to_date("ts").alias("day")).distinct()
    for c in features.FINAL_WEATHER:
        days = days.withColumn(c, 60 + F.dayofmonth("day") * 1.0)
    metrics, log = flows.boosted_years(
        load, days, "day", [2020], str(tmp_path), boosting=boosted.Boosting(rounds=2, depth=2),
        spec=Backtest(train=24 * 20 + 8, valid=40))
    scores = spark.read.csv(metrics, header=True, schema="series_id string, day date, mape double, rmse double, "
                                                         "peak string, peak_pred string, year int", nullValue="NA")
    rows = scores.orderBy("day").collect()
    assert [str(r["day"]) for r in rows] == [f"2020-01-0{d}" for d in range(1, 6)]
    assert all(0 < r["mape"] < 30 and r["peak"] and r["peak_pred"] for r in rows)
    assert spark.read.csv(log, header=True).count() == 5 * 24


def test_smoothing_backtests_score_the_same_days(series):
    load = series({"a": hours("2020-01-01 00:00:00", readings(16))})
    frame = features.load_frame(load.withColumn("temperature", F.hour("ts") * 1.0), lags={"l2": 48, "l3": 72, "l7": 168},
                                need=features.formula_columns("smoothing_layer"))
    out = flows.smoothing_backtests(frame, Backtest(train=24 * 10 + 8))
    found = {n: sorted(str(r["day"]) for r in df.collect()) for n, df in out.items()}
    assert len(set(map(tuple, found.values()))) == 1 and len(found["smoothing"]) == 5


@pytest.mark.parametrize("name", list(features.FORMULAS))
def test_formula_columns_cover_their_terms(name):
    columns = features.formula_columns(name)
    assert all("(" not in c and "^" not in c and ":" not in c for c in columns)
    assert len(features.formula_terms(name)) >= len(features.FORMULAS[name])
    assert name in {p.formula for p in published.REGRESSIONS.values()}
