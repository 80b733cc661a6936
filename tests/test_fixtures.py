"""Edge cases of cleaning, calendar, lags, peaks and metrics on hand-made rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.conftest import hours
from tidegrid.functions import calendar as cal
from tidegrid.functions import text
from tidegrid.functions.stats import row_mean
from tidegrid.operators import features, grid, impute, lags, metrics
from tidegrid.plans import backtest as bt


def values(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_duplicate_stamps_take_their_mean(series):
    df = series({"a": [("2014-11-02 01:00:00", 10), ("2014-11-02 01:00:00", 20), ("2014-11-02 02:00:00", 5)]})
    assert values(grid.collapse_duplicates(df).orderBy("ts"), "value") == [(15.0,), (5.0,)]


def test_null_duplicate_spoils_the_mean(series):
    df = series({"a": [("2014-11-02 01:00:00", 10), ("2014-11-02 01:00:00", None)]})
    assert values(grid.collapse_duplicates(df), "value") == [(None,)]
    assert values(grid.collapse_duplicates(df, skip_null=True), "value") == [(10.0,)]


def test_row_mean_is_null_with_one_null(spark):
    df = spark.createDataFrame([(1.0, 2.0, 6.0), (1.0, None, 6.0)], "a double, b double, c double")
    assert values(df.select(row_mean("a", "b", "c").alias("m")), "m") == [(3.0,), (None,)]


def test_gaps_are_completed_and_filled(series):
    points = [p for i, p in enumerate(hours("2020-01-01 00:00:00", range(34))) if i not in (3, 4, 5)]
    dense = grid.complete(series({"a": points}), "hour", mark=True)
    assert dense.count() == 34
    filled = impute.calendar_fill(dense, ("hour",), source=True).orderBy("ts").collect()
    assert [r["value"] for r in filled[3:6]] == [27.0, 28.0, 29.0]
    assert {r["fill_source"] for r in filled[3:6]} == {"calendar"}
    assert all(r["value"] is not None for r in filled)


def test_empty_calendar_cell_takes_the_cell_before(series):
    points = hours("2016-02-29 12:00:00", [1, 2, None, 4])
    dense = grid.complete(series({"a": [p for p in points if p[1] is not None]}), "hour", mark=True)
    got = impute.calendar_fill(dense, source=True).orderBy("ts").collect()
    assert [(r["value"], r["fill_source"]) for r in got] == [
        (1.0, "observed"), (2.0, "observed"), (2.0, "fallback"), (4.0, "observed")]


def test_null_reading_spoils_its_calendar_cell_but_an_absent_hour_does_not(series):
    points = [("2020-01-01 05:00:00", 10), ("2020-01-01 06:00:00", 11), ("2020-01-02 05:00:00", None),
              ("2020-01-03 05:00:00", 20)]
    dense = grid.complete(series({"a": points}), "hour", mark=True)
    got = {str(r["ts"]): r["value"] for r in impute.calendar_fill(dense, ("hour",)).collect()}
    # Its cell is spoiled; the circle before it is empty back to hour 6.
    assert got["2020-01-02 05:00:00"] == 11.0
    assert got["2020-01-02 06:00:00"] == 11.0       # absent hour: mean of what was observed


@pytest.mark.parametrize("block_seconds", [3600, 7200, 86400])
def test_moving_average_fill_grows_to_two_values(series, block_seconds):
    df = series({"a": hours("2020-01-01 00:00:00", [1, None, 3, None, None, 6]),
                 "b": hours("2020-01-01 00:00:00", [None, 7, None])})
    got = impute.moving_average_fill(df, ["value"], block_seconds=block_seconds).orderBy("series_id", "ts").collect()
    assert [r["value"] for r in got[:6]] == pytest.approx([1, 2, 3, 4.2, 4.8, 6])
    assert [r["value"] for r in got[6:]] == [None, 7.0, None]


def test_moving_average_fill_equals_a_plain_loop(series):
    import random
    rng = random.Random(7)
    raw = [rng.choice([None, None, None, round(rng.random() * 100, 2)]) for _ in range(200)]

    def loop(v):
        out = list(v)
        for i, x in enumerate(v):
            if x is None:
                for k in range(1, len(v)):
                    near = [(abs(j - i), v[j]) for j in range(max(0, i - k), min(len(v), i + k + 1)) if v[j] is not None]
                    if len(near) >= 2:
                        out[i] = sum(y / (d + 1) for d, y in near) / sum(1 / (d + 1) for d, _ in near)
                        break
        return out

    df = series({"a": hours("2020-01-01 00:00:00", raw)})
    got = [r["value"] for r in impute.moving_average_fill(df, ["value"], block_seconds=5 * 3600).orderBy("ts").collect()]
    assert got == pytest.approx(loop(raw))


def test_lag_is_zero_padded(series):
    df = lags.add_lags(series({"a": hours("2020-01-01 00:00:00", range(1, 61))}), {"l2": 48}, "hour", block=10)
    got = [r["l2"] for r in df.orderBy("ts").collect()]
    assert got == [0.0] * 48 + [float(i) for i in range(1, 13)]


def test_leap_year_and_weekday(series):
    df = series({"a": [("2016-12-31 00:00:00", 1), ("2017-01-01 00:00:00", 1)]}).withColumns(cal.calendar_parts())
    rows = df.withColumns(cal.weekday_flags()).orderBy("ts").collect()
    assert (rows[0]["day_year"], rows[0]["day_week"]) == (366, 7)
    assert (rows[1]["day_week"], rows[1]["is_sunday"], rows[1]["is_sun_to_thu"]) == (1, 1, 1)


def test_hour_flags_hold_at_several_hours(spark):
    df = spark.range(24).select(F.col("id").cast("int").alias("hour")).withColumns(cal.hour_flags())
    true = {n: [r["hour"] for r in df.where(f"{n} = 1").orderBy("hour").collect()] for n in cal.HOUR_FLAGS}
    assert true["twenty"] == [0, 20] and true["nineteen"] == [0, 19] and true["eighteen"] == [0, 18]
    assert true["eleven"] == [11] and true["ten"] == [10] and true["four"] == [4]


def test_holidays_of_2017_and_flag(spark):
    got = [str(r["holiday_date"]) for r in cal.holidays(spark, 2014, 2019).orderBy("holiday_date").collect()]
    assert len(got) == 36
    assert [d for d in got if d.startswith("2017")] == [
        "2017-01-01", "2017-04-14", "2017-07-04", "2017-09-04", "2017-11-23", "2017-12-25"]
    days = spark.sql("select explode(sequence(timestamp'2014-01-01', timestamp'2019-12-31', interval 1 day)) ts")
    assert sorted(str(r["ts"].date()) for r in days.where(cal.is_holiday() == 1).collect()) == got


def test_easter_over_a_century(spark):
    def easter(y):
        a, b, c = y % 19, y // 100, y % 100
        d, e = divmod(b, 4)
        g = (8 * b + 13) // 25
        h = (19 * a + b - d - g + 15) % 30
        i, k = divmod(c, 4)
        m = (a + 11 * h) // 319
        r = (2 * e + 2 * i - k - h + m + 32) % 7
        n = (h - m + r + 90) // 25
        return dt.date(y, n, (h - m + r + n + 19) % 32)

    got = spark.range(1950, 2050).select(F.col("id").cast("int").alias("y")).select(
        "y", cal.easter_sunday(F.col("y")).alias("d")).collect()
    assert all(r["d"] == easter(r["y"]) for r in got)


def test_peak_ties_and_missing_day(spark):
    rows = [("d1", h, 9.0 if h in (18, 19) else 1.0, 9.0 if h == 19 else 2.0) for h in range(24)]
    rows += [("d2", h, None, float(h == 1)) for h in range(24)]
    df = spark.createDataFrame(rows, "day string, hour int, actual double, predicted double")
    got = {r["day"]: r for r in metrics.with_peak_hits(metrics.daily_scores(df, ("day",))).collect()}
    assert (got["d1"]["peak"], got["d1"]["peak_pred"]) == ("18 19", "19")
    assert (got["d1"]["hit_exact"], got["d1"]["hit_any"], got["d1"]["hit_near"], got["d1"]["tied"]) == (0, 1, 1, 1)
    assert (got["d2"]["peak"], got["d2"]["peak_pred"]) == ("", "1")
    assert got["d2"]["mape"] is None and got["d2"]["hit_any"] is None


def test_percent_error_depends_on_the_denominator(spark):
    df = spark.createDataFrame([(1, 100.0, 80.0)], "k int, actual double, predicted double")
    assert metrics.errors(df, ["k"]).first()["mape"] == pytest.approx(20.0)
    other = metrics.errors(df, ["k"], denominator="predicted").first()
    assert (other["mape"], other["me"]) == (pytest.approx(25.0), pytest.approx(-20.0))


def test_yearly_summary_skips_days_without_score(spark):
    df = spark.createDataFrame([(2019, 1.5, 10.0), (2019, 2.5, 20.0), (2019, None, None)],
                               "year int, mape double, rmse double")
    r = metrics.yearly_summary(df).first()
    assert (r["days"], r["mean_mape"], r["mean_rmse"], r["days_under_threshold"]) == (2, 2.0, 15.0, 1)


def test_horizon_and_window_of_an_origin(series):
    df = series({"a": hours("2020-01-01 00:00:00", range(24 * 20))})
    spec = bt.Backtest(train=24 * 7 + 8, valid=32, first="2020-01-10", last="2020-01-10")
    origin = bt.origin_list(df, spec).first()
    assert str(origin["train_end"]) == "2020-01-09 07:00:00"
    assert str(origin["train_start"]) == "2020-01-02 00:00:00"
    rows = bt.horizon_rows(df, spec).orderBy("step").collect()
    assert [r["step"] for r in rows] == list(range(1, 41))
    assert (str(rows[0]["ts"]), str(rows[16]["ts"]), str(rows[39]["ts"])) == (
        "2020-01-09 08:00:00", "2020-01-10 00:00:00", "2020-01-10 23:00:00")
    train = bt.training_rows(df, spec)
    assert train.count() == 24 * 7 + 8 and train.where("is_valid").count() == 32
    assert str(train.where("is_valid").agg(F.min("ts")).first()[0]) == "2020-01-08 00:00:00"


def test_year_anchor_rows(spark):
    got = spark.range(1).select(*[bt.year_anchor(y) for y in (2017, 2018, 2019)]).first()
    assert tuple(got) == (26305, 35065, 43825)


def test_expanding_window_keeps_its_start(series):
    df = series({"a": hours("2020-01-01 00:00:00", range(24 * 12))})
    spec = bt.Backtest(train=24 * 4 + 8, expanding=True)
    rows = bt.training_rows(df, spec).groupBy("origin").agg(F.min("ts").alias("a"), F.count("ts").alias("n")).orderBy("origin").collect()
    assert len({r["a"] for r in rows}) == 1
    assert [r["n"] for r in rows] == [24 * 4 + 8 + 24 * i for i in range(len(rows))] and len(rows) > 3


def test_final_feature_list_has_90_distinct_names():
    assert len(features.FINAL_FEATURES) == len(set(features.FINAL_FEATURES)) == 90


def test_text_repairs(spark):
    df = spark.createDataFrame([("0014-03-05 07:30:59", "3/5/2014 7:30", "bad")], "a string, b string, c string")
    r = df.select(text.parse_minute(text.repair_century("a")).alias("a"),
                  text.parse_any("b", text.SLASH_FORMAT, text.MINUTE_FORMAT).alias("b"),
                  text.parse_any("c", text.SLASH_FORMAT, text.MINUTE_FORMAT).alias("c")).first()
    assert str(r["a"]) == str(r["b"]) == "2014-03-05 07:30:00" and r["c"] is None
    assert text.clean_names(spark.createDataFrame([(1, 2)], ["LAX High", "riv- low"])).columns == ["LAXHigh", "riv_low"]
