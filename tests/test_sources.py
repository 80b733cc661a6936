"""Landed files and sinks."""

import glob
import os

from pyspark.sql import functions as F

from tests.conftest import hours
from tidegrid.operators import weather
from tidegrid.session import checkpointed, fresh_path, shared_folder
from tidegrid.sources import files, sinks


def test_metrics_file_with_missing_day(spark, tmp_path):
    path = tmp_path / "metrics.csv"
    path.write_text('"","Date","MAPE","RMSE","peak","peak_pred"\n'
                    '"1",2019-09-01,1.785,343.7,"16","17"\n"2",2019-09-02,NA,NA,"","1"\n')
    rows = files.read_metrics(spark, str(path)).orderBy("Date").collect()
    assert rows[0].asDict() == {"Date": rows[0]["Date"], "MAPE": 1.785, "RMSE": 343.7, "peak": "16", "peak_pred": "17"}
    assert (rows[1]["MAPE"], rows[1]["peak"], rows[1]["peak_pred"]) == (None, "", "1")


def test_load_file_and_round_trip(spark, series, tmp_path):
    (tmp_path / "load.csv").write_text("Date,load,zone\n2014-01-01 00:00:59,10,A\n2014-01-01 01:00,NA,A\n")
    rows = files.read_load(spark, str(tmp_path / "load.csv")).orderBy("ts").collect()
    assert [(str(r["ts"]), r["value"], r["series_id"]) for r in rows] == [
        ("2014-01-01 00:00:00", 10.0, "A"), ("2014-01-01 01:00:00", None, "A")]
    df = series({"b": hours("2020-01-01 00:00:00", [1, None, 3]), "a": hours("2020-01-01 00:00:00", [5])})
    for fmt in ("csv", "parquet"):
        path = sinks.write_series(df, str(tmp_path / f"out_{fmt}"), fmt)
        back = files.read_csv(spark, path, "series_id string, ts timestamp, value double") if fmt == "csv" else spark.read.parquet(path)
        assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_empty_text_survives_the_metrics_sink(spark, tmp_path):
    df = spark.createDataFrame([("2019-09-02", None, "", "1")], "day string, mape double, peak string, peak_pred string").withColumn(
        "day", F.to_date("day"))
    path = sinks.write_by_year(df, str(tmp_path / "m"), "day")
    assert os.path.isdir(f"{path}/year=2019")
    r = files.read_csv(spark, path, "day date, mape double, peak string, peak_pred string, year int").first()
    assert (r["mape"], r["peak"], r["peak_pred"], r["year"]) == (None, "", "1", 2019)


def test_station_folders_prune_and_slice(spark, series, tmp_path):
    df = series({"LAX": hours("2020-01-01 00:00:00", range(48)), "RIV": hours("2020-01-01 00:00:00", range(48))})
    path = sinks.write_stations(df.select(F.col("series_id").alias("station"), "ts", F.col("value").alias("tmpf")),
                                str(tmp_path / "st"))
    assert {os.path.basename(p) for p in glob.glob(f"{path}/station=*")} == {"station=LAX", "station=RIV"}
    day = files.read_stations(spark, path, F.to_timestamp(F.lit("2020-01-02")), columns=("tmpf",), ts="ts")
    assert day.where("station = 'LAX'").count() == 24
    plan = day.where("station = 'LAX'")._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "station" in filters and "day" in filters
    read = {r[0].split("day=")[1][:10] for r in day.select(F.input_file_name()).distinct().collect()}
    assert read == {"2020-01-02"}


def test_a_month_is_written_by_as_many_tasks_as_its_rows_ask_for(spark, tmp_path):
    df = spark.range(1000).select(F.col("id").alias("series_id"), F.when(F.col("id") < 990, F.to_timestamp(F.lit("2020-01-05"))).when(
        F.col("id") < 999, F.to_timestamp(F.lit("2021-03-05"))).alias("ts"), F.lit(1.0).alias("load"))
    # Adaptive execution may merge parts that are small in bytes, as all are here.
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        path = sinks.write_by_year(df, str(tmp_path / "log"), "ts", fmt="parquet", rows=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files_of = {y: [spark.read.parquet(f).count() for f in glob.glob(f"{path}/year={y}/*.parquet")] for y in ("2020", "2021", "__HIVE_DEFAULT_PARTITION__")}
    assert sum(files_of["2020"]) == 990 and max(files_of["2020"]) < 500 and 3 <= len(files_of["2020"]) <= 10
    assert files_of["2021"] == [9] and files_of["__HIVE_DEFAULT_PARTITION__"] == [1]


def test_daily_weather_names(spark, tmp_path):
    (tmp_path / "w.csv").write_text("Date,LAX -High,riv low\n2014-01-01,70,NA\n")
    r = files.read_daily_weather(spark, str(tmp_path / "w.csv")).first()
    assert (str(r["Date"]), r["LAX_High"], r["rivlow"]) == ("2014-01-01", 70.0, None)


def test_station_code_from_file_name(spark, tmp_path):
    (tmp_path / "LAXtemperature.csv").write_text("date,tmpf\n2014-01-01,1\n")
    (tmp_path / "RIVtemperature_2.csv").write_text("date,tmpf\n2014-01-01,2\n")
    df = spark.read.csv(str(tmp_path), header=True, schema="date string, tmpf double").select(files.file_station(), "tmpf")
    assert sorted(map(tuple, df.collect())) == [("LAX", 1.0), ("RIV", 2.0)]


def test_stations_fill_and_mean(series):
    df = series({"A": [("2020-01-01 00:00:00", 1), ("2020-01-02 00:00:00", 3)], "B": [("2020-01-01 00:00:00", 10)]})
    rows = df.withColumnRenamed("series_id", "station")
    bounds = rows.agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    wide = weather.stations_on_grid(rows, bounds, ["A", "B"], "day")
    got = weather.filled_station_mean(wide, ["A", "B"], ("hour",)).orderBy("ts").collect()
    assert [(r["A"], r["B"], r["mean_temp"]) for r in got] == [(1.0, 10.0, 5.5), (3.0, 10.0, 6.5)]


def test_shared_folder_comes_from_the_session(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert fresh_path(spark, "x") != fresh_path(spark, "x")
    assert checkpointed(spark.range(3)).count() == 3
