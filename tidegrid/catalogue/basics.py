"""Projections, predicates, column tools, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidegrid.catalogue.registry import (DAY_FILLED_CHAIN, DENSE_CHAIN, FILLED_CHAIN, HOURLY, STATION_HOURS,
                                         STATION_ROWS, query, r, render, txt, with_)
from tidegrid.functions import calendar as cal
from tidegrid.functions.stats import any_missing
from tidegrid.functions.text import clean_names, repair_century
from tidegrid.operators import features, grid, impute, metrics, weather
from tidegrid.sources import tables


@query("p1_keep_columns", f"SELECT {txt('ts')} AS ts, {r('value')} AS value FROM events")
def p1(spark, folder):
    return render(tables.table(spark, folder, "events").select("ts", "value"))


@query("p2_drop_columns", f"""SELECT l_orderkey, l_linenumber, {txt('l_shipdate')} AS l_shipdate,
  {r('l_quantity')} AS l_quantity, {r('l_extendedprice')} AS l_extendedprice FROM lineitem""")
def p2(spark, folder):
    return render(tables.table(spark, folder, "lineitem").drop(
        "l_partkey", "l_suppkey", "l_discount", "l_tax", "l_returnflag", "l_linestatus"))


@query("p3_drop_first_column", f"""SELECT {txt('ts')} AS ts, user_id, event_type, {r('value')} AS value,
  props FROM events""")
def p3(spark, folder):
    rows = tables.table(spark, folder, "events")
    return render(rows.drop(rows.columns[0]))


@query("p4_features_by_exclusion", f"""SELECT l_linenumber, {r('l_quantity')} AS l_quantity,
  {r('l_discount')} AS l_discount, {r('l_tax')} AS l_tax FROM lineitem""")
def p4(spark, folder):
    rows = tables.table(spark, folder, "lineitem")
    keep = features.feature_list(rows, ["l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice",
                                        "l_returnflag", "l_linestatus", "l_shipdate"])
    return render(rows.select(*keep))


@query("p6_rename_column", f"SELECT event_type AS station, {r('value')} AS tmpf, {txt('ts')} AS date FROM events")
def p6(spark, folder):
    return render(tables.event_readings(spark, folder).withColumnRenamed("series_id", "station")
                  .withColumnRenamed("value", "tmpf").withColumnRenamed("ts", "date"))


@query("p7_clean_names", f"""SELECT l_returnflag AS return_flag, {r('max(l_quantity)')} AS LAX_High,
  {r('min(l_quantity)')} AS lax_low FROM lineitem GROUP BY 1""")
def p7(spark, folder):
    return render(clean_names(tables.table(spark, folder, "lineitem").groupBy(
        F.col("l_returnflag").alias("return-flag")).agg(
        F.max("l_quantity").alias("LAX- High"), F.min("l_quantity").alias("lax -low"))))


@query("p8_derived_columns", f"""SELECT l_orderkey, l_linenumber, {r('l_quantity * l_quantity', 6)} AS quantity_2,
  {r('l_extendedprice * (1 - l_discount)', 6)} AS net FROM lineitem""")
def p8(spark, folder):
    return render(tables.table(spark, folder, "lineitem").withColumns({
        "quantity_2": F.col("l_quantity") * F.col("l_quantity"),
        "net": F.col("l_extendedprice") * (1 - F.col("l_discount"))}).select(
        "l_orderkey", "l_linenumber", "quantity_2", "net"), 6)


@query("p9_conditional_column", """SELECT l_orderkey, l_linenumber,
  CASE WHEN dayofweek(l_shipdate) + 1 <= 5 THEN 1 ELSE 0 END AS workday FROM lineitem""")
def p9(spark, folder):
    return tables.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", cal.flag(F.dayofweek("l_shipdate") <= 5).alias("workday"))


_SEASON = """CASE WHEN month({0}) IN (3, 4, 5) THEN 1 WHEN month({0}) IN (6, 7, 8) THEN 2
  WHEN month({0}) IN (9, 10, 11) THEN 3 ELSE 4 END"""


@query("p10_nested_conditional", f"""SELECT o_orderkey, {_SEASON.format('o_orderdate')} AS season FROM orders""")
def p10(spark, folder):
    return tables.table(spark, folder, "orders").withColumn("month", F.month("o_orderdate")).select(
        "o_orderkey", cal.season_flags()["season"].alias("season"))


@query("p11_membership", """SELECT o_orderkey, CAST(month(o_orderdate) IN (5, 6, 7, 8, 9) AS INTEGER) AS warm
  FROM orders""")
def p11(spark, folder):
    return tables.table(spark, folder, "orders").select(
        "o_orderkey", F.month("o_orderdate").isin(*cal.WARM_MONTHS).cast("int").alias("warm"))


@query("p12_point_filter", f"""SELECT l_orderkey, l_linenumber, {r('l_extendedprice')} AS price FROM lineitem
  WHERE l_shipdate = TIMESTAMP '1998-07-04 00:00:00'""")
def p12(spark, folder):
    return render(tables.table(spark, folder, "lineitem").where(
        F.col("l_shipdate") == F.lit("1998-07-04 00:00:00").cast("timestamp_ntz")).select(
        "l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("price")))


_WIDE = """wide AS (SELECT ts, avg(value) FILTER (station = 'AFRICA') AS africa,
  avg(value) FILTER (station = 'AMERICA') AS america, avg(value) FILTER (station = 'ASIA') AS asia,
  avg(value) FILTER (station = 'EUROPE') AS europe,
  avg(value) FILTER (station = 'MIDDLE EAST') AS middle_east FROM station_hours GROUP BY ts)"""
_STATION_COLS = ("africa", "america", "asia", "europe", "middle_east")


def _wide(spark, folder):
    hours = grid.bucket_mean(tables.station_readings(spark, folder), "hour", ("station",))
    return weather.stations_wide(hours, tables.STATIONS).toDF("ts", *_STATION_COLS)


@query("p13_rows_with_any_missing", with_(STATION_ROWS, STATION_HOURS, _WIDE) + f"""SELECT {txt('ts')} AS ts,
  {', '.join(f'{r(c)} AS {c}' for c in _STATION_COLS)} FROM wide
  WHERE {' OR '.join(f'{c} IS NULL' for c in _STATION_COLS)}""")
def p13(spark, folder):
    return render(impute.rows_with_missing(_wide(spark, folder), *_STATION_COLS))


@query("p14_rows_with_one_missing", with_(DENSE_CHAIN) + f"""SELECT series_id, {txt('ts')} AS ts FROM dense
  WHERE value IS NULL""")
def p14(spark, folder):
    dense = grid.complete(tables.hourly_events(spark, folder), "hour")
    return render(dense.where(any_missing("value")).select("series_id", "ts"))


@query("p15_range_slice", f"""SELECT event_type AS series_id, {txt('ts')} AS ts, {r('value')} AS value
  FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-12'""")
def p15(spark, folder):
    rows = tables.table(spark, folder, "events").where(
        (F.col("ts") >= F.lit("2024-01-05").cast("timestamp_ntz"))
        & (F.col("ts") < F.lit("2024-01-12").cast("timestamp_ntz")))
    return render(rows.select(F.col("event_type").alias("series_id"), "ts", "value"))


@query("p16_conditional_overwrite", with_(DENSE_CHAIN) + f"""SELECT d.series_id, {txt('d.ts')} AS ts,
  {r('coalesce(d.value, m.v)')} AS value FROM dense d JOIN (SELECT series_id, avg(value) AS v FROM dense
  GROUP BY 1) m ON d.series_id = m.series_id""")
def p16(spark, folder):
    dense = grid.complete(tables.hourly_events(spark, folder), "hour")
    means = dense.groupBy("series_id").agg(F.avg("value").alias("filler"))
    return render(dense.join(means, "series_id").withColumns(
        impute.coalesce_columns({"value": "filler"})).drop("filler"))


@query("p17_bind_columns", """SELECT o_orderkey, """ + ", ".join(
    f"CAST(dayofweek(o_orderdate) + 1 = {k} AS INTEGER) AS day_week_{k}" for k in range(1, 8)) + " FROM orders")
def p17(spark, folder):
    rows = tables.table(spark, folder, "orders").withColumn("day_week", F.dayofweek("o_orderdate"))
    return rows.withColumns(cal.one_hot("day_week", range(1, 8))).select(
        "o_orderkey", *[f"day_week_{k}" for k in range(1, 8)])


@query("p18_many_columns_one_function", f"""SELECT l_orderkey, l_linenumber,
  {', '.join(f"{r(f'{c} * 2 - 1', 6)} AS {c}" for c in ('l_quantity', 'l_discount', 'l_tax'))} FROM lineitem""")
def p18(spark, folder):
    cols = ("l_quantity", "l_discount", "l_tax")
    return render(tables.table(spark, folder, "lineitem").withColumns(
        {c: F.col(c) * 2 - 1 for c in cols}).select("l_orderkey", "l_linenumber", *cols), 6)


@query("o1_sort_by_stamp", f"""SELECT event_type AS series_id, {txt('ts')} AS ts, {r('value')} AS value
  FROM events ORDER BY ts""")
def o1(spark, folder):
    return render(tables.event_readings(spark, folder).orderBy("ts"))


@query("o2_head_slice", with_(DAY_FILLED_CHAIN) + f"""SELECT series_id, {txt('ts')} AS ts, {r('value', 6)} AS value
  FROM (SELECT *, min(ts) OVER (PARTITION BY series_id) AS t0 FROM day_filled)
  WHERE ts < t0 + INTERVAL 1096 DAY""")
def o2(spark, folder):
    rows = tables.filled_shipments(spark, folder)
    start = rows.groupBy("series_id").agg(F.min("ts").alias("t0"))
    return render(rows.join(start, "series_id").where(
        F.col("ts") < F.col("t0") + F.expr("interval 1096 day")).drop("t0"), 6)


@query("o3_peak_hours", with_(FILLED_CHAIN) + f"""SELECT series_id, {txt('CAST(ts AS DATE)')} AS day,
  string_agg(CAST(hour(ts) AS VARCHAR), ' ' ORDER BY hour(ts)) AS peak FROM (SELECT *,
  max(value) OVER (PARTITION BY series_id, CAST(ts AS DATE)) AS top FROM filled) WHERE value = top GROUP BY 1, 2""")
def o3(spark, folder):
    rows = tables.filled_events(spark, folder).withColumns(
        {"day": F.to_date("ts"), "hour": F.hour("ts")})
    return render(rows.groupBy("series_id", "day").agg(
        metrics.peak_text(metrics.peak_hours("value")).alias("peak")))


@query("u1_append_rows", with_(HOURLY) + f"""SELECT series_id, {txt('ts')} AS ts, {r('value')} AS value FROM (
  SELECT * FROM hourly WHERE ts < TIMESTAMP '2024-01-16' UNION ALL
  SELECT * FROM hourly WHERE ts >= TIMESTAMP '2024-01-16')""")
def u1(spark, folder):
    rows = tables.hourly_events(spark, folder)
    cut = F.make_date(F.lit(2024), F.lit(1), F.lit(16))
    return render(rows.where(F.col("ts") < cut).unionByName(rows.where(F.col("ts") >= cut)))


@query("u2_append_scalars", f"""SELECT 'events' AS source, count(*) AS n, {r('avg(value)', 6)} AS mean_value FROM events
  UNION ALL SELECT 'orders', count(*), {r('avg(o_totalprice)', 4)} FROM orders""")
def u2(spark, folder):
    parts = []
    for name, col, digits in (("events", "value", 6), ("orders", "o_totalprice", 4)):
        parts.append(render(tables.table(spark, folder, name).agg(
            F.count(F.lit(1)).alias("n"), F.avg(col).alias("mean_value")), digits).select(
            F.lit(name).alias("source"), "n", "mean_value"))
    return parts[0].unionByName(parts[1])


@query("t1_concatenate", """SELECT l_orderkey, concat_ws('~', l_returnflag, l_linestatus,
  CAST(l_linenumber AS VARCHAR)) AS key FROM lineitem""")
def t1(spark, folder):
    return tables.table(spark, folder, "lineitem").select("l_orderkey", F.concat_ws(
        "~", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string")).alias("key"))


@query("t2_collapse_text", f"""SELECT {txt('CAST(o_orderdate AS DATE)')} AS day,
  string_agg(DISTINCT o_orderpriority, ' ' ORDER BY o_orderpriority) AS priorities FROM orders GROUP BY 1""")
def t2(spark, folder):
    # A set of priorities, of which there are five: bounded whatever the day holds.
    return render(tables.order_readings(spark, folder).groupBy(F.to_date("ts").alias("day")).agg(
        F.array_join(F.array_sort(F.collect_set("series_id")), " ").alias("priorities")))


@query("t3_name_pattern", """SELECT o_orderkey, replace(replace(o_orderpriority, ' ', ''), '-', '_') AS priority
  FROM orders""")
def t3(spark, folder):
    return tables.table(spark, folder, "orders").select("o_orderkey", F.regexp_replace(
        F.regexp_replace("o_orderpriority", " ", ""), "-", "_").alias("priority"))


@query("t4_stamp_as_text", """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS stamp FROM events""")
def t4(spark, folder):
    return tables.table(spark, folder, "events").select(
        "event_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("stamp"))


@query("t5_replace_substring", """SELECT o_orderkey,
  concat('20', substr(strftime(o_orderdate, '%Y-%m-%d'), 3)) AS stamp FROM orders""")
def t5(spark, folder):
    return tables.table(spark, folder, "orders").select(
        "o_orderkey", repair_century(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("stamp"))


@query("t6_positions_of_true", with_(FILLED_CHAIN) + f"""SELECT series_id, {txt('CAST(ts AS DATE)')} AS day,
  string_agg(CAST(hour(ts) AS VARCHAR), ' ' ORDER BY hour(ts)) AS hours_over_60 FROM filled
  WHERE value > 60 GROUP BY 1, 2""")
def t6(spark, folder):
    rows = tables.filled_events(spark, folder).withColumns(
        {"day": F.to_date("ts"), "hour": F.hour("ts")})
    over = F.array_sort(F.collect_list(F.when(F.col("value") > 60, F.col("hour"))))
    return render(rows.groupBy("series_id", "day").agg(metrics.peak_text(over).alias("hours_over_60"))
                  .where("hours_over_60 <> ''"))
