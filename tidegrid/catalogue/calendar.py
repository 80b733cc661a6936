"""Date and time functions, and the holiday calendar."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from tidegrid.catalogue.registry import query, render, txt
from tidegrid.functions import calendar as cal
from tidegrid.functions import text
from tidegrid.sources import tables


def _events(spark, folder):
    return tables.table(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def _orders(spark, folder):
    return tables.table(spark, folder, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"))


@query("d1_parse_minute", f"""SELECT event_id, {txt("date_trunc('minute', ts)")} AS ts FROM events""")
def d1(spark, folder):
    stamps = _events(spark, folder).withColumn("s", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"))
    return render(stamps.select("event_id", text.parse_minute("s").alias("ts")))


@query("d2_parse_any_format", f"""SELECT event_id, {txt("date_trunc('minute', ts)")} AS ts FROM events""")
def d2(spark, folder):
    mixed = _events(spark, folder).withColumn("s", F.when(
        F.hour("ts") < 12, F.date_format("ts", text.SLASH_FORMAT)).otherwise(
        F.date_format("ts", text.MINUTE_FORMAT)))
    return render(mixed.select("event_id", text.parse_any(
        "s", text.SLASH_FORMAT, text.MINUTE_FORMAT).alias("ts")))


@query("d3_century_repair", f"""SELECT event_id, {txt("date_trunc('minute', ts)")} AS ts FROM events""")
def d3(spark, folder):
    broken = _events(spark, folder).withColumn("s", F.concat(
        F.lit("00"), F.date_format("ts", "yy-MM-dd HH:mm")))
    return render(broken.select("event_id", text.parse_minute(text.repair_century("s")).alias("ts")))


# query name: (part of the library, SQL on the raw stamp)
_PARTS = {
    "d4_hour": ("hour", "hour(ts)"),
    "d5_day_of_week": ("day_week", "dayofweek(ts) + 1"),
    "d6_day_of_month": ("day_month", "day(ts)"),
    "d7_month": ("month", "month(ts)"),
    "d8_day_of_year": ("day_year", "dayofyear(ts)"),
    "d9_quarter": ("quarter", "quarter(ts)"),
    "d10_year": ("year", "year(ts)"),
    "d18_six_hour_block": ("six_hour_block", "floor(hour(ts) / 6)"),
}


def _part_query(part):
    def run(spark, folder):
        return _events(spark, folder).select("event_id", cal.calendar_parts()[part].alias(part))
    return run


for _name, (_part, _sql) in _PARTS.items():
    query(_name, f"SELECT event_id, CAST({_sql} AS INTEGER) AS {_part} FROM events")(_part_query(_part))


@query("d11_to_date", f"SELECT event_id, {txt('CAST(ts AS DATE)')} AS day FROM events")
def d11(spark, folder):
    return render(_events(spark, folder).select("event_id", F.to_date("ts").alias("day")))


@query("d12_add_days", f"SELECT o_orderkey, {txt('CAST(o_orderdate + INTERVAL 40 DAY AS DATE)')} AS day FROM orders")
def d12(spark, folder):
    return render(_orders(spark, folder).select("o_orderkey", F.date_add(F.to_date("ts"), 40).alias("day")))


@query("d13_date_flag", """SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) > DATE '1999-03-01' AS INTEGER) AS cca
  FROM orders""")
def d13(spark, folder):
    return _orders(spark, folder).select("o_orderkey", cal.tariff_flag(after=date(1999, 3, 1)).alias("cca"))


# Holidays in SQL by counting weekdays; Easter dates of the covered years are listed.
_EASTER = {1995: "04-16", 1996: "04-07", 1997: "03-30", 1998: "04-12", 1999: "04-04", 2000: "04-23", 2001: "04-15"}
_HOLIDAYS = f"""years AS (SELECT DISTINCT CAST(year(o_orderdate) AS INTEGER) AS y FROM orders),
easter(y, d) AS (VALUES {', '.join(f"({y}, DATE '{y}-{md}')" for y, md in _EASTER.items())}),
holidays AS (
  SELECT make_date(y, 1, 1) AS day, 'New Year' AS name FROM years
  UNION ALL SELECT make_date(y, 7, 4), 'Independence Day' FROM years
  UNION ALL SELECT make_date(y, 12, 25), 'Christmas' FROM years
  UNION ALL SELECT min(d), 'Labor Day' FROM (SELECT y, make_date(y, 9, CAST(i AS INTEGER)) AS d FROM years,
    range(1, 8) t(i)) WHERE dayofweek(d) = 1 GROUP BY y
  UNION ALL SELECT min(d), 'Thanksgiving' FROM (SELECT y, make_date(y, 11, CAST(i AS INTEGER)) AS d FROM years,
    range(22, 29) t(i)) WHERE dayofweek(d) = 4 GROUP BY y
  UNION ALL SELECT d - 2, 'Good Friday' FROM years JOIN easter USING (y))"""


@query("d14_holiday_calendar", f"""WITH {_HOLIDAYS} SELECT {txt('CAST(day AS DATE)')} AS holiday_date,
  name AS holiday_name, count(o_orderkey) AS orders_that_day FROM holidays
  LEFT JOIN orders ON CAST(o_orderdate AS DATE) = CAST(day AS DATE) GROUP BY day, name""")
def d14(spark, folder):
    rows = _orders(spark, folder)
    years = rows.agg(F.min(F.year("ts")).alias("a"), F.max(F.year("ts")).alias("b")).first()
    # Six rows a year: bounded by the calendar, whatever the size of the orders.
    days = F.broadcast(cal.holidays(spark, years["a"], years["b"]))
    per_day = rows.groupBy(F.to_date("ts").alias("holiday_date")).agg(F.count(F.lit(1)).alias("n"))
    hits = per_day.join(days, "holiday_date").groupBy("holiday_date", "holiday_name").agg(F.sum("n").alias("n"))
    out = cal.holidays(spark, years["a"], years["b"]).join(hits, ["holiday_date", "holiday_name"], "left")
    return render(out.select("holiday_date", "holiday_name", F.coalesce("n", F.lit(0)).cast("long").alias(
        "orders_that_day")))


@query("d15_holiday_flag", f"""WITH {_HOLIDAYS} SELECT o_orderkey,
  CAST(EXISTS (SELECT 1 FROM holidays h WHERE CAST(h.day AS DATE) = CAST(o_orderdate AS DATE)) AS INTEGER) AS holiday
  FROM orders""")
def d15(spark, folder):
    return _orders(spark, folder).select("o_orderkey", cal.is_holiday().alias("holiday"))


@query("d16_day_of_year_text", "SELECT o_orderkey, strftime(o_orderdate, '%j') AS j FROM orders")
def d16(spark, folder):
    return _orders(spark, folder).select("o_orderkey", F.date_format("ts", "DDD").alias("j"))


@query("d17_calendar_key", """SELECT event_id, concat_ws(' ', month(ts), day(ts), hour(ts)) AS mdh,
  concat_ws(' ', year(ts), month(ts), day(ts), hour(ts)) AS ymdh FROM events""")
def d17(spark, folder):
    return _events(spark, folder).select("event_id", cal.calendar_key().alias("mdh"),
                                         cal.calendar_key(with_year=True).alias("ymdh"))
