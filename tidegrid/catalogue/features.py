"""Derived columns: powers, Fourier terms, flags, interactions, dummies, Box-Cox."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tidegrid.catalogue.registry import (ORDER_CHAIN, FILLED_CHAIN, STATION_ROWS, query, r, render, txt,
                                         with_)
from tidegrid.functions import calendar as cal
from tidegrid.functions import terms
from tidegrid.operators import features, lags, smoothing, weather
from tidegrid.sources import tables

_OVER = "OVER (PARTITION BY series_id ORDER BY ts)"
_PI2 = "2 * pi()"


def _events(spark, folder, need=None):
    """Stamps of the events table with their calendar columns."""
    rows = tables.table(spark, folder, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    return features.with_calendar(rows, need)


def _on_events(name, columns: dict[str, str], digits=8):
    """Register a query that shows calendar columns, with their SQL expressions."""
    sql = "SELECT event_id, " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + (
        " FROM (SELECT *, hour(ts) AS h, dayofweek(ts) + 1 AS w, month(ts) AS m, day(ts) AS d, "
        "dayofyear(ts) AS y FROM events)")

    @query(name, sql)
    def run(spark, folder):
        return render(_events(spark, folder, columns).select("event_id", *columns), digits)
    return run


def _waves(name, x, harmonics, period, by_rank=False):
    out = {}
    for rank, k in enumerate(harmonics, 1):
        n = rank if by_rank else k
        out[f"{name}_sin{n}"] = r(f"sin({_PI2} * {k} * {x} / {period})")
        out[f"{name}_cos{n}"] = r(f"cos({_PI2} * {k} * {x} / {period})")
    return out


_HOUR_WAVES = _waves("hour", "h", terms.HOUR_HARMONICS, 24)
_WEEK_WAVES = _waves("day_week", "w", terms.WEEKDAY_HARMONICS, 7)
_MONTH_WAVES = _waves("month", "m", terms.MONTH_HARMONICS, 12)
_YEAR_WAVES = _waves("day_year", "y", terms.YEARDAY_HARMONICS, 365.25, by_rank=True)
_POWERS = {f"{n}_{k}": r(" * ".join([x] * k)) for n, x in (("hour", "h"), ("day_week", "w"), ("day_year", "y"))
           for k in (2, 3)}
_SHIFTED = {"hour_sin": r(f"sin({_PI2} * ((h + 12) % 24) / 24)"), "hour_cos": r(f"cos({_PI2} * ((h + 12) % 24) / 24)"),
            "hour_plus7_sin": r("sin(pi() * ((h + 7) % 24) / 24)"),
            "hour_plus12_cos": r("cos(pi() * ((h + 12) % 24) / 24)")}
_HOUR_FLAGS = {n: f"CAST(h % {mod} = {rem} AS INTEGER)" for n, (mod, rem) in cal.HOUR_FLAGS.items()}

_on_events("m2_calendar_powers", _POWERS)
_on_events("m4_hour_fourier", _HOUR_WAVES)
_on_events("m5_shifted_hour", _SHIFTED)
_on_events("m6_weekday_fourier", _WEEK_WAVES)
_on_events("m9_monthday_fourier", _waves("day_month", "d", (1,), 30))
_on_events("m10_half_sines", {
    "hour_half_sin": r("sin(pi() * h / 24)"), "day_week_half_sin": r("sin(pi() * w / 24)"),
    "day_month_half_sin": r("sin(pi() * d / 30)"), "month_half_sin": r("sin(pi() * m / 12)"),
    "day_year_half_sin": r("sin(pi() * y / 365.25)")})
_on_events("m14_workday_flag", {"is_sun_to_thu": "CAST(w <= 5 AS INTEGER)",
                                "is_mon_to_thu": "CAST(w IN (2, 3, 4, 5) AS INTEGER)"})
_on_events("m15_weekday_flags", {"is_sunday": "CAST(w = 1 AS INTEGER)", "is_monday": "CAST(w = 2 AS INTEGER)",
                                 "is_saturday": "CAST(w = 7 AS INTEGER)"})
_on_events("m16_hour_flags", _HOUR_FLAGS)


def _on_orders(name, columns):
    sql = "SELECT o_orderkey, " + ", ".join(f"{e} AS {c}" for c, e in columns.items()) + (
        " FROM (SELECT *, dayofweek(o_orderdate) + 1 AS w, month(o_orderdate) AS m, day(o_orderdate) AS d, "
        "dayofyear(o_orderdate) AS y FROM orders)")

    @query(name, sql)
    def run(spark, folder):
        rows = tables.table(spark, folder, "orders").select(
            "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("ts"))
        return render(features.with_calendar(rows, columns).select("o_orderkey", *columns))
    return run


_on_orders("m7_month_fourier", _MONTH_WAVES)
_on_orders("m8_yearday_fourier", _YEAR_WAVES)
_on_orders("m17_warm_flag", {"warm": "CAST(m IN (5, 6, 7, 8, 9) AS INTEGER)"})
_on_orders("m18_season_code", {"season": "CASE WHEN m IN (3, 4, 5) THEN 1 WHEN m IN (6, 7, 8) THEN 2 "
                                         "WHEN m IN (9, 10, 11) THEN 3 ELSE 4 END"})


@query("m1_lag_powers", with_(FILLED_CHAIN) + f""", x AS (SELECT series_id, ts,
  {', '.join(f'coalesce(lag(value, {k}) {_OVER}, 0) AS {n}' for n, k in (('l2', 48), ('l3', 72), ('l4', 96), ('l7', 168)))}
  FROM filled) SELECT series_id, {txt('ts')} AS ts, {r('l2 * l2', 4)} AS l2_2, {r('l2 * l2 * l2', 4)} AS l2_3,
  {r('l3 * l3', 4)} AS l3_2, {r('l4 * l4', 4)} AS l4_2, {r('l7 * l7', 4)} AS l7_2 FROM x""")
def m1(spark, folder):
    rows = lags.add_lags(tables.filled_events(spark, folder), {
        n: features.LOAD_LAGS[n] for n in ("l2", "l3", "l4", "l7")}, "hour")
    return render(rows.withColumns(features.lag_powers()).select(
        "series_id", "ts", "l2_2", "l2_3", "l3_2", "l4_2", "l7_2"), 4)


_HIGH_LOW = """days AS (SELECT CAST(ts AS DATE) AS day, max(value) AS high, min(value) AS low
  FROM station_rows GROUP BY 1)"""


@query("m3_weather_powers", with_(STATION_ROWS, _HIGH_LOW) + f"""SELECT {txt('day')} AS day,
  {r('high * high', 4)} AS high_2, {r('high * high * high', 4)} AS high_3, {r('low * low', 4)} AS low_2,
  {r('low * low * low', 4)} AS low_3 FROM days""")
def m3(spark, folder):
    days = tables.station_readings(spark, folder).groupBy(F.to_date("ts").alias("day")).agg(
        F.max("value").alias("high"), F.min("value").alias("low"))
    return render(days.select("day", *[c.alias(n) for n, c in features.weather_powers(("high", "low")).items()]), 4)


@query("m11_interactions", """SELECT event_id, CAST(h * y AS DOUBLE) AS hour_day_year,
  CAST(h * y * y AS DOUBLE) AS hour_day_year_2, CAST(warm * h AS DOUBLE) AS warm_hour,
  CAST(warm * h * h AS DOUBLE) AS warm_hour_2 FROM (SELECT event_id, hour(ts) AS h, dayofyear(ts) AS y,
  CAST(month(ts) IN (5, 6, 7, 8, 9) AS INTEGER) AS warm FROM events)""")
def m11(spark, folder):
    return _events(spark, folder, ["warm"]).withColumns(features.interactions()).select(
        "event_id", *features.interactions())


_WH = {f"{d}_x_{h}": f"CAST(CAST(w = {n} AS INTEGER) * CAST({f} AS INTEGER) AS DOUBLE)"
       for d, n in (("is_sunday", 1), ("is_saturday", 7))
       for h, f in (("eleven", "h = 11"), ("twelve", "h = 12"), ("thirteen", "h = 13"), ("eighteen", "h % 18 = 0"))}


@query("m12_formula_interactions", f"""SELECT event_id, {', '.join(f'{e} AS {c}' for c, e in _WH.items())},
  CAST(h * w AS DOUBLE) AS hour_x_day_week, CAST(h * y AS DOUBLE) AS hour_x_day_year
  FROM (SELECT event_id, hour(ts) AS h, dayofweek(ts) + 1 AS w, dayofyear(ts) AS y FROM events)""")
def m12(spark, folder):
    made = features.formula_terms([*features.WEEKDAY_BY_HOUR, "hour:day_week", "hour:day_year"])
    return _events(spark, folder, features.formula_columns(features.WEEKDAY_BY_HOUR)).select(
        "event_id", *[c.alias(n) for n, c in made.items()])


@query("m13_polynomial_terms", """SELECT event_id, CAST(h AS DOUBLE) AS hour_p1, CAST(h * h AS DOUBLE) AS hour_p2,
  CAST(h * h * h AS DOUBLE) AS hour_p3 FROM (SELECT event_id, hour(ts) AS h FROM events)""")
def m13(spark, folder):
    made = features.formula_terms(["poly(hour)"])
    return _events(spark, folder, []).select("event_id", *[c.alias(n) for n, c in made.items()])


@query("m19_weekday_dummies", "SELECT l_orderkey, l_linenumber, " + ", ".join(
    f"CAST(dayofweek(l_shipdate) + 1 = {k} AS INTEGER) AS day_week_{k}" for k in range(1, 8)) + " FROM lineitem")
def m19(spark, folder):
    rows = tables.table(spark, folder, "lineitem").withColumn("day_week", F.dayofweek("l_shipdate"))
    return rows.select("l_orderkey", "l_linenumber", *[
        c.alias(n) for n, c in cal.one_hot("day_week", range(1, 8)).items()])


@query("m20_sparse_dummies", """SELECT o_orderkey, dayofyear(o_orderdate) AS slot, 1.0::DOUBLE AS hot FROM orders
  UNION ALL SELECT o_orderkey, 1000 + month(o_orderdate), 1.0 FROM orders
  UNION ALL SELECT o_orderkey, 2000 + hour(o_orderdate), 1.0 FROM orders""")
def m20(spark, folder):
    """Sparse one-hot vectors, shown as their non-zero slots."""
    rows = tables.table(spark, folder, "orders").select(
        "o_orderkey", F.dayofyear("o_orderdate").cast("double").alias("day_year"),
        F.month("o_orderdate").cast("double").alias("month"), F.hour("o_orderdate").cast("double").alias("hour"))
    shown = []
    for col, size, base in (("day_year", 367, 0), ("month", 13, 1000), ("hour", 24, 2000)):
        hot = features.encode_sparse(rows.select("o_orderkey", col), col, "vec", size)
        shown.append(hot.select("o_orderkey", F.posexplode(vector_to_array("vec")).alias("slot", "hot"))
                     .where("hot <> 0").select("o_orderkey", (F.col("slot") + base).cast("bigint").alias("slot"), "hot"))
    return shown[0].unionByName(shown[1]).unionByName(shown[2])


@query("m22_modulo_and_cast", """SELECT l_orderkey, l_linenumber, CAST(l_quantity % 24 AS INTEGER) AS q_mod,
  CAST((l_linenumber - 5) - 4 * floor((l_linenumber - 5) / 4.0) AS INTEGER) AS n_mod FROM lineitem""")
def m22(spark, folder):
    return tables.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", F.pmod("l_quantity", F.lit(24.0)).cast("int").alias("q_mod"),
        F.pmod(F.col("l_linenumber") - 5, F.lit(4)).cast("int").alias("n_mod"))


# Positive series for Box-Cox: hourly means are above zero.
_LAMBDAS = "lams AS (SELECT (i - 10) / 10.0::DOUBLE AS lam FROM range(0, 31) t(i))"


@query("m21_box_cox", with_(FILLED_CHAIN) + f""", {_LAMBDAS},
  first AS (SELECT series_id, min(ts) AS t0 FROM filled GROUP BY 1),
  blocks AS (SELECT f.series_id, CAST(floor(date_diff('hour', t0, ts) / 24) AS BIGINT) AS b, avg(value) AS m,
    stddev_samp(value) AS s, count(*) AS n FROM filled f JOIN first USING (series_id) GROUP BY 1, 2),
  cv AS (SELECT series_id, lam, stddev_samp(s / pow(m, 1 - lam)) / avg(s / pow(m, 1 - lam)) AS cv
    FROM blocks, lams WHERE n = 24 GROUP BY 1, 2),
  best AS (SELECT series_id, arg_min(lam, cv) AS lam FROM cv GROUP BY 1)
  SELECT f.series_id, {txt('f.ts')} AS ts, {r('lam')} AS lam, {r('''CASE WHEN abs(lam) < 1e-12 THEN ln(value)
  ELSE (pow(value, lam) - 1) / lam END''', 6)} AS z FROM filled f JOIN best USING (series_id)""")
def m21(spark, folder):
    rows = tables.filled_events(spark, folder)
    lam = smoothing.guerrero_lambda(rows, period=24, step="hour")
    return render(rows.join(lam, "series_id").withColumn(
        "z", terms.box_cox(F.col("value"), F.col("lam"))).select("series_id", "ts", "lam", "z"), 6)


# The whole final feature list. Region highs and lows stand for the stations.
_STANDS_FOR = {"LAX": "AFRICA", "RIV": "AMERICA", "WJF": "ASIA", "TRM": "EUROPE"}
_WEATHER_SQL = {c: f"{'max' if c.endswith('High') else 'min'}(value) FILTER (station = '{_STANDS_FOR[c[:3].upper()]}')"
                for c in features.FINAL_WEATHER}


def with_station_weather(spark, folder, rows):
    high_low = weather.daily_high_low(tables.station_readings(spark, folder), list(_STANDS_FOR.values()))
    days = high_low.select("day", *[F.col(
        f"{_STANDS_FOR[c[:3].upper()]}_{'high' if c.endswith('High') else 'low'}").alias(c)
        for c in features.FINAL_WEATHER])
    return weather.join_daily(rows, days, "day")


def _final_sql():
    cols = {}
    for n, k in lags.LOAD_LAGS.items():
        cols[n] = f"coalesce(lag(value, {k}) {_OVER}, 0)"
    inner = ", ".join(f"{e} AS {n}" for n, e in cols.items())
    shown = {n: r(n) for n in lags.LOAD_LAGS}
    shown.update({"l2_2": r("l2 * l2"), "l2_3": r("l2 * l2 * l2", 4)})
    for c in features.FINAL_WEATHER:
        shown[c] = r(c)
    for c in features.POWERED_WEATHER:
        shown[f"{c}_2"], shown[f"{c}_3"] = r(f"{c} * {c}"), r(f"{c} * {c} * {c}", 4)
    whole = {"hour": "h", "day_week": "w", "month": "m", "day_month": "d", "day_year": "y"}
    shown.update({n: f"CAST({x} AS INTEGER)" for n, x in whole.items()})
    shown.update(_HOUR_WAVES | _WEEK_WAVES | _MONTH_WAVES | _YEAR_WAVES | _POWERS)
    shown.update({"hour_sin": _SHIFTED["hour_sin"], "hour_cos": _SHIFTED["hour_cos"],
                  "wday": "CAST(w IN (2, 3, 4, 5) AS INTEGER)", "trend": "trend",
                  "holiday": "CAST(CAST(ts AS DATE) = DATE '2024-01-01' AS INTEGER)"})
    listed = ", ".join(f"{shown[n]} AS {n}" for n in features.FINAL_FEATURES)
    return with_(FILLED_CHAIN, STATION_ROWS) + f""", days AS (SELECT CAST(ts AS DATE) AS day,
      {', '.join(f'{e} AS {c}' for c, e in _WEATHER_SQL.items())} FROM station_rows GROUP BY 1),
    x AS (SELECT f.series_id, f.ts, f.value, row_number() {_OVER} AS trend, {inner}, days.* EXCLUDE (day),
      hour(ts) AS h, dayofweek(ts) + 1 AS w, month(ts) AS m, day(ts) AS d, dayofyear(ts) AS y
      FROM filled f LEFT JOIN days ON days.day = CAST(f.ts AS DATE))
    SELECT series_id, {txt('ts')} AS ts, {r('value')} AS value, {listed} FROM x"""


def final_rows(spark, folder):
    return features.final_frame(with_station_weather(spark, folder, tables.filled_events(spark, folder)))


@query("p5_final_feature_list", _final_sql())
def p5(spark, folder):
    cubes = {c: 4 for c in ("l2_3", *[f"{w}_3" for w in features.POWERED_WEATHER])}
    return render(final_rows(spark, folder), **cubes)


_LONG_LAGS = lags.LOAD_LAGS | lags.REGRESSION_LAGS


@query("p5_long_lags", with_(ORDER_CHAIN) + f"""SELECT series_id, {txt('ts')} AS ts, {r('value')} AS value,
  {', '.join(f"{r(f'coalesce(lag(value, {k}) {_OVER}, 0)')} AS {n}" for n, k in _LONG_LAGS.items())} FROM filled""")
def p5_long(spark, folder):
    """All lag inputs, up to two years of hours, on a series that is long enough for them."""
    return render(lags.add_lags(tables.filled_orders(spark, folder), _LONG_LAGS, "hour").select(
        "series_id", "ts", "value", *_LONG_LAGS))
