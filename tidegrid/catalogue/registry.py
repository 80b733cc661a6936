"""Registry of runnable queries and their SQL twins.

``render`` prints results alike in both engines: doubles rounded (and -0.0 made
0.0), dates and stamps as ISO text, flags as integers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def render(df: DataFrame, digits: int = 8, **special: int) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = F.round(c.cast("double"), special.get(f.name, digits)) + F.lit(0.0)
        elif isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)):
            c = c.cast("string")
        elif isinstance(f.dataType, T.BooleanType):
            c = c.cast("int")
        out.append(c.alias(f.name))
    return df.select(*out)


def r(expr: str, digits: int = 8) -> str:
    """Rounded double in SQL, as ``render`` does it."""
    return f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"


def txt(expr: str) -> str:
    return f"CAST({expr} AS VARCHAR)"


# Building blocks of the SQL twins: the same series views as sources.tables.
EV = "ev AS (SELECT event_type AS series_id, ts, value FROM events)"
HOURLY = """hourly AS (SELECT event_type AS series_id, date_trunc('hour', ts) AS ts,
  CASE WHEN count(value) = count(*) THEN avg(value) END AS value FROM events GROUP BY 1, 2)"""
GRID = """grid AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts
  FROM (SELECT series_id, min(ts) AS lo, max(ts) AS hi FROM hourly GROUP BY 1))"""
DENSE = """dense AS (SELECT g.series_id, g.ts, h.value FROM grid g
  LEFT JOIN hourly h ON g.series_id = h.series_id AND g.ts = h.ts)"""
FILLED = """cells AS (SELECT series_id, hour(ts) AS hr, avg(value) AS m FROM dense GROUP BY 1, 2),
carried AS (SELECT series_id, hr, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY series_id
  ORDER BY hr ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), last_value(m IGNORE NULLS) OVER (
  PARTITION BY series_id ORDER BY hr ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS m FROM cells),
filled AS (SELECT d.series_id, d.ts, coalesce(d.value, c.m) AS value FROM dense d
  LEFT JOIN carried c ON d.series_id = c.series_id AND hour(d.ts) = c.hr)"""
DENSE_CHAIN = ",\n".join([HOURLY, GRID, DENSE])
FILLED_CHAIN = ",\n".join([HOURLY, GRID, DENSE, FILLED])

# Orders per hour over seven years.
ORDER_CHAIN = ",\n".join(["""hourly AS (SELECT 'orders' AS series_id,
  CAST(o_orderdate AS TIMESTAMP) + to_hours(CAST(o_orderkey % 24 AS INTEGER)) AS ts, CAST(count(*) AS DOUBLE) AS value
  FROM orders GROUP BY 1, 2)""", GRID, DENSE, FILLED])

DAILY = """daily AS (SELECT concat(l_returnflag, '-', l_linestatus) AS series_id,
  date_trunc('day', l_shipdate) AS ts, avg(l_quantity) AS value
  FROM lineitem GROUP BY 1, 2)"""
DAY_GRID = """day_grid AS (SELECT series_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS ts
  FROM (SELECT series_id, CAST(min(ts) AS TIMESTAMP) AS lo, CAST(max(ts) AS TIMESTAMP) AS hi
        FROM daily GROUP BY 1))"""
DAY_DENSE = """day_dense AS (SELECT g.series_id, g.ts, h.value FROM day_grid g
  LEFT JOIN daily h ON g.series_id = h.series_id AND g.ts = h.ts)"""
DAY_FILLED = """day_cells AS (SELECT series_id, month(ts) AS mo, day(ts) AS dy, avg(value) AS m
  FROM day_dense GROUP BY 1, 2, 3),
day_carried AS (SELECT series_id, mo, dy, m AS cell, coalesce(last_value(m IGNORE NULLS) OVER (
  PARTITION BY series_id ORDER BY mo, dy ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
  last_value(m IGNORE NULLS) OVER (PARTITION BY series_id ORDER BY mo, dy
  ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) AS m FROM day_cells),
day_filled AS (SELECT d.series_id, d.ts, coalesce(d.value, c.m) AS value,
  CASE WHEN d.value IS NOT NULL THEN 'observed' WHEN c.cell IS NOT NULL THEN 'calendar'
       WHEN c.m IS NOT NULL THEN 'fallback' ELSE 'none' END AS fill_source
  FROM day_dense d LEFT JOIN day_carried c ON d.series_id = c.series_id
  AND month(d.ts) = c.mo AND day(d.ts) = c.dy)"""
DAY_DENSE_CHAIN = ",\n".join([DAILY, DAY_GRID, DAY_DENSE])
DAY_FILLED_CHAIN = ",\n".join([DAILY, DAY_GRID, DAY_DENSE, DAY_FILLED])

STATION_ROWS = """station_rows AS (SELECT r_name AS station, ts, value FROM events
  JOIN customer ON user_id = c_custkey JOIN nation ON c_nationkey = n_nationkey
  JOIN region ON n_regionkey = r_regionkey)"""
STATION_HOURS = """station_hours AS (SELECT station, date_trunc('hour', ts) AS ts, avg(value) AS value
  FROM station_rows GROUP BY 1, 2)"""


def with_(*fragments: str) -> str:
    return "WITH " + ",\n".join(fragments) + "\n"
