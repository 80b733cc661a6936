"""Calendar parts, flags and the holiday calendar.

Weekdays count from Sunday=1 to Saturday=7 everywhere.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The day after which the tariff flag is on, and the month sets.
TARIFF_CHANGE = date(2019, 3, 1)
WARM_MONTHS = (5, 6, 7, 8, 9)
SEASON_MONTHS = {1: (3, 4, 5), 2: (6, 7, 8), 3: (9, 10, 11), 4: (12, 1, 2)}

# Flag name -> (modulus, remainder) of the hour. A modulus below 24
# makes the flag true at several hours (hour % 20 == 0 holds at 0 and at 20).
HOUR_FLAGS = {
    "four": (24, 4),
    "seven": (24, 7),
    "ten": (20, 10),
    "eleven": (22, 11),
    "twelve": (24, 12),
    "thirteen": (24, 13),
    "fourteen": (24, 14),
    "fifteen": (24, 15),
    "eighteen": (18, 0),
    "nineteen": (19, 0),
    "twenty": (20, 0),
}


def flag(condition: Column) -> Column:
    """1 where the condition holds, else 0 (also for null)."""
    return F.when(condition, 1).otherwise(0)


def calendar_parts(ts: str = "ts") -> dict[str, Column]:
    t = F.col(ts)
    return {
        "hour": F.hour(t),
        "day_week": F.dayofweek(t),
        "day_month": F.dayofmonth(t),
        "month": F.month(t),
        "day_year": F.dayofyear(t),
        "quarter": F.quarter(t),
        "year": F.year(t),
        "six_hour_block": F.floor(F.hour(t) / 6).cast("int"),
    }


def hour_flags(hour: str = "hour") -> dict[str, Column]:
    return {
        name: flag(F.pmod(F.col(hour), F.lit(mod)) == rem)
        for name, (mod, rem) in HOUR_FLAGS.items()
    }


def weekday_flags(day_week: str = "day_week") -> dict[str, Column]:
    """Honest names: 1 is Sunday, 2 Monday, 7 Saturday."""
    d = F.col(day_week)
    return {
        "is_sunday": flag(d == 1),
        "is_monday": flag(d == 2),
        "is_saturday": flag(d == 7),
        "is_sun_to_thu": flag(d <= 5),
        "is_mon_to_thu": flag(d.isin(2, 3, 4, 5)),
    }


def season_flags(month: str = "month") -> dict[str, Column]:
    m = F.col(month)
    season = F.lit(0)
    for code, months in SEASON_MONTHS.items():
        season = F.when(m.isin(*months), code).otherwise(season)
    return {"warm": flag(m.isin(*WARM_MONTHS)), "season": season}


def tariff_flag(ts: str = "ts", after: date = TARIFF_CHANGE) -> Column:
    return flag(F.to_date(F.col(ts)) > F.lit(after))


def calendar_key(ts: str = "ts", with_year: bool = False) -> Column:
    """Text form of (month, day, hour), e.g. ``2 29 13``."""
    t = F.col(ts)
    parts = [F.month(t), F.dayofmonth(t), F.hour(t)]
    if with_year:
        parts = [F.year(t), *parts]
    return F.concat_ws(" ", *[p.cast("string") for p in parts])


def one_hot(col: str, levels, prefix: str | None = None) -> dict[str, Column]:
    """One 0/1 column per level. For wide level sets use ``encode_sparse``."""
    prefix = prefix or col
    return {f"{prefix}_{v}": flag(F.col(col) == F.lit(v)) for v in levels}


def easter_sunday(year: Column) -> Column:
    """Gregorian Easter by the anonymous computus, on integer columns."""

    def div(a: Column, b) -> Column:
        return F.floor(a / b).cast("int")

    golden = year % 19
    century, rest = div(year, 100), year % 100
    leap_century, century_rest = div(century, 4), century % 4
    moon = div(century - div(century + 8, 25) + 1, 3)
    epact = (golden * 19 + century - leap_century - moon + 15) % 30
    weekday = (century_rest * 2 + div(rest, 4) * 2 - epact - rest % 4 + 32) % 7
    shift = div(golden + epact * 11 + weekday * 22, 451)
    total = epact + weekday - shift * 7 + 114
    return F.make_date(year, div(total, 31), total % 31 + 1)


def holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(holiday_date, holiday_name): six days a year, so at most 6 * years rows."""
    y = F.col("year")
    named = {
        "Christmas": F.make_date(y, F.lit(12), F.lit(25)),
        "Good Friday": F.date_sub(easter_sunday(y), 2),
        "Independence Day": F.make_date(y, F.lit(7), F.lit(4)),
        "Labor Day": F.next_day(F.make_date(y, F.lit(8), F.lit(31)), "Mon"),
        "New Year": F.make_date(y, F.lit(1), F.lit(1)),
        "Thanksgiving": F.date_add(F.next_day(F.make_date(y, F.lit(10), F.lit(31)), "Thu"), 21),
    }
    rows = F.array(*[F.struct(d.alias("holiday_date"), F.lit(n).alias("holiday_name"))
                     for n, d in named.items()])
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("year"))
    return years.select(F.explode(rows).alias("h")).select("h.*")


def is_holiday(ts: str = "ts") -> Column:
    """Holiday membership of a timestamp as an expression on its own date: no
    join and no table, so any year works and nothing is broadcast."""
    day = F.to_date(F.col(ts))
    y = F.year(day)
    return flag(
        (day == F.make_date(y, F.lit(1), F.lit(1)))
        | (day == F.make_date(y, F.lit(7), F.lit(4)))
        | (day == F.make_date(y, F.lit(12), F.lit(25)))
        | (day == F.next_day(F.make_date(y, F.lit(8), F.lit(31)), "Mon"))
        | (day == F.date_add(F.next_day(F.make_date(y, F.lit(10), F.lit(31)), "Thu"), 21))
        | (day == F.date_sub(easter_sunday(y), 2))
    )
