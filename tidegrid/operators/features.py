"""Feature frames of the forecasters, built in one window pass and few projections."""

from __future__ import annotations

import re

from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.calendar import (calendar_parts, hour_flags, is_holiday, one_hot, season_flags,
                                         tariff_flag, weekday_flags)
from tidegrid.functions.terms import (half_sine, hour_fourier, month_fourier, monthday_fourier,
                                      power, powers, product, shifted_hour, weekday_fourier,
                                      yearday_fourier)
from tidegrid.operators.grid import step_index
from tidegrid.operators.lags import LOAD_LAGS, add_lags

# Weather inputs of the final model and the powers taken of them.
FINAL_WEATHER = ("LAX_High", "lax_low", "RIV_High", "riv_low", "WJF_High", "TRM_High", "trm_Low")
POWERED_WEATHER = ("LAX_High", "lax_low", "RIV_High", "riv_low")

# The 90 inputs of the final model.
FINAL_FEATURES = (
    *LOAD_LAGS, "l2_2", "l2_3",
    *FINAL_WEATHER, *[f"{c}_{n}" for c in POWERED_WEATHER for n in (2, 3)],
    "hour", "hour_2", "hour_sin", "hour_cos",
    *[f"hour_sin{k}" for k in (1, 2, 3, 4, 5, 6, 11, 12)],
    *[f"hour_cos{k}" for k in (1, 2, 3, 4, 10)],
    "day_week", "day_week_2", "wday", "day_week_sin1", "day_week_sin2", "day_week_sin3",
    "day_week_sin4", "day_week_cos1",
    "month", *[f"month_{w}{k}" for w in ("sin", "cos") for k in range(1, 7)],
    "day_month", "day_year", "day_year_2",
    *[f"day_year_{w}{k}" for w in ("sin", "cos") for k in range(1, 6)],
    "holiday", "trend",
)

# Inputs of the two-year boosted model, and of its variant with 0/1
# columns and the highs of the day before.
EARLY_FEATURES = (
    "l2", "l3", "l4", "l5", "l6", "l7", "l14", "l21", "w4", "w8", "w12", "w16", "w20", "w24", "l2_2", "l2_3",
    "LAX_High", "lax_low", "RIV_High", "riv_low", "TRM_High", "trm_Low",
    "LAX_High_2", "lax_low_2", "RIV_High_2", "riv_low_2",
    "holiday", "hour", "hour_2", "hour_3", "hour_sin", "hour_cos",
    *[f"day_week_{k}" for k in range(1, 8)], "day_week_squared", "day_week_sin1", "day_week_cos1", "is_sun_to_thu",
    "month", "day_month", "day_year", "day_year_2", "day_year_3", "day_year_sin1", "day_year_cos1",
    "hour_day_year", "hour_day_year_2", "quarter", "year", "warm", "warm_hour", "warm_hour_2", "trend", "cca",
)
HIGH_COLUMNS = ("LAX_High", "CQT_High", "RIV_High", "TRM_High", "WJF_High")
DUMMY_LAGS = {"d2": 48, "d3": 72, "d4": 96, "d5": 120, "d6": 144, "w1": 168, "w2": 336, "w3": 504,
              "m1": 672, "m2": 1344, "m3": 2016, "m4": 2688, "m5": 3360, "m6": 4032}
DUMMY_LEVELS = {"hour": range(24), "day_week": range(1, 8), "month": range(1, 13), "season": range(1, 5)}

# Terms of the regression formulas. ``a:b`` is a product, ``a^n`` a
# power, ``poly(a)`` the powers 1 to 3, which span the same space as orthogonal
# polynomials of degree 3.
WEEKDAY_BY_HOUR = tuple(f"{d}:{h}" for d in ("is_sunday", "is_saturday")
                        for h in ("eleven", "twelve", "thirteen", "eighteen"))
CALENDAR_WAVES = ("hour_sin", "hour_cos", "day_week_sin1", "day_week_cos1", "day_month_sin1",
                  "day_month_cos1", "day_year_sin1", "day_year_cos1")
FORMULAS = {
    "single_holdout": (
        "temperature", "hour", "hour^2", "hour_half_sin", "day_week_half_sin", "day_week",
        "day_week^2", "day_month_half_sin", "day_month", "day_month^2", "month",
        "month_half_sin", "day_year", "day_year_half_sin", "quarter", "trend", "cca",
        "six_hour_block", "six_hour_block^2"),
    "expanding": (
        "nineteen", "is_sun_to_thu", "hour:day_week", "poly(hour)", "hour_plus7_sin",
        "hour_plus12_cos", "day_week_sin1", "day_week_cos1", "day_week", "day_week^2",
        "day_month_sin1", "day_month_cos1", "day_month", "day_month^2", "day_year_sin1",
        "day_year_cos1", "cca"),
    "rolling_quarter": (
        "l2", "l3", "l7", "is_sun_to_thu", "is_saturday", "holiday", *WEEKDAY_BY_HOUR,
        "poly(hour)", *CALENDAR_WAVES, "day_week", "cca"),
    "rolling_two_years": (
        "LAX_High", "LAX_High^2", "lax_low", "lax_low^2", "day_week^2", "hour:day_year^2",
        "hour:day_year", "day_year^3", "day_year^2", "day_year", "poly(l2)", "l3", "l4", "l5",
        "l6", "l7", "l14", "l21", "l28", "w8", "w12", "w16", "w20", "w24", "is_sun_to_thu",
        "is_saturday", "holiday", *WEEKDAY_BY_HOUR, "poly(hour)", *CALENDAR_WAVES, "day_week",
        "cca"),
    "smoothing_layer": (
        "temperature", "l2", "l3", "l7", "is_sun_to_thu", "is_saturday", "holiday",
        *WEEKDAY_BY_HOUR, "poly(hour)", *CALENDAR_WAVES, "day_week", "cca"),
}


def with_calendar(df: DataFrame, need=None) -> DataFrame:
    """Calendar parts, then everything derived from them, as two projections.
    ``need`` limits the derived columns to those that are used."""
    parts = df.withColumns(calendar_parts())
    sin12, cos12 = shifted_hour(12)
    derived = {
        **hour_flags(), **weekday_flags(), **season_flags(),
        "holiday": is_holiday(), "cca": tariff_flag(),
        "wday": F.when(F.col("day_week").isin(2, 3, 4, 5), 1).otherwise(0),
        **hour_fourier(), **weekday_fourier(), **month_fourier(), **yearday_fourier(),
        **monthday_fourier(),
        "hour_sin": sin12, "hour_cos": cos12,
        "hour_plus7_sin": shifted_hour(7, half_period=True)[0],
        "hour_plus12_cos": shifted_hour(12, half_period=True)[1],
        "hour_half_sin": half_sine("hour", 24.0), "day_week_half_sin": half_sine("day_week", 24.0),
        "day_month_half_sin": half_sine("day_month", 30.0),
        "month_half_sin": half_sine("month", 12.0),
        "day_year_half_sin": half_sine("day_year", 365.25),
        **powers("hour", 2, 3), **powers("day_week", 2, 3), **powers("day_year", 2, 3),
    }
    if need is not None:
        derived = {n: c for n, c in derived.items() if n in set(need)}
    return parts.withColumns(derived) if derived else parts


def interactions() -> dict:
    """Products of hour, day of year and the warm flag."""
    return {
        "hour_day_year": product("hour", "day_year"),
        "hour_day_year_2": product("hour", "day_year", "day_year"),
        "warm_hour": product("warm", "hour"),
        "warm_hour_2": product("warm", "hour", "hour"),
    }


def lag_powers() -> dict:
    return {**powers("l2", 2, 3), **powers("l3", 2), **powers("l4", 2), **powers("l7", 2)}


def weather_powers(columns=POWERED_WEATHER) -> dict:
    out = {}
    for c in columns:
        out.update(powers(c, 2, 3))
    return out


def load_frame(df: DataFrame, step: str = "hour", lags=LOAD_LAGS, keys=("series_id",), need=None) -> DataFrame:
    """Lags, trend and calendar columns of a complete series table."""
    lagged = add_lags(df, dict(lags), step, keys=keys) if lags else df
    return with_calendar(step_index(lagged, step, keys), need)


def final_frame(df: DataFrame, keys=("series_id",)) -> DataFrame:
    """The 90 inputs of the final model plus keys, stamp and value. The weather
    columns must be joined already."""
    wide = load_frame(df, keys=keys, need=FINAL_FEATURES).withColumns({**lag_powers(), **weather_powers()})
    return wide.select(*keys, "ts", "value", *FINAL_FEATURES)


def early_frame(df: DataFrame, keys=("series_id",)) -> DataFrame:
    """Inputs of the two-year boosted model; its weather columns must be joined."""
    lags = {n: k for n, k in LOAD_LAGS.items() if n in EARLY_FEATURES}
    made = load_frame(df, lags=lags, keys=keys, need=EARLY_FEATURES)
    # One column per weekday replaces the weekday's powers of the same name.
    wide = made.withColumn("day_week_squared", power("day_week", 2)).withColumns({
        **one_hot("day_week", range(1, 8)), **powers("l2", 2, 3), **interactions(),
        **{f"{c}_2": power(c, 2) for c in POWERED_WEATHER}})
    return wide.select(*keys, "ts", "value", *EARLY_FEATURES)


def dummy_frame(df: DataFrame, keys=("series_id",)) -> tuple[DataFrame, list[str]]:
    """Frame and input list of the variant with 0/1 columns: load lags, the highs of
    the day before (known when forecasting), and one column per hour, weekday,
    month, season and year day; the 366 year days are one sparse vector."""
    lagged = add_lags(df, {**DUMMY_LAGS, **{f"{c}_d1": (c, 24) for c in HIGH_COLUMNS}}, "hour", keys=keys)
    made = with_calendar(step_index(lagged, "hour", keys), ["season", "holiday", "is_sun_to_thu", "cca"])
    levels = {}
    for c, values in DUMMY_LEVELS.items():
        levels.update(one_hot(c, values))
    wide = encode_sparse(made.withColumns(levels).withColumn("day_year", F.col("day_year").cast("double")),
                         "day_year", "day_year_hot", 367)
    names = [*DUMMY_LAGS, *[f"{c}_d1" for c in HIGH_COLUMNS], *levels, "day_year_hot",
             "holiday", "is_sun_to_thu", "trend", "cca"]
    return wide.select(*keys, "ts", "value", *names), names


def feature_list(df: DataFrame, exclude) -> list[str]:
    """All columns but the excluded ones, in table order."""
    drop = set(exclude)
    return [c for c in df.columns if c not in drop]


def term(name: str):
    """Column of one formula term."""
    if ":" in name:
        out = None
        for part in name.split(":"):
            out = term(part) if out is None else out * term(part)
        return out
    if "^" in name:
        base, degree = name.split("^")
        return power(base, int(degree))
    return F.col(name).cast("double")


def formula_columns(formula) -> set[str]:
    """Base columns a formula reads."""
    names = FORMULAS[formula] if isinstance(formula, str) else formula
    return {re.sub(r"^poly\(|\)$|\^\d+$", "", part) for name in names for part in name.split(":")}


def formula_terms(formula) -> dict:
    """{column name: expression} of a formula's terms."""
    out = {}
    for name in FORMULAS[formula] if isinstance(formula, str) else formula:
        if name.startswith("poly("):
            base = name[5:-1]
            out.update({f"{base}_p{n}": power(base, n) for n in (1, 2, 3)})
        else:
            out[name.replace(":", "_x_").replace("^", "_p")] = term(name)
    return out


def assemble(df: DataFrame, features, out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(df)


def encode_sparse(df: DataFrame, column: str, out: str, size: int) -> DataFrame:
    """One-hot of 0 .. size-1 as a sparse vector, for wide sets such as the 366
    days of a year. The size is given, so no job looks for the levels."""
    shape = df.sparkSession.range(size).select(F.col("id").cast("double").alias(column))
    encoder = OneHotEncoder(inputCols=[column], outputCols=[out], dropLast=False)
    return encoder.fit(shape).transform(df)
