"""Rolling-origin backtests as data.

An origin is the first scored stamp of one forecast. With hourly steps and
``score_from=17`` it is midnight of day D: training ends at 07:00 of D-1, steps 1
to 16 are the rest of D-1 and steps 17 to 40 are day D. A row finds the origins
that use it by clock arithmetic, so no join of rows with origins is needed.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.blocks import STEP_SECONDS, epoch, spread


@dataclass(frozen=True)
class Backtest:
    train: int                  # rows of the training window (of the first, if expanding)
    horizon: int = 40
    score_from: int = 17        # first scored step
    every: int = 24             # steps between origins
    valid: int = 0              # rows of the validation tail, part of ``train``
    step: str = "hour"
    expanding: bool = False
    first: str | None = None    # limits of the origins, inclusive
    last: str | None = None

    @property
    def step_seconds(self) -> int:
        return STEP_SECONDS[self.step]

    @property
    def every_seconds(self) -> int:
        return self.every * self.step_seconds


# The published set-ups (rows are hours).
PUBLISHED = {
    "single_holdout": Backtest(train=2160, every=1, first="2014-04-01 16:00:00", last="2014-04-01 16:00:00"),
    "expanding_month": Backtest(train=2168, expanding=True),
    "rolling_quarter": Backtest(train=2168),
    "rolling_two_years": Backtest(train=17529),
    "boosted_two_years": Backtest(train=17528, valid=32),
    "boosted_three_years": Backtest(train=26288, valid=40),
    "boosted_dummies": Backtest(train=17528, valid=176),
    "smoothing_year": Backtest(train=8768),
}


# Set-up, first and last scored day of each published run.
RUNS = {
    "expanding_month": ("expanding_month", "2017-01-01", "2017-01-31"),
    "rolling_quarter": ("rolling_quarter", "2017-01-01", "2017-03-31"),
    "rolling_two_years": ("rolling_two_years", "2017-01-01", "2017-12-31"),
    "boosted_from_february": ("boosted_two_years", "2017-02-01", "2017-12-31"),
    "boosted_two_years": ("boosted_two_years", "2017-01-01", "2017-12-31"),
    "boosted_three_years": ("boosted_three_years", "2017-01-01", "2019-12-31"),
    "boosted_summer": ("boosted_dummies", "2017-05-01", "2017-07-31"),
    "smoothing_three_years": ("smoothing_year", "2017-01-01", "2020-01-01"),
    "damped_trend_year": ("smoothing_year", "2017-01-01", "2018-01-01"),
}


def run_spec(name: str) -> Backtest:
    """The set-up of a published run with the range of its origins."""
    setup, first, last = RUNS[name]
    return replace(PUBLISHED[setup], first=first, last=last)


def year_anchor(year: int | Column, first_year: int = 2014, step: str = "hour") -> Column:
    """Row number (from 1) of the first step of ``year`` on a grid that starts
    with ``first_year``."""
    def new_year(y) -> Column:
        return F.make_timestamp(y if isinstance(y, Column) else F.lit(y), F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0))

    start, at = new_year(first_year), new_year(year)
    return ((epoch(at) - epoch(start)) / STEP_SECONDS[step] + 1).cast("long")


def _up(seconds: Column, width: int) -> Column:
    return F.ceil(seconds / width) * width


def _down(seconds: Column, width: int) -> Column:
    return F.floor(seconds / width) * width


def origin_bounds(df: DataFrame, spec: Backtest, keys=("series_id",)) -> DataFrame:
    """First and last origin per series (epoch seconds): the training window must
    be full and every horizon step must lie inside the series."""
    s, width = spec.step_seconds, spec.every_seconds
    first = _up(F.min(epoch()) + (spec.train + spec.score_from - 1) * s, width)
    last = _down(F.max(epoch()) - (spec.horizon - spec.score_from) * s, width)
    if spec.first:
        first = F.greatest(first, _up(epoch(F.to_timestamp(F.lit(spec.first))), width))
    if spec.last:
        last = F.least(last, _down(epoch(F.to_timestamp(F.lit(spec.last))), width))
    return (df.groupBy(*keys).agg(first.alias("_first"), last.alias("_last"))
              .where("_first <= _last"))


def _stamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def origin_list(df: DataFrame, spec: Backtest, keys=("series_id",)) -> DataFrame:
    """One row per series and origin with the limits of its training window."""
    s = spec.step_seconds
    exploded = spread(origin_bounds(df, spec, keys), *keys).select(
        *keys, "_first", F.explode(F.sequence(
            "_first", "_last", F.lit(spec.every_seconds).cast("long"))).alias("_o"))
    start = F.col("_first") if spec.expanding else F.col("_o")
    return exploded.select(
        *keys, _stamp(F.col("_o")).alias("origin"),
        _stamp(start - (spec.score_from + spec.train - 1) * s).alias("train_start"),
        _stamp(F.col("_o") - spec.score_from * s).alias("train_end"),
        _stamp(F.col("_o") + (spec.horizon - spec.score_from) * s).alias("horizon_end"))


def _explode_origins(df: DataFrame, spec: Backtest, keys, low: Column, high: Column) -> DataFrame:
    # ``greatest`` and ``least`` skip nulls, so a null limit (no origin) is kept apart.
    width = spec.every_seconds
    out = df.join(origin_bounds(df, spec, keys), list(keys)).withColumns({
        "_lo": F.when(low.isNotNull(), F.greatest(_up(low, width), F.col("_first"))),
        "_hi": F.least(_down(high, width), F.col("_last"))})
    return (out.where("_lo <= _hi")
               .withColumn("_o", F.explode(F.sequence("_lo", "_hi", F.lit(width).cast("long"))))
               .drop("_lo", "_hi"))


def training_rows(df: DataFrame, spec: Backtest, keys=("series_id",)) -> DataFrame:
    """Every row once per origin that trains on it; ``is_valid`` marks the tail."""
    s = spec.step_seconds
    low = epoch() + spec.score_from * s
    high = F.col("_last") if spec.expanding else epoch() + (spec.score_from + spec.train - 1) * s
    if spec.expanding:
        start = F.col("_first") - (spec.score_from + spec.train - 1) * s
        low = F.when(epoch() >= start, low)
    out = _explode_origins(df, spec, keys, low, high)
    tail = epoch() > F.col("_o") - (spec.score_from + spec.valid) * s
    return (out.withColumns({"origin": _stamp(F.col("_o")),
                             "is_valid": tail if spec.valid else F.lit(False)})
               .drop("_o", "_first", "_last"))


def horizon_rows(df: DataFrame, spec: Backtest, keys=("series_id",),
                 scored_only: bool = False) -> DataFrame:
    """Every row once per origin that forecasts it, with its step 1 .. horizon."""
    s = spec.step_seconds
    first_step = spec.score_from if scored_only else 1
    low = epoch() - (spec.horizon - spec.score_from) * s
    high = epoch() + (spec.score_from - first_step) * s
    out = _explode_origins(df, spec, keys, low, high)
    step = (epoch() - F.col("_o")) / s + spec.score_from
    return (out.withColumns({"origin": _stamp(F.col("_o")), "step": step.cast("int")})
               .drop("_o", "_first", "_last"))


def origin_chunks(df: DataFrame, spec: Backtest, per_chunk: int, keys=("series_id",)) -> DataFrame:
    """Copy rows to the chunks of consecutive origins that need them, for fits
    that share work between neighbouring origins.

    A chunk holds ``train + per_chunk * every + horizon`` rows however long the
    series is, and a row is copied about ``1 + train / (per_chunk * every)`` times.
    With an expanding window a row goes to every later chunk, as each of its
    origins trains on it; a chunk is then as long as the calendar up to its end.
    Adds ``_chunk``, ``_first`` and ``_last`` (origins of the series, seconds).
    """
    s, width = spec.step_seconds, spec.every_seconds
    low = _up(epoch() - (spec.horizon - spec.score_from) * s, width)
    high = _down(epoch() + (spec.score_from + spec.train - 1) * s, width)
    span = per_chunk * width
    if spec.expanding:
        start = F.col("_first") - (spec.score_from + spec.train - 1) * s
        high = F.when(epoch() >= start, F.col("_last"))
    out = df.join(origin_bounds(df, spec, keys), list(keys)).withColumns({
        "_lo": F.greatest(low, F.col("_first")),
        "_hi": F.when(high.isNotNull(), F.least(high, F.col("_last")))})
    return (out.where("_lo <= _hi")
               .withColumn("_chunk", F.explode(F.sequence(
                   F.floor(F.col("_lo") / span), F.floor(F.col("_hi") / span))))
               .drop("_lo", "_hi"))
