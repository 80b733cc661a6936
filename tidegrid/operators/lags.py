"""Lags, differences and moving averages on complete grids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.blocks import add_framed, block_window

# Lag columns of the final model, in hours.
LOAD_LAGS = {
    "l2": 48, "l3": 72, "l4": 96, "l5": 120, "l6": 144, "l7": 168, "l14": 336, "l21": 504,
    "w4": 672, "w8": 1344, "w12": 2016, "w16": 2688, "w20": 3360, "w24": 4032,
    "y1": 8760, "y1_1a": 8784, "y1_1b": 8736, "y1_1c": 8712, "y2": 17520, "y2_1b": 17496,
}
# Further lag columns of the two-year regression, in hours.
REGRESSION_LAGS = {"l28": 672, "l364": 8736, "l365": 8760, "l366": 8784}


def add_lags(df: DataFrame, lags: dict, step: str, value: str = "value",
             pad: float | None = 0.0, keys=("series_id",), block: int | None = None) -> DataFrame:
    """One column per lag, in steps of a complete grid; rows before the start of
    a series get ``pad``. A lag is a number of steps of ``value`` or a pair (column,
    steps). All lags share one shuffle."""
    w = block_window(*keys)
    pairs = {n: k if isinstance(k, tuple) else (value, k) for n, k in lags.items()}
    return add_framed(df, {n: F.lag(c, k, pad).over(w) for n, (c, k) in pairs.items()},
                      step, keys, before=max(k for _, k in pairs.values()), block=block)


def lag_by_join(df: DataFrame, name: str, steps: int, step: str, value: str = "value",
                pad: float | None = 0.0, keys=("series_id",)) -> DataFrame:
    """The same lag as an equi join on the shifted stamp: hash partitioned by
    (key, ts), so even a single series spreads over all tasks."""
    moved = df.select(*keys, (F.col("ts") + F.expr(f"interval {steps} {step}")).alias("ts"),
                      F.col(value).alias(name), F.lit(True).alias("_seen"))
    out = df.join(moved, [*keys, "ts"], "left")
    if pad is not None:
        out = out.withColumn(name, F.when(F.col("_seen"), F.col(name)).otherwise(F.lit(pad)))
    return out.drop("_seen")


def add_differences(df: DataFrame, lags: dict[str, int], step: str, value: str = "value",
                    keys=("series_id",)) -> DataFrame:
    """``value - lag(value)``, null where the lag does not exist."""
    w = block_window(*keys)
    return add_framed(df, {n: F.col(value) - F.lag(value, k).over(w) for n, k in lags.items()},
                      step, keys, before=max(lags.values()))


def trailing_mean(df: DataFrame, name: str, order: int, step: str, value: str = "value",
                  keys=("series_id",)) -> DataFrame:
    """Mean of the last ``order`` rows; null until the frame is full."""
    w = block_window(*keys).rowsBetween(1 - order, Window.currentRow)
    mean = F.when(F.count(value).over(w) == order, F.avg(value).over(w))
    return add_framed(df, {name: mean}, step, keys, before=order - 1)


def centred_mean(df: DataFrame, name: str, order: int, step: str, value: str = "value",
                 keys=("series_id",)) -> DataFrame:
    """Centred moving average; an even order averages two neighbouring frames,
    which halves the weight of both ends. Null until the frame is full."""
    half = order // 2
    w = block_window(*keys)
    full = w.rowsBetween(-half, half)
    total = F.sum(value).over(full)
    if order % 2 == 0:
        total = total - (F.lag(value, half).over(w) + F.lead(value, half).over(w)) / 2
    mean = F.when(F.count(value).over(full) == 2 * half + 1, total / order)
    return add_framed(df, {name: mean}, step, keys, before=half, after=half)
