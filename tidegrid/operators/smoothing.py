"""Exponential smoothing for all origins at once, and the Box-Cox parameter."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.operators.blocks import BLOCK, STEP_SECONDS, block_window, core_rows, epoch, with_halo
from tidegrid.plans.backtest import Backtest, horizon_rows, origin_list

BLOCK_STEPS = 8192


def guerrero_lambda(df: DataFrame, period: int, step: str, grid=None, keys=("series_id",),
                    value: str = "value") -> DataFrame:
    """(key, lam): the Box-Cox parameter with the smallest coefficient of variation
    of ``sd / mean ** (1 - lam)`` over whole blocks of ``period`` steps."""
    grid = grid or [i / 10 for i in range(-10, 21)]
    first = df.groupBy(*keys).agg(F.min(epoch()).alias("_first"))
    width = period * STEP_SECONDS[step]
    blocks = (df.join(first, list(keys))
              .groupBy(*keys, F.floor((epoch() - F.col("_first")) / width).alias("_b"))
              .agg(F.avg(value).alias("_m"), F.stddev_samp(value).alias("_s"), F.count(value).alias("_n"))
              .where(F.col("_n") == period))
    ratios = blocks.withColumn("lam", F.explode(F.array(*[F.lit(float(g)) for g in grid]))).withColumn(
        "_q", F.col("_s") / F.pow("_m", 1 - F.col("lam")))
    spread = ratios.groupBy(*keys, "lam").agg((F.stddev_samp("_q") / F.nullif(F.avg("_q"), F.lit(0.0))).alias("_cv"))
    return spread.groupBy(*keys).agg(F.min_by("lam", "_cv").alias("lam"))


def smoothed_sums(df: DataFrame, alpha: float, step: str, keys=("series_id",),
                  value: str = "value") -> DataFrame:
    """Adds ``smoothed`` = sum of ``alpha * (1 - alpha) ** age * value`` over all
    rows up to each row of a complete grid.

    The recursion becomes a running sum inside time blocks: value k rows after the start of its
    block weighs ``(1 - alpha) ** -k``, and the total is scaled back. What earlier blocks add is carried
    from block to block over a table of one row per block, so no value is left out however old it is.
    Blocks are short enough that the weights stay far from overflow.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha is in (0, 1]")
    if alpha == 1:
        return df.withColumn("smoothed", F.col(value).cast("double"))
    decay = -math.log1p(-alpha)
    block = max(1, min(BLOCK_STEPS, int(400 / decay)))
    width = block * STEP_SECONDS[step]
    at = F.floor(epoch() / width)
    age = (epoch() - F.col(BLOCK) * width) / STEP_SECONDS[step]
    # The shuffle is asked for: lying together by key alone would keep a long series in one task.
    rows = df.withColumn(BLOCK, at).repartition(*keys, BLOCK).withColumn("_age", age)
    running = block_window(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = F.sum(F.lit(alpha) * F.col(value) * F.exp(F.col("_age") * decay)).over(running) * F.exp(-F.col("_age") * decay)
    carried = _carried(df.withColumn(BLOCK, at).withColumn("_age", age), alpha, decay, block, keys, value)
    return rows.withColumn("smoothed", inside).join(carried, [*keys, BLOCK]).withColumn(
        "smoothed", F.col("smoothed") + F.col("_carry") * F.exp(-F.col("_age") * decay)).select(*df.columns, "smoothed")


def _carried(rows: DataFrame, alpha: float, decay: float, block: int, keys, value: str) -> DataFrame:
    """(keys, block, _carry): what all earlier blocks add to a row at the start of each block."""
    totals = rows.groupBy(*keys, BLOCK).agg(F.coalesce(F.sum(
        F.lit(alpha) * F.col(value) * F.exp((F.col("_age") - block) * decay)), F.lit(0.0)).alias("_total"))
    listed = totals.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(BLOCK, "_total"))).alias("_list"))
    empty = F.array().cast("array<struct<b:bigint,c:double>>")

    def step(done, one):
        last, total = F.get(done["out"], F.size(done["out"]) - 1), done["total"]
        gap = (one[BLOCK] - last["b"]) * block * decay
        carry = F.when(F.size(done["out"]) == 0, F.lit(0.0)).otherwise(
            last["c"] * F.exp(-gap) + total * F.exp(F.lit(block * decay) - gap))
        made = F.struct(one[BLOCK].alias("b"), carry.alias("c"))
        return F.struct(F.concat(done["out"], F.array(made)).alias("out"), one["_total"].alias("total"))

    start = F.struct(empty.alias("out"), F.lit(0.0).alias("total"))
    carries = F.aggregate("_list", start, step, lambda done: done["out"])
    return listed.select(*keys, F.explode(carries).alias("x")).select(*keys, F.col("x.b").alias(BLOCK), F.col("x.c").alias("_carry"))


def restarted_level(smoothed: Column, start_value: Column, start_smoothed: Column,
                    steps: Column, alpha: float) -> Column:
    """Level of a recursion that starts with ``level = start_value``, ``steps``
    rows after its start, from the sums over the whole series."""
    if alpha == 1:
        return smoothed
    return smoothed + F.exp(steps * math.log1p(-alpha)) * (start_value - start_smoothed)


def smoothing_levels(df: DataFrame, alpha: float, step: str, keys=("series_id",)) -> DataFrame:
    """Adds ``level`` (start: the first value of the series) and the one-step error."""
    sums = smoothed_sums(df, alpha, step, keys)
    starts = df.groupBy(*keys).agg(F.min_by("value", "ts").alias("_y0"), F.min(epoch()).alias("_t0"))
    age = (epoch() - F.col("_t0")) / STEP_SECONDS[step]
    level = restarted_level(F.col("smoothed"), F.col("_y0"), F.lit(alpha) * F.col("_y0"), age, alpha)
    levels = sums.join(starts, list(keys)).withColumn("level", level).drop("smoothed", "_y0", "_t0")
    w = block_window(*keys)
    before = with_halo(levels, step, keys, before=1).withColumn("error", F.col("value") - F.lag("level").over(w))
    return core_rows(before)


def smoothing_forecast(df: DataFrame, spec: Backtest, alpha: float = 0.1, keys=("series_id",)) -> DataFrame:
    """Flat forecast of every origin: the level at the end of its own training
    window, started with the window's first value.

    One blocked scan serves all origins. An origin needs two rows of it, the first
    and the last of its window, found by equi joins on (key, ts)."""
    sums = smoothed_sums(df.select(*keys, "ts", "value"), alpha, spec.step, keys)
    origins = origin_list(df, spec, keys)
    at_end = sums.select(*keys, F.col("ts").alias("train_end"), F.col("smoothed").alias("_end"))
    at_start = sums.select(*keys, F.col("ts").alias("train_start"), F.col("smoothed").alias("_start"),
                           F.col("value").alias("_y0"))
    steps = (epoch("train_end") - epoch("train_start")) / spec.step_seconds
    levels = (origins.join(at_end, [*keys, "train_end"]).join(at_start, [*keys, "train_start"])
              .select(*keys, "origin", restarted_level(
                  F.col("_end"), F.col("_y0"), F.col("_start"), steps, alpha).alias("predicted")))
    future = horizon_rows(df.select(*keys, "ts", "value"), spec, keys)
    return future.join(levels, [*keys, "origin"]).select(
        *keys, "origin", "step", "ts", F.col("value").alias("actual"), "predicted")
