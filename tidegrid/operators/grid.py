"""Regular time grids and the collapse of duplicate stamps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.stats import strict_mean
from tidegrid.operators.blocks import STEP_SECONDS, epoch, spread


def collapse_duplicates(df: DataFrame, keys=("series_id", "ts"), value: str = "value",
                        skip_null: bool = False) -> DataFrame:
    """One row per key: the mean of its duplicates. Partial sums are formed
    before the shuffle, so a hot stamp costs one row per map task."""
    mean = F.avg(value) if skip_null else strict_mean(value)
    return df.groupBy(*keys).agg(mean.alias(value))


def bucket_mean(df: DataFrame, unit: str, keys=("series_id",), value: str = "value",
                skip_null: bool = False) -> DataFrame:
    """Mean per key and truncated stamp."""
    return collapse_duplicates(
        df.withColumn("ts", F.date_trunc(unit, F.col("ts"))), (*keys, "ts"), value, skip_null)


def between(df: DataFrame, start, end, ts: str = "ts") -> DataFrame:
    """Range on the raw stamp column, so that the predicate reaches the scan."""
    return df.where((F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))


def span(df: DataFrame, keys=("series_id",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


CHUNK = 1024  # steps made by one task at a time


def _chunked(bounds: DataFrame, seconds: int, keep) -> DataFrame:
    """(keep, _a, _b): the range of each row cut into stretches of CHUNK steps.

    A grid is far larger than the bounds it comes from. Exploded in place, it would
    be made by the few tasks that hold the bounds; the stretches are spread first.
    """
    width = CHUNK * seconds
    cut = bounds.select(*keep, epoch("last_ts").alias("_last"), F.explode(F.sequence(
        epoch("first_ts"), epoch("last_ts"), F.lit(width).cast("long"))).alias("_a"))
    ends = F.least(F.col("_last"), F.col("_a") + (width - seconds))
    return spread(cut.select(*keep, "_a", ends.alias("_b")), *keep, "_a")


def grid_of(bounds: DataFrame, step: str, name: str = "ts") -> DataFrame:
    """One row per step of (first_ts, last_ts), the other columns kept."""
    return grid_by_seconds(bounds, STEP_SECONDS[step], name)


def grid_by_seconds(bounds: DataFrame, seconds: int, name: str = "ts") -> DataFrame:
    """Grid by a fixed number of seconds; on a UTC clock an hour is always 3600."""
    keep = [c for c in bounds.columns if c not in ("first_ts", "last_ts")]
    stamps = F.sequence("_a", "_b", F.lit(seconds).cast("long"))
    return _chunked(bounds.where(F.col("first_ts").isNotNull()), seconds, keep).select(
        *keep, F.explode(stamps).alias("_s")).select(*keep, F.timestamp_seconds("_s").alias(name))


def distinct_steps(df: DataFrame, unit: str, keys=("series_id",)) -> DataFrame:
    """Earliest stamp of each (key, unit)."""
    return (df.groupBy(*keys, F.date_trunc(unit, "ts").alias("_unit"))
              .agg(F.min("ts").alias("ts")).drop("_unit"))


def on_grid(grid: DataFrame, observed: DataFrame, keys=("series_id",)) -> DataFrame:
    """Left join of observations to the grid; absent steps get null."""
    return grid.join(observed, [*keys, "ts"], "left")


def complete(observed: DataFrame, step: str, keys=("series_id",), mark: bool = False) -> DataFrame:
    """Observations on the full grid of their own span. ``mark`` adds a column
    ``observed`` that tells a null reading from an absent one."""
    grid = grid_of(span(observed, keys), step)
    if not mark:
        return on_grid(grid, observed, keys)
    return on_grid(grid, observed.withColumn("observed", F.lit(True)), keys).withColumn(
        "observed", F.coalesce("observed", F.lit(False)))


def step_index(df: DataFrame, step: str, keys=("series_id",)) -> DataFrame:
    """Trend 1, 2, 3 ... by clock arithmetic: needs the first stamp of a series,
    not a global row number."""
    first = df.groupBy(*keys).agg(F.min(epoch()).alias("_first"))
    width = STEP_SECONDS[step]
    return (df.join(first, list(keys))
              .withColumn("trend", ((epoch() - F.col("_first")) / width + 1).cast("long"))
              .drop("_first"))


def first_and_last(df: DataFrame, keys, order) -> DataFrame:
    """First and last row of each group, once if they are the same row.

    ``order`` lists columns that identify a row in its group. Minimum and maximum
    of a struct combine before the shuffle; no sort of a group is needed."""
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*[F.col(c) for c in [*order, *[c for c in rest if c not in order]]])
    return (df.groupBy(*keys).agg(F.min(row).alias("a"), F.max(row).alias("b"))
              .select(*keys, F.explode(F.array_distinct(F.array("a", "b"))).alias("r"))
              .select(*keys, *[F.col("r")[c].alias(c) for c in rest]))
