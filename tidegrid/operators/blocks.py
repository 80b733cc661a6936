"""Windows that stay parallel when one series holds a large share of the rows.

``Window.partitionBy(series)`` puts a whole series in one task. Here a series is
cut into time blocks; every row also visits the later (or earlier) blocks that
can see it through a bounded frame. A window then partitions by (series, block),
so a task holds one block and its halo whatever the length of the series. Rows
are copied ``1 + halo / block`` times on average.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR = 3600
DAY = 86400
STEP_SECONDS = {"hour": HOUR, "day": DAY}

BLOCK = "_block"
CORE = "_core"


def epoch(ts: str | Column = "ts") -> Column:
    return F.unix_seconds(F.col(ts) if isinstance(ts, str) else ts)


def with_halo(df: DataFrame, step: str, keys, before: int = 0, after: int = 0,
              block: int | None = None, ts: str = "ts") -> DataFrame:
    """Copy rows into every block whose frame reaches them.

    ``before`` and ``after`` count steps a frame looks back and ahead. Adds
    ``_block`` and ``_core`` (true for the one copy that belongs to its block).

    The shuffle is asked for: rows that already lie together by key alone would
    satisfy a window by (key, block), and a long series would stay in one task.
    """
    block = block or max(1024, 2 * (before + after))
    width = block * STEP_SECONDS[step]
    s = epoch(ts)
    first = F.floor((s - F.lit(after * STEP_SECONDS[step])) / width)
    last = F.floor((s + F.lit(before * STEP_SECONDS[step])) / width)
    return (df.withColumn(BLOCK, F.explode(F.sequence(first, last)))
              .withColumn(CORE, F.col(BLOCK) == F.floor(s / width))
              .repartition(*keys, BLOCK))


def block_window(*keys: str, ts: str = "ts") -> Window:
    return Window.partitionBy(*keys, BLOCK).orderBy(ts)


def core_rows(df: DataFrame) -> DataFrame:
    return df.where(F.col(CORE)).drop(BLOCK, CORE)


def add_framed(df: DataFrame, columns: dict[str, Column], step: str, keys, before: int = 0,
               after: int = 0, block: int | None = None) -> DataFrame:
    """Evaluate window columns over haloed blocks and keep each row once."""
    return core_rows(with_halo(df, step, keys, before, after, block).withColumns(columns))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Hash by the keys of a grouped fit into the session's shuffle partitions.

    It takes the place of the shuffle the grouping needs anyway, and keeps adaptive
    execution from merging groups that are small in bytes but long to compute."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
