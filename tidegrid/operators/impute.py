"""Gap filling: calendar means, and a weighted moving average over neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegrid.functions.stats import any_missing, missing_cells, strict_mean
from tidegrid.operators.blocks import BLOCK, HOUR, epoch

CALENDAR = ("month", "day", "hour")


def calendar_columns(parts=CALENDAR, ts: str = "ts") -> dict[str, Column]:
    all_parts = {"month": F.month(ts), "day": F.dayofmonth(ts), "hour": F.hour(ts)}
    return {p: all_parts[p] for p in parts}


def calendar_mean(df: DataFrame, parts=CALENDAR, value: str = "value", keys=("series_id",),
                  before=None, skip_null: bool = False, name: str = "calendar_mean") -> DataFrame:
    """Mean per key and calendar cell. ``before`` limits it to an earlier period."""
    if before is not None:
        df = df.where(F.col("ts") < F.lit(before))
    mean = F.avg(value) if skip_null else strict_mean(value)
    cells = [c.alias(p) for p, c in calendar_columns(parts).items()]
    return df.groupBy(*keys, *cells).agg(mean.alias(name))


def with_calendar_mean(df: DataFrame, means: DataFrame, parts=CALENDAR,
                       keys=("series_id",)) -> DataFrame:
    """Left join of calendar means. Adaptive execution broadcasts the means if
    they are measured to be small, else both sides hash by (key, cell)."""
    return (df.withColumns(calendar_columns(parts))
              .join(means, [*keys, *parts], "left").drop(*parts))


def calendar_fill(dense: DataFrame, parts=CALENDAR, value: str = "value", keys=("series_id",),
                  skip_null: bool = False, source: bool = False) -> DataFrame:
    """Null values take the mean of their calendar cell, or, if that is empty too,
    the last non-empty cell before it in calendar order. The calendar is a circle:
    before its first cell comes its last one.

    ``source`` adds ``fill_source``: observed, calendar, fallback or none.
    """
    # With the marker ``observed`` a null reading spoils its cell, as in
    # ``strict_mean``; grid rows without a reading never do.
    mean = F.avg(value)
    if "observed" in dense.columns and not skip_null:
        mean = F.when(F.count(value) == F.count_if("observed"), mean)
    keyed = dense.withColumns(calendar_columns(parts))
    # Cells come from the grid, so that a cell without any value is a row here.
    cells = keyed.groupBy(*keys, *parts).agg(mean.alias("_cell"))
    # At most 366 * 24 cells per key: the window is bounded by the calendar.
    order = Window.partitionBy(*keys).orderBy(*parts)
    so_far = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cells = cells.withColumn("_carried", F.coalesce(
        F.last("_cell", ignorenulls=True).over(so_far), F.last("_cell", ignorenulls=True).over(whole)))
    out = keyed.join(cells, [*keys, *parts], "left")
    filled = F.coalesce(F.col(value), F.col("_carried"))
    columns = {}
    if source:
        columns["fill_source"] = (
            F.when(F.col(value).isNotNull(), "observed").when(F.col("_cell").isNotNull(), "calendar")
            .when(F.col("_carried").isNotNull(), "fallback").otherwise("none"))
    columns[value] = filled
    return out.withColumns(columns).drop(*parts, "_cell", "_carried", "observed")


def missing_audit(df: DataFrame, *cols: str) -> DataFrame:
    """One row: rows, null cells in total and per column, rows with a null."""
    return df.agg(
        F.count(F.lit(1)).alias("row_count"),
        missing_cells(*cols).alias("missing_cells"),
        F.count_if(any_missing(*cols)).alias("rows_with_missing"),
        *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in cols])


def rows_with_missing(df: DataFrame, *cols: str) -> DataFrame:
    return df.where(any_missing(*cols))


def moving_average_fill(df: DataFrame, values, key: str = "series_id",
                        tie_break=(), block_seconds: int = HOUR) -> DataFrame:
    """Fill nulls by a linearly weighted mean of near neighbours, counted in rows.

    The radius starts at one row and grows until two non-null values lie inside;
    a value at distance d weighs 1 / (d + 1). Only original values are used, and a
    series with fewer than two values stays as it is.

    Neighbours can be any number of rows away, so no fixed halo is enough: every
    time block is scanned on its own, and the two nearest values beyond its edges
    come from a table with one row per block. Only that table is windowed per
    series; it is bounded by the calendar, not by the number of readings.
    """
    order = ["ts", *tie_break]
    blocked = df.withColumn(BLOCK, F.floor(epoch() / block_seconds)).repartition(key, BLOCK)
    inside = Window.partitionBy(key, BLOCK).orderBy(*order)
    before_row = inside.rowsBetween(Window.unboundedPreceding, -1)
    after_row = inside.rowsBetween(1, Window.unboundedFollowing)

    # Row position in the whole series = rows of earlier blocks + position inside.
    over_blocks = Window.partitionBy(key).orderBy(BLOCK)
    earlier = over_blocks.rowsBetween(Window.unboundedPreceding, -1)
    later = over_blocks.rowsBetween(1, Window.unboundedFollowing)

    def point(v: str) -> Column:
        return F.when(F.col(v).isNotNull(), F.struct(F.col("_i").alias("p"), F.col(v).alias("v")))

    numbered = blocked.withColumn("_i", F.row_number().over(inside).cast("long"))
    near = {}
    for v in values:
        near[f"_{v}_l1"] = F.last(point(v), ignorenulls=True).over(before_row)
        near[f"_{v}_r1"] = F.first(point(v), ignorenulls=True).over(after_row)
    local = numbered.withColumns(near)

    def pair(v: str, side: str) -> Column:
        return F.when(F.col(v).isNotNull(), F.struct(
            point(v).alias("n1"), F.col(f"_{v}_{side}1").alias("n2")))

    pairs = {}
    for v in values:
        pairs[f"_{v}_l"] = F.last(pair(v, "l"), ignorenulls=True).over(before_row)
        pairs[f"_{v}_r"] = F.first(pair(v, "r"), ignorenulls=True).over(after_row)
    local = local.withColumns(pairs)

    # One row per block: its length, and its outermost two values on each side.
    edges = [F.count(F.lit(1)).alias("_rows")]
    for v in values:
        edges += [F.max_by(pair(v, "l"), F.when(F.col(v).isNotNull(), F.col("_i"))).alias(f"_{v}_le"),
                  F.min_by(pair(v, "r"), F.when(F.col(v).isNotNull(), F.col("_i"))).alias(f"_{v}_re")]
    blocks = local.groupBy(key, BLOCK).agg(*edges).withColumn(
        "_start", F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).cast("long"))

    def moved(p: Column) -> Column:
        return F.when(p.isNotNull(), F.struct((p["p"] + F.col("_start")).alias("p"), p["v"].alias("v")))

    first_points, carried = {}, {}
    for v in values:
        for side, frame, pick in (("l", earlier, F.last), ("r", later, F.first)):
            edge = F.col(f"_{v}_{side}e")
            first_points[f"_{v}_{side}b"] = pick(moved(edge["n1"]), ignorenulls=True).over(frame)
            both = F.when(edge.isNotNull(), F.struct(
                moved(edge["n1"]).alias("n1"),
                F.coalesce(moved(edge["n2"]), F.col(f"_{v}_{side}b")).alias("n2")))
            carried[f"_{v}_{side}c"] = pick(both, ignorenulls=True).over(frame)
    blocks = blocks.withColumns(first_points).withColumns(carried).select(
        key, BLOCK, "_start", *carried)

    joined = local.join(blocks, [key, BLOCK])
    here = F.col("_i") + F.col("_start")
    filled = {}
    for v in values:
        points = []
        for side in ("l", "r"):
            own, out = F.col(f"_{v}_{side}"), F.col(f"_{v}_{side}c")
            one = F.coalesce(moved(own["n1"]), out["n1"])
            two = F.when(own.isNotNull(), F.coalesce(moved(own["n2"]), out["n1"])).otherwise(out["n2"])
            points += [one, two]
        candidates = F.filter(F.array(*points), lambda p: p.isNotNull())
        ranked = F.array_sort(F.transform(candidates, lambda p: F.struct(
            F.abs(p["p"] - here).alias("d"), p["v"].alias("v"))))
        radius = F.get(ranked, F.lit(1))["d"]
        used = F.filter(ranked, lambda p: p["d"] <= radius)
        zero = F.struct(F.lit(0.0).alias("a"), F.lit(0.0).alias("b"))
        weighted = F.aggregate(
            used, zero,
            lambda s, p: F.struct((s["a"] + p["v"] / (p["d"] + 1)).alias("a"),
                                  (s["b"] + F.lit(1.0) / (p["d"] + 1)).alias("b")),
            lambda s: s["a"] / s["b"])
        filled[v] = F.when(F.col(v).isNotNull() | radius.isNull(), F.col(v)).otherwise(weighted)
    return joined.withColumns(filled).select(*df.columns)


def coalesce_columns(pairs: dict[str, str]) -> dict[str, Column]:
    """{target: filler}: null targets take the filler of the same row."""
    return {t: F.coalesce(F.col(t), F.col(f)) for t, f in pairs.items()}
