"""Figures of every origin's training window by prefix sums.

A row belongs to the origins ``enters .. leaves`` (clock arithmetic). So a sum over the windows of all
origins is a running sum over origins of what enters less what has left: each row is added up once where it
enters and once where it leaves, and the number of origins does not multiply rows. The running sums go in
two levels, inside blocks of origins and over the block totals, so no task holds a whole calendar.
Expanding windows have nothing that leaves.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidegrid.functions.solve import solve_centred
from tidegrid.operators.blocks import epoch
from tidegrid.plans.backtest import Backtest, origin_bounds, origin_list

BLOCK = 256  # Origins of a block.


def _memberships(df: DataFrame, spec: Backtest, keys) -> DataFrame:
    """Adds ``_enters`` (first origin that trains on the row) and ``_leaves`` (first one that no longer does; null if
    none); rows of no origin are left out. Both count ``every`` steps."""
    s, width = spec.step_seconds, spec.every_seconds
    start = epoch() + (spec.score_from + spec.train - 1) * s
    enters = F.ceil((epoch() + spec.score_from * s) / width)
    first, last = (F.col(c) / width for c in ("_first", "_last"))
    leaves = F.lit(None).cast("long") if spec.expanding else F.floor(start / width) + 1
    out = df.join(origin_bounds(df, spec, keys), list(keys)).where(start >= F.col("_first"))
    out = out.withColumns({"_enters": F.greatest(enters, first.cast("long")), "_leaves": leaves})
    return out.where(F.col("_enters") <= last).withColumn("_leaves", F.when(F.col("_leaves") <= last, F.col("_leaves"))).drop("_first", "_last")


def _origins(df: DataFrame, spec: Backtest, keys) -> DataFrame:
    return origin_list(df, spec, keys).select(*keys, (epoch("origin") / spec.every_seconds).cast("long").alias("_at"))


def running(df: DataFrame, keys, sums=(), highest=(), block: int = BLOCK) -> DataFrame:
    """Running sums and maxima of columns over ``_at`` per key (one row per key and ``_at``), in two levels."""
    df = df.withColumn("_block", F.floor(F.col("_at") / block))
    inside = Window.partitionBy(*keys, "_block").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    totals = df.groupBy(*keys, "_block").agg(*(F.sum(c).alias(c) for c in sums), *(F.max(c).alias(c) for c in highest))
    carried = totals.select(*keys, "_block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in sums),
                            *(F.max(c).over(before).alias(f"{c}_before") for c in highest))
    # The shuffle is asked for: lying together by key alone would keep a whole calendar in one task.
    rows = df.repartition(*keys, "_block")
    rows = rows.select(*keys, "_at", "_block", *(F.sum(c).over(inside).alias(c) for c in sums), *(F.max(c).over(inside).alias(c) for c in highest))
    return rows.join(carried, [*keys, "_block"]).select(*keys, "_at", *((F.col(c) + F.col(f"{c}_before")).alias(c) for c in sums),
                                                        *(F.greatest(c, f"{c}_before").alias(c) for c in highest))


def window_sums(df: DataFrame, spec: Backtest, columns: dict[str, Column], keys=("series_id",)) -> DataFrame:
    """(keys, origin, columns): the sum of each column (doubles; missing values add nothing) over each origin's window."""
    names = list(columns)
    rows = _memberships(df, spec, keys).select(*keys, "_enters", "_leaves", *(c.cast("double").alias(n) for n, c in columns.items()))
    cells = rows.groupBy(*keys, "_enters", "_leaves").agg(*(F.coalesce(F.sum(n), F.lit(0.0)).alias(n) for n in names))
    events = cells.select(*keys, F.col("_enters").alias("_at"), *names).unionByName(
        cells.where("_leaves IS NOT NULL").select(*keys, F.col("_leaves").alias("_at"), *((-F.col(n)).alias(n) for n in names))).unionByName(
        _origins(df, spec, keys).select(*keys, "_at", *(F.lit(0.0).alias(n) for n in names)))
    steps = events.groupBy(*keys, "_at").agg(*(F.sum(n).alias(n) for n in names))
    return running(steps, keys, names).select(*keys, F.timestamp_seconds(F.col("_at") * spec.every_seconds).alias("origin"), *names)


def window_edges(df: DataFrame, spec: Backtest, keys=("series_id",)) -> DataFrame:
    """(keys, origin, first_ts, last_ts): the first and the last row of each origin's window."""
    member = _memberships(df, spec, keys)
    low, high = origin_bounds(df, spec, keys), _origins(df, spec, keys)
    none = F.lit(None).cast("long")
    ends = member.groupBy(*keys, F.col("_enters").alias("_at")).agg(F.max(epoch()).alias("v")).unionByName(high.withColumn("v", none))
    last = running(ends.groupBy(*keys, "_at").agg(F.max("v").alias("v")), keys, highest=["v"])
    if spec.expanding:
        first = last.join(member.groupBy(*keys).agg(F.min(epoch()).alias("f")), list(keys)).select(*keys, "_at", "f")
    else:
        # From the latest origin backwards: the first row is the earliest of those that have not left.
        stays = F.coalesce(F.col("_leaves") - 1, (F.col("_last") / spec.every_seconds).cast("long"))
        starts = member.join(low, list(keys)).groupBy(*keys, (-stays).alias("_at")).agg(F.max(-epoch()).alias("v")).unionByName(
            high.select(*keys, (-F.col("_at")).alias("_at"), none.alias("v")))
        first = running(starts.groupBy(*keys, "_at").agg(F.max("v").alias("v")), keys, highest=["v"]).select(
            *keys, (-F.col("_at")).alias("_at"), (-F.col("v")).alias("f"))
    return high.join(last, [*keys, "_at"]).join(first, [*keys, "_at"]).select(
        *keys, F.timestamp_seconds(F.col("_at") * spec.every_seconds).alias("origin"), F.timestamp_seconds("f").alias("first_ts"),
        F.timestamp_seconds("v").alias("last_ts"))


def window_coefficients(df: DataFrame, features, spec: Backtest, label: str = "value", keys=("series_id",), block: int = BLOCK) -> DataFrame:
    """(keys, origin, n, intercept, coefficients) of least squares on each origin's window, rolling or expanding.

    Tasks send sums of products for the (series, origin) where rows enter and leave; a block of origins takes
    the total before it and adds up its own. Inputs are centred and scaled by the first window of their series."""
    features, keys = list(features), list(keys)
    columns, size = [*features, label], len(features) + 2
    good = F.lit(True)
    for c in columns:
        good = good & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    rows = _memberships(df.select(*keys, "ts", *(F.col(c).cast("double").alias(c) for c in columns)), spec, keys)
    first = origin_bounds(df, spec, keys).select(*keys, (F.col("_first") / spec.every_seconds).cast("long").alias("_f"))
    scale = rows.where(good).join(first, keys).where(F.col("_enters") == F.col("_f")).groupBy(*keys).agg(
        F.array(*(F.avg(c) for c in features)).alias("_centre"), F.array(*(F.coalesce(F.stddev(c), F.lit(0.0)) for c in features)).alias("_scale"))
    fields = [df.schema[k] for k in keys]
    cell = T.StructType([*fields, T.StructField("_at", T.LongType()), T.StructField("gram", T.ArrayType(T.DoubleType()))])

    def add_up(batches):
        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
            centre, width = (np.array(batch.column(c).to_pylist(), float).reshape(len(x), -1) for c in ("_centre", "_scale"))
            x[:, :-1] = (x[:, :-1] - centre) / np.where(width > 1e-12 * (1 + np.abs(centre)), width, 1.0)
            z = np.insert(x, size - 2, 1.0, axis=1)
            out = []
            for place, sign in (("_enters", 1.0), ("_leaves", -1.0)):
                names = batch.select([*keys, place]).to_pandas()
                there = np.flatnonzero(names[place].notna())
                for k, at in names.iloc[there].groupby([*keys, place], sort=False, dropna=False).indices.items():
                    part = z[there[at]]
                    out.append(dict(zip(keys, k[:-1])) | {"_at": int(k[-1]), "gram": (sign * (part.T @ part)).ravel().tolist()})
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=to_arrow_schema(cell))

    parts = rows.where(good).join(scale, keys).select(*keys, "_enters", "_leaves", *columns, "_centre", "_scale").mapInArrow(add_up, cell)
    cells = parts.groupBy(*keys, "_at").agg(vector_to_array(Summarizer.sum(array_to_vector("gram"))).alias("gram"))
    cells = _origins(df, spec, keys).join(cells, [*keys, "_at"], "left").withColumn("_block", F.floor(F.col("_at") / block))
    totals = cells.where("gram IS NOT NULL").groupBy(*keys, "_block").agg(vector_to_array(Summarizer.sum(array_to_vector("gram"))).alias("total"))
    later = totals.select(*keys, F.col("_block").alias("_later"))
    carried = totals.join(later, keys).where("_block < _later").groupBy(*keys, F.col("_later").alias("_block")).agg(
        vector_to_array(Summarizer.sum(array_to_vector("total"))).alias("before"))
    schema = T.StructType([*fields, T.StructField("_at", T.LongType()), T.StructField("n", T.LongType()),
                           T.StructField("intercept", T.DoubleType()), T.StructField("coefficients", T.ArrayType(T.DoubleType()))])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_at")
        gram = np.zeros(size * size) if pdf["before"].iloc[0] is None else np.array(pdf["before"].iloc[0])
        centre, width = (np.array(pdf[c].iloc[0], float) for c in ("_centre", "_scale"))
        width, out = np.where(width > 1e-12 * (1 + np.abs(centre)), width, 1.0), []
        for at, step in zip(pdf["_at"], pdf["gram"]):
            gram = gram if step is None else gram + np.array(step)
            g = gram.reshape(size, size)
            beta = solve_centred(g[:-1, :-1], g[:-1, -1])
            slopes = beta[:-1] / width
            out.append((*(pdf[k].iloc[0] for k in keys), at, int(round(g[-2, -2])), float(beta[-1] - slopes @ centre), slopes.tolist()))
        return pd.DataFrame(out, columns=schema.names)

    whole = cells.join(carried, [*keys, "_block"], "left").join(scale, keys)
    return whole.repartition(*keys, "_block").groupBy(*keys, "_block").applyInPandas(solve, schema).select(
        *keys, F.timestamp_seconds(F.col("_at") * spec.every_seconds).alias("origin"), "n", "intercept", "coefficients")
