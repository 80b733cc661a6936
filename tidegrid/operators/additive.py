"""Additive trend and season model for all series at once.

Trend is a straight line with hinges over the first 80 % of the range; seasons
are Fourier terms. Hinge slopes carry an L1 penalty, season terms a light L2 one.
The sums of products per series come from Spark; what is solved per series is a
small dense system.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators.blocks import DAY, STEP_SECONDS, epoch, spread
from tidegrid.operators.grid import span
from tidegrid.operators.linear import _key_fields, series_gram

# Size of the model and prior scales.
HINGES = 25
HINGE_RANGE = 0.8
HINGE_SCALE = 0.05
SEASON_SCALE = 10.0
SEASONS = {"yearly": (365.25 * DAY, 10), "weekly": (7.0 * DAY, 3), "daily": (1.0 * DAY, 4)}


def terms(seasons=tuple(SEASONS), hinges: int = HINGES) -> dict[str, dict[str, Column]]:
    """{component: {term: expression}} of the columns ``_u`` (range scaled to 0..1)
    and ``ts``."""
    u = F.col("_u")
    knots = [HINGE_RANGE * (i + 1) / (hinges + 1) for i in range(hinges)]
    out = {"trend": {"slope": u, **{f"hinge{i}": F.greatest(u - k, F.lit(0.0)) for i, k in enumerate(knots, 1)}}}
    for name in seasons:
        seconds, order = SEASONS[name]
        waves = {}
        for k in range(1, order + 1):
            angle = epoch().cast("double") * F.lit(2 * math.pi * k / seconds)
            waves[f"{name}_sin{k}"], waves[f"{name}_cos{k}"] = F.sin(angle), F.cos(angle)
        out[name] = waves
    return out


def _scaled(df: DataFrame, ranges: DataFrame, keys) -> DataFrame:
    width = F.greatest(epoch("last_ts") - epoch("first_ts"), F.lit(1))
    return df.join(ranges, list(keys)).withColumn("_u", (epoch() - epoch("first_ts")) / width)


def penalised(gram: np.ndarray, hinge: np.ndarray, season: np.ndarray, rounds: int = 500,
              tolerance: float = 1e-9) -> np.ndarray:
    """Coordinate descent on sums of products; last two rows are constant and label."""
    size = len(gram) - 1
    n, peak = gram[-2, -2], math.sqrt(max(gram[-1, -1] / max(gram[-2, -2], 1), 1e-300))
    a, b = gram[:size, :size], gram[:size, -1] / peak
    free = np.linalg.lstsq(a + 1e-9 * np.eye(size) * np.trace(a) / size, b, rcond=None)[0]
    noise = max((gram[-1, -1] / peak ** 2 - 2 * free @ b + free @ a @ free) / max(n - size, 1), 1e-12)
    l1 = np.where(hinge, noise / HINGE_SCALE, 0.0)
    l2 = np.where(season, noise / SEASON_SCALE ** 2, 0.0)
    # Start from the unpenalised fit; each sweep solves one coefficient at a time.
    beta, diagonal = free.copy(), np.maximum(np.diag(a), 1e-300)
    for _ in range(rounds):
        moved = 0.0
        for j in range(size):
            rest = b[j] - a[j] @ beta + a[j, j] * beta[j]
            new = np.sign(rest) * max(abs(rest) - l1[j], 0.0) / (diagonal[j] + l2[j])
            moved, beta[j] = max(moved, abs(new - beta[j]) * math.sqrt(diagonal[j] / n)), new
        if moved < tolerance:
            break
    return beta * peak


def fit_additive(df: DataFrame, seasons=tuple(SEASONS), hinges: int = HINGES, value: str = "value",
                 keys=("series_id",)) -> DataFrame:
    """(keys, first_ts, last_ts, coefficients): one row per series, terms in the
    order of ``terms`` with the constant last."""
    parts = terms(seasons, hinges)
    names = [t for group in parts.values() for t in group]
    ranges = span(df.select(*keys, "ts"), keys)
    made = _scaled(df.select(*keys, "ts", F.col(value).alias("_v")), ranges, keys).select(
        *keys, "ts", "_v", *[c.alias(t) for group in parts.values() for t, c in group.items()])
    schema = T.StructType([*_key_fields(df, keys), T.StructField("coefficients", T.ArrayType(T.DoubleType()))])
    size = len(names) + 2
    hinge = np.array([t.startswith("hinge") for t in names] + [False])
    season = np.array(["_sin" in t or "_cos" in t for t in names] + [False])

    def solve(frames):
        for pdf in frames:
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "coefficients": [
                penalised(np.asarray(g, dtype=float).reshape(size, size), hinge, season).tolist() for g in pdf["gram"]]})

    fitted = spread(series_gram(made, names, "_v", keys), *keys).mapInPandas(solve, schema)
    return fitted.join(ranges, list(keys))


def additive_components(rows: DataFrame, model: DataFrame, seasons=tuple(SEASONS), hinges: int = HINGES,
                        keys=("series_id",)) -> DataFrame:
    """Adds one column per component and their sum ``predicted``."""
    parts = terms(seasons, hinges)
    width = F.greatest(epoch("last_ts") - epoch("first_ts"), F.lit(1))
    wide = rows.join(model, list(keys)).withColumn("_u", (epoch() - epoch("first_ts")) / width)
    columns, at = {}, 1
    for name, group in parts.items():
        slice_ = F.slice("coefficients", F.lit(at), F.lit(len(group)))
        columns[name] = F.aggregate(F.zip_with(slice_, F.array(*group.values()), lambda b, x: b * x),
                                    F.lit(0.0), lambda s, v: s + v)
        at += len(group)
    columns["trend"] = columns["trend"] + F.element_at("coefficients", at)
    out = wide.withColumns(columns)
    total = sum((F.col(c) for c in list(parts)[1:]), F.col("trend"))
    return out.withColumn("predicted", total).drop("_u", "coefficients", "first_ts", "last_ts")


def additive_forecast(df: DataFrame, model: DataFrame, periods: int, step: str, seasons=tuple(SEASONS),
                      hinges: int = HINGES, keys=("series_id",)) -> DataFrame:
    """Components of all observed stamps and of ``periods`` steps beyond them."""
    future = model.select(*keys, F.explode(F.sequence(
        epoch("last_ts") + STEP_SECONDS[step], epoch("last_ts") + periods * STEP_SECONDS[step],
        F.lit(STEP_SECONDS[step]).cast("long"))).alias("_s")).select(
        *keys, F.timestamp_seconds("_s").alias("ts"), F.lit(None).cast("double").alias("value"))
    return additive_components(df.select(*keys, "ts", "value").unionByName(future), model, seasons, hinges, keys)
