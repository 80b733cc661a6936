"""Exponential smoothing with trend, fitted per origin by a search, on rolling or growing windows.

The forms are those of ``operators.ets``. All windows of a task move through time together: one
recursion holds level, trend and squared errors of windows x candidates as arrays, so a step costs a few array operations
whatever the number of origins. Growing windows start alike: one run gives the state at every origin, carried from origin
to origin. The grid is a start only: around the best point of each form a pattern search halves its steps
until neighbours differ by less than ``TOLERANCE``, and the form is chosen by AICc.

Rolling windows go by chunks of origins. A growing window is the whole series up to its origin and its recursion has an
order, so a task holds one series: 8 bytes a step (some 70 KB for a year of hours), never the other columns.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegrid.operators.blocks import epoch, spread
from tidegrid.operators.ets import FORMS, SLOPE_ROWS, Z_95, candidates, forecast_of
from tidegrid.operators.linear import chunk_size
from tidegrid.plans.backtest import Backtest, origin_bounds, origin_chunks

LAMBDAS = tuple(i / 10 for i in range(-10, 21))
# Limits of level weight, trend weight as a share of it, and damping; first step of the search, and where it ends.
LOW, HIGH = np.array([1e-4, 1e-4, 0.8]), np.array([0.9999, 0.9999, 0.98])
FIRST_STEP, TOLERANCE = np.array([0.1, 0.1, 0.04]), 1e-3
FREE = {"ANN": (0,), "AAN": (0, 1), "AAdN": (0, 1, 2)}
VALUES = {"ANN": 3, "AAN": 5, "AAdN": 6}


def run(y: np.ndarray, ends: np.ndarray, alpha, beta, phi, trend) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sse, level, slope) of windows x candidates at the ends of their windows.

    ``y`` is windows x steps, or one row if all windows start alike; ``ends`` are ascending lengths. ``trend``
    says whether a candidate starts with a slope."""
    windows, count = alpha.shape
    level = np.broadcast_to(y[:, :1], (windows, count)).copy()
    slope = np.broadcast_to((y[:, SLOPE_ROWS] - y[:, 0])[:, None] / SLOPE_ROWS if trend else 0.0, (windows, count)).copy()
    sse = np.zeros((windows, count))
    first = 0  # Windows before it have ended.
    for t in range(1, int(ends[-1])):
        while ends[first] <= t:
            first += 1
        w = slice(first, None)
        moved = phi[w] * slope[w]
        error = (y[first:, t][:, None] if len(y) == windows else y[0, t]) - level[w] - moved
        level[w] = level[w] + moved + alpha[w] * error
        slope[w] = moved + beta[w] * error
        sse[w] += error * error
    return sse, level, slope


def _criterion(sse: np.ndarray, ends: np.ndarray, values) -> np.ndarray:
    n = (ends - 1.0)[:, None]
    k = np.asarray(values, float)
    return n * np.log(sse + 1e-300) + 2 * k + 2 * k * (k + 1) / (n - k - 1)


def _states(y, ends, points: np.ndarray, form: str):
    """(AICc, sse, level, slope) of points windows x candidates x (alpha, share, phi) of one form."""
    alpha, share, phi = np.moveaxis(points, -1, 0)
    beta = np.zeros_like(alpha) if form == "ANN" else alpha * share
    phi = phi if form == "AAdN" else np.ones_like(phi)
    sse, level, slope = run(y, ends, alpha, beta, phi, form != "ANN")
    return _criterion(sse, ends, VALUES[form]), sse, level, slope


def search(y: np.ndarray, ends: np.ndarray, forms: Sequence[str] = FORMS, tolerance: float = TOLERANCE) -> list[dict]:
    """The best model of each window."""
    best: list[dict] = [{} for _ in ends]
    rows = np.arange(len(ends))
    for form in forms:
        grid = np.array([(a, b / a, p) for _, a, b, p, _ in candidates((form,))])
        points = np.repeat(grid[None], len(ends), axis=0)
        found = _states(y, ends, points, form)
        at = found[0].argmin(axis=1)
        here, state = points[rows, at], [x[rows, at] for x in found]
        step = np.ones(len(ends))
        while (step * FIRST_STEP[0]).max() > tolerance:
            around = [here] + [here + sign * step[:, None] * FIRST_STEP * (np.arange(3) == i) for i in FREE[form] for sign in (1, -1)]
            points = np.clip(np.stack(around, axis=1), LOW, HIGH)
            points[:, 0] = here
            found = _states(y, ends, points, form)
            at = found[0].argmin(axis=1)
            step = np.where(at == 0, step / 2, step)
            here, state = points[rows, at], [x[rows, at] for x in found]
        for i, (point, *values) in enumerate(zip(here, *state)):
            if not best[i] or values[0] < best[i]["aicc"]:
                alpha, share, phi = point.tolist()
                best[i] = {"aicc": values[0], "form": form, "alpha": alpha, "beta": 0.0 if form == "ANN" else alpha * share,
                           "phi": phi if form == "AAdN" else 1.0, "l": values[2], "b": values[3], "sse": values[1], "n": float(ends[i] - 1)}
    return best


def window_lambdas(y: np.ndarray, starts: np.ndarray, ends: np.ndarray, period: int, grid=LAMBDAS) -> np.ndarray:
    """Box-Cox parameter of each window y[start:end] by the least variation of sd / mean ** (1 - lam) over its whole blocks."""
    out = np.empty(len(ends))
    lam = np.array(grid)
    for phase in np.unique(starts % period):
        whole = y[phase:phase + (len(y) - phase) // period * period].reshape(-1, period)
        ratio = whole.std(axis=1, ddof=1)[:, None] / whole.mean(axis=1)[:, None] ** (1 - lam)
        one, two = (np.vstack([np.zeros(len(lam)), np.cumsum(x, axis=0)]) for x in (ratio, ratio ** 2))
        for i in np.flatnonzero(starts % period == phase):
            a = (starts[i] - phase) // period
            b = a + (ends[i] - starts[i]) // period
            n = b - a
            mean = (one[b] - one[a]) / n
            variance = np.maximum((two[b] - two[a]) - n * mean ** 2, 0) / max(n - 1, 1)
            out[i] = lam[(np.sqrt(variance) / mean).argmin()]
    return out


def _transformed(y: np.ndarray, lam: float) -> np.ndarray:
    return np.log(y) if lam == 0 else (y ** lam - 1) / lam


def fitted_models(df: DataFrame, spec: Backtest, forms=FORMS, lam: float | str | None = None, lambda_period: int = 2,
                  keys=("series_id",), tolerance: float = TOLERANCE, per_chunk: int | None = None) -> DataFrame:
    """(keys, origin, lam, aicc, form, alpha, beta, phi, l, b, sse, n): the model of each origin, as ``ets.ets_models`` gives it."""
    s, width = spec.step_seconds, spec.every_seconds
    per_chunk = per_chunk or chunk_size(spec)
    numbers = ("aicc", "alpha", "beta", "phi", "l", "b", "sse", "n")
    schema = T.StructType([*(df.schema[k] for k in keys), T.StructField("_o", T.LongType()), T.StructField("lam", T.DoubleType()),
                           T.StructField("form", T.StringType()), *(T.StructField(c, T.DoubleType()) for c in numbers)])

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_s")
        y, at0 = pdf["_v"].to_numpy(float), int(pdf["_s"].iloc[0])
        if len(y) != (int(pdf["_s"].iloc[-1]) - at0) // s + 1:
            raise ValueError("windows need a complete grid: run grid.complete and a fill first")
        first, last = int(pdf["_first"].iloc[0]), int(pdf["_last"].iloc[0])
        low = int(pdf["_chunk"].iloc[0]) * per_chunk * width
        origins = range(first, last + 1, width) if spec.expanding else range(max(first, low), min(last, low + per_chunk * width - width) + 1, width)
        if not len(origins):
            return pd.DataFrame({f.name: [] for f in schema.fields})
        ends = np.array([(o - at0) // s - (spec.score_from - 1) for o in origins])
        starts = np.full(len(ends), (first - at0) // s - (spec.score_from - 1) - spec.train) if spec.expanding else ends - spec.train
        chosen = window_lambdas(y, starts, ends, lambda_period) if lam == "auto" else np.full(len(ends), np.nan if lam is None else float(lam))
        out = []
        for value in np.unique(chosen):
            those = np.flatnonzero((chosen == value) | (np.isnan(chosen) & np.isnan(value)))
            z = y if np.isnan(value) else _transformed(y, value)
            if spec.expanding:
                windows = z[None, starts[0]:]
            else:
                windows = np.lib.stride_tricks.sliding_window_view(z, spec.train)[starts[those]]
            for i, m in zip(those, search(windows, ends[those] - starts[those], forms, tolerance)):
                out.append((*(pdf[k].iloc[0] for k in keys), origins[i], None if np.isnan(value) else float(value), m["form"], *(float(m[c]) for c in numbers)))
        return pd.DataFrame(out, columns=schema.names)

    values = df.select(*keys, "ts", F.col("value").alias("_v"))
    if spec.expanding:
        rows = values.join(origin_bounds(df, spec, keys), list(keys)).withColumn("_chunk", F.lit(0).cast("long"))
    else:
        rows = origin_chunks(values, spec, per_chunk, keys)
    rows = rows.select(*keys, "_chunk", "_first", "_last", epoch().alias("_s"), F.col("_v").cast("double").alias("_v"))
    return spread(rows, *keys, "_chunk").groupBy(*keys, "_chunk").applyInPandas(fit, schema).select(
        *keys, F.timestamp_seconds("_o").alias("origin"), "lam", "aicc", "form", *numbers[1:])


def search_forecast(df: DataFrame, spec: Backtest, forms=FORMS, lam: float | str | None = None, z: float = Z_95,
                    keys=("series_id",), **options) -> DataFrame:
    """Point forecast and interval of every origin and step."""
    return forecast_of(df, spec, fitted_models(df, spec, forms, lam, keys=keys, **options), lam, z, keys)
