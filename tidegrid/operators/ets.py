"""Exponential smoothing with trend, chosen per origin from a fixed grid.

Forms without a season: level only (ANN), additive trend (AAN) and damped
additive trend (AAdN), on Box-Cox values if asked. Each origin fits its own
training window: the rows of a chunk of origins are gathered once, and every
origin works on a slice of that bounded array, all in one projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegrid.functions.terms import box_cox, inverse_box_cox
from tidegrid.operators.blocks import epoch, spread
from tidegrid.operators.linear import chunk_size
from tidegrid.plans.backtest import Backtest, horizon_rows, origin_chunks

# Parameter grid. The trend weight is a share of the level weight.
ALPHAS = (0.05, 0.1, 0.2, 0.4, 0.7, 0.95)
TREND_SHARES = (0.02, 0.1, 0.3)
DAMPINGS = (0.8, 0.9, 0.98)
FORMS = ("ANN", "AAN", "AAdN")
Z_95 = 1.959963984540054  # Fixed value: normal quantile of a 95 % interval.
SLOPE_ROWS = 10           # Fixed value: rows whose mean change starts the trend.


def candidates(forms=FORMS) -> list[tuple[str, float, float, float, int]]:
    """(form, alpha, beta, phi, number of free values) of the grid."""
    out = []
    for form in forms:
        for a in ALPHAS:
            if form == "ANN":
                out.append((form, a, 0.0, 1.0, 3))
            else:
                for share in TREND_SHARES:
                    for phi in (DAMPINGS if form == "AAdN" else (1.0,)):
                        out.append((form, a, a * share, phi, 6 if form == "AAdN" else 5))
    return out


def _candidate_array(forms) -> Column:
    return F.array(*[F.struct(F.lit(f).alias("form"), F.lit(a).alias("alpha"), F.lit(b).alias("beta"),
                              F.lit(p).alias("phi"), F.lit(float(k)).alias("k"))
                     for f, a, b, p, k in candidates(forms)])


def _run(z: Column, c: Column) -> Column:
    """Score and final state of one candidate over one window."""
    slope = (F.element_at(z, SLOPE_ROWS + 1) - F.element_at(z, 1)) / F.lit(float(SLOPE_ROWS))
    start = F.struct(F.element_at(z, 1).alias("l"),
                     F.when(c["form"] == "ANN", F.lit(0.0)).otherwise(slope).alias("b"),
                     F.lit(0.0).alias("sse"))

    def move(s: Column, y: Column) -> Column:
        trend = c["phi"] * s["b"]
        error = y - s["l"] - trend
        return F.struct((s["l"] + trend + c["alpha"] * error).alias("l"),
                        (trend + c["beta"] * error).alias("b"), (s["sse"] + error * error).alias("sse"))

    n = (F.size(z) - 1).cast("double")
    penalty = c["k"] * 2 + c["k"] * 2 * (c["k"] + 1) / (n - c["k"] - 1)

    def finish(s: Column) -> Column:
        return F.struct((n * F.log(s["sse"] + F.lit(1e-300)) + penalty).alias("aicc"),
                        c["form"].alias("form"), c["alpha"].alias("alpha"), c["beta"].alias("beta"),
                        c["phi"].alias("phi"), s["l"].alias("l"), s["b"].alias("b"), s["sse"].alias("sse"),
                        n.alias("n"))

    return F.aggregate(F.slice(z, F.lit(2), F.size(z) - 1), start, move, finish)


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a column named in a lambda body
    would be computed again for every element."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _moments(q: Column) -> Column:
    """Mean and sample standard deviation of an array."""
    total = F.aggregate(q, F.lit(0.0), lambda s, v: s + v)

    def around(mean: Column) -> Column:
        squares = F.aggregate(q, F.lit(0.0), lambda s, v: s + (v - mean) * (v - mean))
        return F.struct(mean.alias("m"), F.sqrt(squares / (F.size(q) - 1)).alias("s"))

    return _bind(total / F.size(q), around)


def _window_lambda(y: Column, period: int, grid) -> Column:
    """Box-Cox parameter of one window, as in smoothing.guerrero_lambda."""
    starts = F.sequence(F.lit(0), F.floor(F.size(y) / period).cast("int") - 1)
    blocks = F.transform(starts, lambda i: _moments(F.slice(y, i * period + 1, F.lit(period))))

    def score(of_blocks: Column, lam: Column) -> Column:
        ratios = F.transform(of_blocks, lambda p: p["s"] / F.pow(p["m"], F.lit(1.0) - lam))
        return _bind(ratios, lambda q: _bind(_moments(q), lambda v: F.struct(
            (v["s"] / F.nullif(v["m"], F.lit(0.0))).alias("cv"), lam.alias("lam"))))

    values = F.array(*[F.lit(float(g)) for g in grid])
    return _bind(blocks, lambda of: F.array_min(F.transform(values, lambda lam: score(of, lam))))["lam"]


def origin_windows(df: DataFrame, spec: Backtest, keys=("series_id",), value: str = "value",
                   per_chunk: int | None = None) -> DataFrame:
    """One row per origin with its training values in time order (``_y``).

    A chunk of origins is gathered once and cut by position, so rows are copied
    per chunk and not per origin. Arrays are as long as window plus chunk."""
    if spec.expanding:
        raise ValueError("windows of growing length are not supported here")
    per_chunk = per_chunk or chunk_size(spec)
    span = per_chunk * spec.every_seconds
    s = spec.step_seconds
    rows = origin_chunks(df.select(*keys, "ts", value), spec, per_chunk, keys)
    chunks = spread(rows, *keys, "_chunk").groupBy(*keys, "_chunk").agg(
        F.first("_first").alias("_first"), F.first("_last").alias("_last"), F.min(epoch()).alias("_s0"),
        F.transform(F.array_sort(F.collect_list(F.struct(epoch().alias("s"), F.col(value).cast("double").alias("v")))),
                    lambda r: r["v"]).alias("_all"))
    low = F.greatest(F.col("_first"), F.col("_chunk") * span)
    high = F.least(F.col("_last"), (F.col("_chunk") + 1) * span - 1)
    origins = F.sequence(low, low + F.floor((high - low) / spec.every_seconds) * spec.every_seconds,
                         F.lit(spec.every_seconds).cast("long"))
    at = ((F.col("_o") - F.col("_s0")) / s).cast("int") - (spec.score_from - 1) - spec.train
    return (chunks.withColumn("_o", F.explode(F.when(low <= high, origins)))
            .select(*keys, F.timestamp_seconds("_o").alias("origin"),
                    F.slice("_all", at + 1, F.lit(spec.train)).alias("_y")))


def ets_models(df: DataFrame, spec: Backtest, forms=FORMS, lam: float | str | None = None,
               lambda_period: int = 2, lambda_grid=tuple(i / 10 for i in range(-10, 21)),
               keys=("series_id",)) -> DataFrame:
    """Best candidate by AICc per origin. ``lam``: None (no transform), a number, or
    "auto" (chosen per window; needs positive values)."""
    choices = _candidate_array(forms)

    def best(z: Column) -> Column:
        return F.array_min(F.transform(choices, lambda c: _run(z, c)))

    def fitted(y: Column) -> Column:
        if lam is None:
            return F.struct(F.lit(None).cast("double").alias("lam"), best(y).alias("m"))
        chosen = _window_lambda(y, lambda_period, lambda_grid) if lam == "auto" else F.lit(float(lam))
        return _bind(chosen, lambda p: F.struct(p.alias("lam"), _bind(
            F.transform(y, lambda v: box_cox(v, p)), best).alias("m")))

    windows = origin_windows(df, spec, keys)
    return windows.select(*keys, "origin", _bind(F.col("_y"), fitted).alias("f")).select(
        *keys, "origin", "f.lam", "f.m.*")


def ets_forecast(df: DataFrame, spec: Backtest, forms=FORMS, lam: float | str | None = None,
                 z: float = Z_95, keys=("series_id",), **options) -> DataFrame:
    """Point forecast and interval of every origin and step. ``z=0`` gives a
    degenerate interval."""
    return forecast_of(df, spec, ets_models(df, spec, forms, lam, keys=keys, **options), lam, z, keys)


def forecast_of(df: DataFrame, spec: Backtest, models: DataFrame, lam: float | str | None = None, z: float = Z_95,
                keys=("series_id",)) -> DataFrame:
    """Point forecast and interval of every origin and step from the models of the origins."""
    future = horizon_rows(df.select(*keys, "ts", "value"), spec, keys)
    rows = future.join(models, [*keys, "origin"])
    phi, h = F.col("phi"), F.col("step").cast("double")

    def damped(n: Column) -> Column:
        return F.when(phi == 1.0, n).otherwise(phi * (F.lit(1.0) - F.pow(phi, n)) / (F.lit(1.0) - phi))

    centre = F.col("l") + F.col("b") * damped(h)
    weights = F.when(F.col("step") > 1, F.aggregate(
        F.sequence(F.lit(1), F.col("step") - 1), F.lit(0.0),
        lambda s, j: s + F.pow(F.col("alpha") + F.col("beta") * damped(j.cast("double")), F.lit(2.0)))).otherwise(
        F.lit(0.0))
    reach = F.lit(float(z)) * F.sqrt(F.col("sse") / F.col("n") * (F.lit(1.0) + weights))

    def back(c: Column) -> Column:
        return c if lam is None else inverse_box_cox(c, F.col("lam"))

    return rows.select(*keys, "origin", "step", "ts", F.col("value").alias("actual"), "form",
                       back(centre).alias("predicted"), back(centre - reach).alias("lower"),
                       back(centre + reach).alias("upper"))
