"""Linear regression: rolling origins, whole samples, residual layers.

Rolling fits go by chunks of consecutive origins (``plans.backtest.origin_chunks``):
neighbouring windows share almost all rows, so inside a chunk the cross products
are moved along by the rows that enter and leave. The work per row is then one
outer product instead of one per origin, and a task holds one chunk, never a
whole series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tidegrid.functions.solve import seasonal_arma_forecast, solve_centred
from tidegrid.functions.special import f_tail, t_tail
from tidegrid.operators.blocks import epoch, spread
from tidegrid.plans.backtest import Backtest, horizon_rows, origin_chunks, training_rows


def chunk_size(spec: Backtest) -> int:
    """Origins per chunk: half a window of them bounds the copies to about three,
    28 or more keep short windows from making tiny groups."""
    return max(28, spec.train // (2 * spec.every))


class _Chunk:
    """Design and response of one chunk, standardised by its first window."""

    def __init__(self, pdf: pd.DataFrame, features, label: str, spec: Backtest):
        pdf = pdf.sort_values("_s")
        s = pdf["_s"].to_numpy()
        if len(s) != (s[-1] - s[0]) // spec.step_seconds + 1:
            raise ValueError("rolling fits need a complete grid: run grid.complete and a fill first")
        self.spec, self.s = spec, s
        self.y = pdf[label].to_numpy(dtype=float)
        x = pdf[list(features)].to_numpy(dtype=float)
        span = spec.every_seconds
        first, last = int(pdf["_first"].iloc[0]), int(pdf["_last"].iloc[0])
        self.start = first - (spec.score_from + spec.train - 1) * spec.step_seconds
        width = int(pdf["_span"].iloc[0])
        low = int(pdf["_chunk"].iloc[0]) * width
        self.origins = range(max(first, low), min(last, low + width - 1) + 1, span)
        a, b = self.window(self.origins[0]) if len(self.origins) else (0, 0)
        usable = x[a:b][np.isfinite(x[a:b]).all(axis=1)]
        centre = usable.mean(axis=0) if len(usable) else np.zeros(x.shape[1])
        scale = usable.std(axis=0) if len(usable) else np.ones(x.shape[1])
        self.centre, self.scale = centre, np.where(scale > 1e-12 * (1 + np.abs(centre)), scale, 1.0)
        self.z = np.hstack([(x - self.centre) / self.scale, np.ones((len(x), 1))])
        # Rows with a missing cell do not train, as in a complete-case fit.
        self.used = np.isfinite(self.z).all(axis=1) & np.isfinite(self.y)
        self.zt = np.where(self.used[:, None], self.z, 0.0)

    def position(self, seconds: int) -> int:
        return int((seconds - self.s[0]) // self.spec.step_seconds)

    def window(self, origin: int) -> tuple[int, int]:
        end = self.position(origin) - self.spec.score_from + 1
        return self.position(self.start) if self.spec.expanding else end - self.spec.train, end

    def fits(self, responses):
        """(origin, start, end, coefficients) of every origin, by rolling sums."""
        gram, at = None, None
        for o in self.origins:
            a, b = self.window(o)
            if gram is None:
                gram = self.zt[a:b].T @ self.zt[a:b]
            else:
                new, old = self.zt[at[1]:b], self.zt[at[0]:a]
                gram = gram + new.T @ new - old.T @ old
            at = (a, b)
            y = np.where(self.used[a:b], responses(a, b), 0.0)
            yield o, a, b, solve_centred(gram, self.zt[a:b].T @ y)


def _with_seconds(df: DataFrame, spec: Backtest, per_chunk: int, keys, columns) -> DataFrame:
    rows = origin_chunks(df.select(*keys, "ts", *columns), spec, per_chunk, keys)
    return rows.select(*keys, "_chunk", "_first", "_last", epoch().alias("_s"),
                       F.lit(per_chunk * spec.every_seconds).cast("long").alias("_span"),
                       *[F.col(c).cast("double").alias(c) for c in columns])


def _key_fields(df: DataFrame, keys) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def rolling_regression(df: DataFrame, features, spec: Backtest, label: str = "value",
                       residual_order=None, residual_seasonal=(0, 0, 0), period: int = 24,
                       smoothing: float | None = None, keys=("series_id",),
                       per_chunk: int | None = None) -> DataFrame:
    """Forecast every origin by least squares on its own training window.

    ``residual_order`` adds a seasonal ARMA forecast of the in-sample residuals.
    ``smoothing`` regresses on the one-step errors of exponential smoothing instead
    and adds its last level; it needs the column ``smoothed`` (smoothed_sums).

    Result: keys, origin, step, ts, actual, base, level, residual, predicted.
    """
    features = list(features)
    extra = ["smoothed"] if smoothing is not None else []
    schema = T.StructType([*_key_fields(df, keys), T.StructField("_o", T.LongType()),
                           T.StructField("step", T.IntegerType()), T.StructField("_s", T.LongType()),
                           *[T.StructField(c, T.DoubleType()) for c in ("actual", "base", "level", "residual")]])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = _Chunk(pdf, features, label, spec)
        sums = pdf.sort_values("_s")["smoothed"].to_numpy(dtype=float) if smoothing is not None else None

        def level(a, b):
            decay = (1.0 - smoothing) ** np.arange(b - a)
            return sums[a:b] + decay * (c.y[a] - sums[a])

        def responses(a, b):
            if smoothing is None:
                return c.y[a:b]
            return np.concatenate([[0.0], c.y[a + 1:b] - level(a, b)[:-1]])

        out = []
        for o, a, b, beta in c.fits(responses):
            end = b + spec.horizon
            future = np.arange(b, min(end, len(c.s)))
            layer = np.zeros(len(future))
            if residual_order is not None:
                left = np.where(c.used[a:b], responses(a, b) - c.zt[a:b] @ beta, 0.0)
                layer = seasonal_arma_forecast(left, spec.horizon, residual_order, residual_seasonal,
                                               period)[:len(future)]
            out.append(pd.DataFrame({
                "_o": o, "step": np.arange(1, len(future) + 1, dtype=np.int32), "_s": c.s[future],
                "actual": c.y[future], "base": c.z[future] @ beta,
                "level": level(a, b)[-1] if smoothing is not None else 0.0, "residual": layer}))
        result = pd.concat(out) if out else pd.DataFrame({f.name: [] for f in schema.fields[len(keys):]})
        for k in reversed(list(keys)):
            result.insert(0, k, pdf[k].iloc[0])
        return result

    rows = _with_seconds(df, spec, per_chunk or chunk_size(spec), keys, [label, *features, *extra])
    predicted = F.col("base") + F.col("level") + F.col("residual")
    return spread(rows, *keys, "_chunk").groupBy(*keys, "_chunk").applyInPandas(run, schema).select(
        *keys, F.timestamp_seconds("_o").alias("origin"), "step", F.timestamp_seconds("_s").alias("ts"),
        "actual", "base", "level", "residual", predicted.alias("predicted"))


def rolling_coefficients(df: DataFrame, features, spec: Backtest, label: str = "value",
                         keys=("series_id",), per_chunk: int | None = None) -> DataFrame:
    """One row per origin: training rows used, intercept and coefficients in the
    units of the features, in their order."""
    features = list(features)
    schema = T.StructType([*_key_fields(df, keys), T.StructField("_o", T.LongType()),
                           T.StructField("n", T.LongType()), T.StructField("intercept", T.DoubleType()),
                           T.StructField("coefficients", T.ArrayType(T.DoubleType()))])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = _Chunk(pdf, features, label, spec)
        rows = []
        for o, a, b, beta in c.fits(lambda a, b: c.y[a:b]):
            slopes = beta[:-1] / c.scale
            rows.append((*[pdf[k].iloc[0] for k in keys], o, int(c.used[a:b].sum()),
                         float(beta[-1] - slopes @ c.centre), slopes.tolist()))
        return pd.DataFrame(rows, columns=schema.names)

    rows = _with_seconds(df, spec, per_chunk or chunk_size(spec), keys, [label, *features])
    return spread(rows, *keys, "_chunk").groupBy(*keys, "_chunk").applyInPandas(run, schema).select(
        *keys, F.timestamp_seconds("_o").alias("origin"), "n", "intercept", "coefficients")


def predict_rows(df: DataFrame, coefficients: DataFrame, features, spec: Backtest, label: str = "value",
                 keys=("series_id",)) -> DataFrame:
    """Horizon rows joined with the coefficients of their origin."""
    rows = horizon_rows(df.select(*keys, "ts", label, *features), spec, keys)
    x = F.array(*[F.col(f).cast("double") for f in features])
    dot = F.aggregate(F.zip_with("coefficients", x, lambda b, v: b * v), F.lit(0.0), lambda s, v: s + v)
    return rows.join(coefficients, [*keys, "origin"]).select(
        *keys, "origin", "step", "ts", F.col(label).alias("actual"), (F.col("intercept") + dot).alias("predicted"))


def training_residuals(df: DataFrame, coefficients: DataFrame, features, spec: Backtest,
                       label: str = "value", keys=("series_id",)) -> DataFrame:
    """Actual minus in-sample fit on every training row of every origin."""
    rows = training_rows(df.select(*keys, "ts", label, *features), spec, keys)
    x = F.array(*[F.col(f).cast("double") for f in features])
    dot = F.aggregate(F.zip_with("coefficients", x, lambda b, v: b * v), F.lit(0.0), lambda s, v: s + v)
    return rows.join(coefficients, [*keys, "origin"]).select(
        *keys, "origin", "ts", (F.col(label) - F.col("intercept") - dot).alias("residual"))


def residual_forecast(residuals: DataFrame, spec: Backtest, order=(1, 0, 1), seasonal=(1, 0, 0),
                      period: int = 24, keys=("series_id",), column: str = "residual") -> DataFrame:
    """Seasonal ARMA forecast of the residuals of each (series, origin), whose
    group is one training window. Result: keys, origin, step, residual."""
    schema = T.StructType([*_key_fields(residuals, keys), T.StructField("_o", T.LongType()),
                           T.StructField("step", T.IntegerType()), T.StructField("residual", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_s")
        values = seasonal_arma_forecast(pdf["_r"].to_numpy(), spec.horizon, order, seasonal, period)
        out = pd.DataFrame({"_o": int(pdf["_o"].iloc[0]), "step": np.arange(1, spec.horizon + 1, dtype=np.int32),
                            "residual": values})
        for k in reversed(list(keys)):
            out.insert(0, k, pdf[k].iloc[0])
        return out

    rows = residuals.select(*keys, epoch("origin").alias("_o"), epoch().alias("_s"), F.col(column).alias("_r"))
    return spread(rows, *keys, "_o").groupBy(*keys, "_o").applyInPandas(run, schema).select(
        *keys, F.timestamp_seconds("_o").alias("origin"), "step", "residual")


def shared_residual_forecast(residuals: DataFrame, spec: Backtest, order=(1, 0, 1), seasonal=(1, 0, 0),
                             period: int = 24, keys=("series_id",), column: str = "residual",
                             per_chunk: int | None = None) -> DataFrame:
    """The same forecast where all origins share one residual per row, as they do
    under one model: rows go once per chunk of origins instead of once per origin."""
    schema = T.StructType([*_key_fields(residuals, keys), T.StructField("_o", T.LongType()),
                           T.StructField("step", T.IntegerType()), T.StructField("residual", T.DoubleType())])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        c = _Chunk(pdf, [], column, spec)
        out = []
        for o in c.origins:
            a, b = c.window(o)
            out.append(pd.DataFrame({
                "_o": o, "step": np.arange(1, spec.horizon + 1, dtype=np.int32),
                "residual": seasonal_arma_forecast(c.y[a:b], spec.horizon, order, seasonal, period)}))
        result = pd.concat(out) if out else pd.DataFrame({f.name: [] for f in schema.fields[len(keys):]})
        for k in reversed(list(keys)):
            result.insert(0, k, pdf[k].iloc[0])
        return result

    rows = _with_seconds(residuals, spec, per_chunk or chunk_size(spec), keys, [column])
    return spread(rows, *keys, "_chunk").groupBy(*keys, "_chunk").applyInPandas(run, schema).select(
        *keys, F.timestamp_seconds("_o").alias("origin"), "step", "residual")


def add_residual_layer(base: DataFrame, layer: DataFrame, keys=("series_id",)) -> DataFrame:
    """Base forecast plus residual forecast of the same origin and step."""
    return (base.join(layer, [*keys, "origin", "step"])
            .withColumn("predicted", F.col("predicted") + F.col("residual")))


def series_gram(df: DataFrame, features, label: str = "value", keys=("series_id",),
                held: int = 256) -> DataFrame:
    """(keys, gram): sums of products of [features, 1, label] per series, flat.

    Rows are not shuffled: every task adds up the arrays of the series it meets
    (at most ``held`` at a time) and only those arrays travel. Their sum is a
    partial aggregation too, so a series with most of the rows has no hot task."""
    keys, columns = list(keys), [*features, label]
    size = len(columns) + 1
    schema = T.StructType([*_key_fields(df, keys), T.StructField("gram", T.ArrayType(T.DoubleType()))])

    def add_up(batches):
        sums: dict[tuple, np.ndarray] = {}

        def flush():
            rows = [dict(zip(keys, k)) | {"gram": g.ravel().tolist()} for k, g in sums.items()]
            sums.clear()
            return pa.RecordBatch.from_pylist(rows, schema=to_arrow_schema(schema))

        for batch in batches:
            x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in columns])
            x = np.insert(x, size - 2, 1.0, axis=1)
            good = np.isfinite(x).all(axis=1)
            names = batch.select(keys).to_pandas()
            for k, at in names[good].groupby(keys, sort=False, dropna=False).indices.items():
                part = x[good][at]
                k = k if isinstance(k, tuple) else (k,)
                sums[k] = sums.get(k, 0.0) + part.T @ part
                if len(sums) >= held:
                    yield flush()
        if sums:
            yield flush()

    rows = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns])
    return rows.mapInArrow(add_up, schema).groupBy(*keys).agg(
        vector_to_array(Summarizer.sum(array_to_vector("gram"))).alias("gram"))


def regression_summary(df: DataFrame, features, label: str = "value", keys=("series_id",)) -> DataFrame:
    """Whole-sample fit per series: one row per term with estimate, standard error, t value and its
    two-sided p-value, and the fit's degrees of freedom, R squared, F value and its p-value."""
    names = [*features, "(Intercept)"]
    size = len(names) + 1
    schema = T.StructType([*_key_fields(df, keys), T.StructField("term", T.StringType()),
                           T.StructField("n", T.LongType()),
                           *[T.StructField(c, T.DoubleType()) for c in ("estimate", "std_error", "t_value", "r2")],
                           T.StructField("df_fit", T.LongType()), T.StructField("df", T.LongType())])

    def summarise(frames):
        for pdf in frames:
            rows = []
            for rec in pdf.to_dict("records"):
                g = np.asarray(rec["gram"], dtype=float).reshape(size, size)
                n = g[-2, -2]
                beta = solve_centred(g[:-1, :-1], g[:-1, -1])
                left = g[-1, -1] - beta @ g[:-1, -1]
                total = g[-1, -1] - g[-2, -1] ** 2 / n
                used = np.flatnonzero(np.append(beta[:-1] != 0, True))
                inverse = np.linalg.pinv(g[np.ix_(used, used)])
                error = np.full(len(beta), np.nan)
                error[used] = np.sqrt(np.maximum(left, 0) / max(n - len(used), 1) * np.diag(inverse))
                for i, name in enumerate(names):
                    rows.append((*[rec[k] for k in keys], name, int(n), float(beta[i]), float(error[i]),
                                 float(beta[i] / error[i]) if error[i] > 0 else None,
                                 float(1 - left / total) if total > 0 else None, len(used) - 1, int(n) - len(used)))
            yield pd.DataFrame(rows, columns=schema.names)

    fits = spread(series_gram(df, features, label, keys), *keys).mapInPandas(summarise, schema)
    ratio = F.when(F.col("r2") < 1, F.col("r2") / F.col("df_fit") / ((1 - F.col("r2")) / F.col("df")))
    return fits.withColumn("f_value", F.when((F.col("df_fit") > 0) & (F.col("df") > 0), ratio)).withColumns({
        "p_value": t_tail(F.col("t_value"), F.col("df")), "f_p_value": f_tail(F.col("f_value"), F.col("df_fit"), F.col("df"))})
