"""Autoregression on lag features with any Spark ML regressor, forecast step by step."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.blocks import STEP_SECONDS, epoch
from tidegrid.operators.lags import add_lags
from tidegrid.session import checkpointed


def default_regressor():
    return GBTRegressor(featuresCol="features", labelCol="_z", predictionCol="_p", maxIter=20, maxDepth=5,
                        stepSize=0.1, seed=42)


def fit_autoregression(df: DataFrame, lags, step: str, regressor=None, keys=("series_id",)):
    """One model for all series on values scaled by their series' mean and spread."""
    scale = df.groupBy(*keys).agg(F.avg("value").alias("_m"), F.stddev("value").alias("_sd"))
    scaled = df.join(scale, list(keys)).withColumn("_z", (F.col("value") - F.col("_m")) / F.col("_sd"))
    names = {f"lag{k}": k for k in lags}
    rows = add_lags(scaled.select(*keys, "ts", "_z"), names, step, value="_z", pad=None, keys=keys)
    ready = VectorAssembler(inputCols=list(names), outputCol="features", handleInvalid="skip").transform(rows)
    regressor = regressor or default_regressor()
    return regressor.fit(ready.select("features", "_z")), scale


def recursive_forecast(df: DataFrame, model, scale: DataFrame, lags, horizon: int, step: str,
                       keys=("series_id",), cut_every: int = 8) -> DataFrame:
    """(keys, step, ts, predicted). The state is one row per series: its last
    ``max(lags)`` values, bounded by the widest lag. Every step scores all series
    and shifts the state; the plan is cut by a reliable checkpoint now and then."""
    depth = max(lags)
    last = df.groupBy(*keys).agg(F.max(epoch()).alias("_end"))
    width = STEP_SECONDS[step]
    recent = (df.join(last, list(keys)).where(epoch() > F.col("_end") - depth * width)
              .join(scale, list(keys))
              .groupBy(*keys, "_end", "_m", "_sd").agg(F.transform(
                  F.array_sort(F.collect_list(F.struct(epoch().alias("s"), (
                      (F.col("value") - F.col("_m")) / F.col("_sd")).alias("z")))), lambda r: r["z"]).alias("_state")))
    state = recent.where(F.size("_state") == depth).withColumn("_out", F.array().cast("array<double>"))
    names = [f"lag{k}" for k in lags]
    kept = [*keys, "_end", "_m", "_sd", "_state", "_out"]
    for h in range(1, horizon + 1):
        rows = state.select(*kept, *[F.element_at("_state", depth + 1 - k).alias(f"lag{k}") for k in lags])
        scored = model.transform(VectorAssembler(inputCols=names, outputCol="features").transform(rows))
        state = scored.select(
            *keys, "_end", "_m", "_sd",
            F.concat(F.slice("_state", 2, depth - 1), F.array("_p")).alias("_state"),
            F.concat("_out", F.array("_p")).alias("_out"))
        if h % cut_every == 0 and h < horizon:
            state = checkpointed(state)
    return state.select(*keys, "_end", "_m", "_sd", F.posexplode("_out").alias("_h", "_z")).select(
        *keys, (F.col("_h") + 1).alias("step"),
        F.timestamp_seconds(F.col("_end") + (F.col("_h") + 1) * width).alias("ts"),
        (F.col("_z") * F.col("_sd") + F.col("_m")).alias("predicted"))
