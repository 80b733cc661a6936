"""Forecast errors, peak hours and yearly summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 2.0  # Fixed value: percent error drawn as the target line.


def error_columns(actual: str = "actual", predicted: str = "predicted",
                  denominator: str = "actual") -> dict[str, Column]:
    """ME, RMSE, MAE, MPE and MAPE as aggregates of one group.

    ``denominator`` names the side percent errors are relative to. Relative to the
    prediction, the error also changes sign: the two sides swap roles. Rows with
    a null side are skipped; a group without any pair has null errors.
    """
    a, p = F.col(actual), F.col(predicted)
    if denominator not in ("actual", "predicted"):
        raise ValueError("denominator is 'actual' or 'predicted'")
    e, d = (a - p, a) if denominator == "actual" else (p - a, p)
    # A zero denominator gives no percent error rather than an error.
    pct = F.lit(100.0) * e / F.nullif(d, F.lit(0.0))
    return {
        "me": F.avg(e),
        "rmse": F.sqrt(F.avg(e * e)),
        "mae": F.avg(F.abs(e)),
        "mpe": F.avg(pct),
        "mape": F.avg(F.abs(pct)),
    }


def errors(df: DataFrame, by, actual: str = "actual", predicted: str = "predicted",
           denominator: str = "actual") -> DataFrame:
    cols = error_columns(actual, predicted, denominator)
    return df.groupBy(*by).agg(*[c.alias(n) for n, c in cols.items()])


def peak_hours(value: str, label: str = "hour") -> Column:
    """Aggregate: sorted labels at which the value of the group is highest, ties
    kept. Empty if any value is missing. A group is one day, so at most 24 rows
    are collected."""
    rows = F.collect_list(F.struct(F.col(value).alias("v"), F.col(label).alias("h")))
    top = F.when(F.count(value) == F.count(F.lit(1)), F.max(value))
    return F.when(top.isNull(), F.array().cast("array<int>")).otherwise(
        F.array_sort(F.transform(F.filter(rows, lambda r: r["v"] == top), lambda r: r["h"])))


def peak_text(peaks: Column) -> Column:
    return F.array_join(peaks.cast("array<string>"), " ")


def daily_scores(df: DataFrame, by=("series_id", "day"), actual: str = "actual",
                 predicted: str = "predicted", label: str = "hour",
                 denominator: str = "actual") -> DataFrame:
    """One row per series and day: errors, and peak hours of both sides."""
    cols = error_columns(actual, predicted, denominator)
    return (df.groupBy(*by).agg(*[c.alias(n) for n, c in cols.items()],
                                peak_hours(actual, label).alias("peaks"),
                                peak_hours(predicted, label).alias("peaks_pred"))
              .withColumns({"peak": peak_text(F.col("peaks")),
                            "peak_pred": peak_text(F.col("peaks_pred"))}))


def with_peak_hits(scores: DataFrame) -> DataFrame:
    """Exact match, overlap with a tied set, and first peak within one hour."""
    some = F.size("peaks") > 0
    near = F.abs(F.get("peaks", F.lit(0)) - F.get("peaks_pred", F.lit(0))) <= 1
    return scores.withColumns({
        "hit_exact": F.when(some, (F.col("peak") == F.col("peak_pred")).cast("int")),
        "hit_any": F.when(some, F.arrays_overlap("peaks", "peaks_pred").cast("int")),
        "hit_near": F.when(some, near.cast("int")),
        "tied": F.when(some, (F.size("peaks") > 1).cast("int")),
    })


def yearly_summary(scores: DataFrame, by=("year",), threshold: float = THRESHOLD) -> DataFrame:
    """Mean errors and days under the threshold; days without a score are skipped."""
    return scores.groupBy(*by).agg(
        F.count("mape").alias("days"),
        F.avg("mape").alias("mean_mape"),
        F.avg("rmse").alias("mean_rmse"),
        F.count_if(F.col("mape") <= threshold).alias("days_under_threshold"))


def over_threshold(scores: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Feed of the daily error chart."""
    return scores.withColumn("over_threshold", (F.col("mape") > threshold).cast("int"))
