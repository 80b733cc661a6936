"""The published forecasting set-ups as one parameter each."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegrid.operators.boosted import Boosting, boosted_backtest, store_features
from tidegrid.operators.features import EARLY_FEATURES, FINAL_FEATURES, dummy_frame, early_frame, final_frame, formula_terms
from tidegrid.operators.linear import rolling_regression
from tidegrid.operators.metrics import daily_scores
from tidegrid.operators.smoothing import smoothed_sums
from tidegrid.plans.backtest import PUBLISHED, Backtest, run_spec


@dataclass(frozen=True)
class RegressionPlan:
    backtest: Backtest
    formula: str
    order: tuple | None = None
    seasonal: tuple = (0, 0, 0)
    smoothing: float | None = None
    period: int = 24


# Formula and residual orders of each regression set-up.
REGRESSIONS = {
    "single_holdout": RegressionPlan(PUBLISHED["single_holdout"], "single_holdout", (2, 0, 1), (2, 1, 0)),
    "expanding": RegressionPlan(PUBLISHED["expanding_month"], "expanding", (1, 0, 1), (1, 0, 1)),
    "rolling_quarter": RegressionPlan(PUBLISHED["rolling_quarter"], "rolling_quarter", (2, 0, 1), (1, 0, 0)),
    "rolling_two_years": RegressionPlan(PUBLISHED["rolling_two_years"], "rolling_two_years", (1, 0, 0), (1, 0, 0)),
    "smoothing_layer": RegressionPlan(PUBLISHED["smoothing_year"], "smoothing_layer", smoothing=0.1),
}


@dataclass(frozen=True)
class BoostedPlan:
    """``inputs``: final (the 90 inputs), early (weekday columns) or dummies (0/1 columns)."""
    backtest: Backtest
    boosting: Boosting
    inputs: str
    order: tuple | None = None
    seasonal: tuple = (1, 0, 0)
    period: int = 24


_ALL_COLUMNS = Boosting(tree_share=1.0, column_share=1.0)

# Inputs, tree settings and residual orders of each boosted set-up.
BOOSTED = {
    "from_february": BoostedPlan(run_spec("boosted_from_february"), _ALL_COLUMNS, "early"),
    "two_years": BoostedPlan(run_spec("boosted_two_years"), _ALL_COLUMNS, "early"),
    "three_years": BoostedPlan(run_spec("boosted_three_years"), Boosting(), "final", (1, 0, 1), (1, 0, 0)),
    "summer": BoostedPlan(run_spec("boosted_summer"), Boosting(rounds=100), "dummies"),
}


def run_boosted(rows: DataFrame, plan: BoostedPlan, keys=("series_id",)) -> DataFrame:
    """Forecasts of one boosted set-up. ``rows`` is a filled hourly series with the daily weather columns."""
    if plan.inputs == "dummies":
        frame, used = dummy_frame(rows, keys)
    else:
        frame, used = (final_frame(rows, keys), FINAL_FEATURES) if plan.inputs == "final" else (early_frame(rows, keys), EARLY_FEATURES)
    table = store_features(frame)
    return boosted_backtest(table, used, plan.backtest, plan.boosting, plan.order, plan.seasonal, plan.period, keys)[0]


def with_backtest(plan: RegressionPlan, **changes) -> RegressionPlan:
    """The same plan with another window, horizon or limit of origins."""
    return replace(plan, backtest=replace(plan.backtest, **changes))


def run_regression(frame: DataFrame, plan: RegressionPlan, keys=("series_id",)) -> DataFrame:
    """Forecasts of one set-up. ``frame`` holds the columns its formula names."""
    made = formula_terms(plan.formula)
    rows = frame.select(*keys, "ts", "value", *[c.alias(n) for n, c in made.items()])
    if plan.smoothing is not None:
        rows = smoothed_sums(rows, plan.smoothing, plan.backtest.step, keys)
    return rolling_regression(rows, list(made), plan.backtest, residual_order=plan.order,
                              residual_seasonal=plan.seasonal, period=plan.period, smoothing=plan.smoothing, keys=keys)


def score_days(forecast: DataFrame, spec: Backtest, keys=("series_id",), denominator: str = "actual") -> DataFrame:
    """Daily result rows over the scored steps; the label is the scored day."""
    rows = forecast.where(F.col("step").between(spec.score_from, spec.horizon)).withColumns(
        {"day": F.to_date("origin"), "hour": F.hour("ts")})
    return daily_scores(rows, (*keys, "day"), denominator=denominator)
