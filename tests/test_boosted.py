"""Boosted trees: the kernel against loops, both ways of fitting all origins, early stop, no look-ahead."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import hours
from tests.test_models import wave
from tidegrid.catalogue.forecasts import _DAY_FEATURES, BOOSTED_SPEC, BOOSTING, _boosted_table
from tidegrid.functions import trees
from tidegrid.operators import boosted, features
from tidegrid.plans.backtest import Backtest, origin_list

SPEC = Backtest(train=24 * 10 + 8, valid=32)
USED = ["l2", "hour"]


@pytest.fixture(scope="module")
def load(series):
    return series({"a": hours("2020-01-01 00:00:00", wave(24 * 16)), "b": hours("2020-01-01 00:00:00", wave(24 * 16, seed=9))}).cache()


def frame(rows):
    return boosted.store_features(features.load_frame(rows, lags={"l2": 48}, need=[]).select(
        "series_id", "ts", "value", "l2", F.hour("ts").alias("hour")))


def models_of(df):
    return {r["_o"]: r.asDict() for r in df.collect()}


def grown(x, y, fitted, b, depth=0):
    """A tree by plain loops: (input, edge, left, right), or the leaf's value."""
    g, n = sum(f - t for f, t in zip(fitted, y)), len(y)
    best, found = b.gamma, None
    for i in range(x.shape[1] if depth < b.depth else 0):
        for edge in sorted(set(x[:, i]))[:-1]:
            left = x[:, i] <= edge
            gl, nl = (fitted - y)[left].sum(), left.sum()
            if min(nl, n - nl) < b.min_rows:
                continue
            gain = 0.5 * (gl ** 2 / (nl + b.l2) + (g - gl) ** 2 / (n - nl + b.l2) - g ** 2 / (n + b.l2))
            if gain > best * (1 + 1e-9):
                best, found = gain, (i, edge, left)
    if found is None:
        return -b.rate * g / (n + b.l2)
    i, edge, left = found
    return i, edge, *(grown(x[m], y[m], fitted[m], b, depth + 1) for m in (left, ~left))


def leaf(tree, row):
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_kernel_against_loops(depth):
    rng = np.random.default_rng(depth)
    x, b = rng.integers(0, 12, (200, 3)).astype(float), trees.Boosting(rounds=5, depth=depth, row_share=1.0, tree_share=1.0, column_share=1.0, start=3.0, rate=0.3)
    y = x[:, 0] * (x[:, 1] > 5) - x[:, 2] + rng.normal(size=200)
    kept, errors, *model = trees.fit(x, y, np.zeros(200, bool), np.arange(200), b, 7)
    assert kept == 5 and errors == []
    fitted = np.full(200, b.start)
    for _ in range(5):
        tree = grown(x, y, fitted, b)
        fitted = fitted + np.array([leaf(tree, r) for r in x])
    assert trees.predict(x, 5, *model[:3], b) == pytest.approx(fitted, rel=1e-9)


def test_draws_do_not_depend_on_the_task():
    b, ids = trees.Boosting(), np.random.default_rng(1).integers(-2 ** 62, 2 ** 62, 20_000)
    drawn = trees.drawn_rows(ids, b, 5, 3)
    assert abs(drawn.mean() - 0.9) < 0.01 and (drawn[::-1] == trees.drawn_rows(ids[::-1], b, 5, 3)).all()
    assert (drawn != trees.drawn_rows(ids, b, 5, 4)).any() and (drawn != trees.drawn_rows(ids, b, 6, 3)).any()
    levels = [trees.drawn_columns(20, b, 5, 3, k) for k in range(5)]
    assert [x.sum() for x in levels] == [16] * 5 and np.any(levels, axis=0).sum() <= 18
    assert trees.drawn_columns(20, trees.Boosting(tree_share=1.0, column_share=1.0), 5, 3, 1).all()


def test_levels_over_all_origins_equal_fits_in_tasks(load):
    """The way for windows larger than a task gives the same trees, errors and rounds."""
    table, b = frame(load), trees.Boosting(rounds=14, depth=3, rate=0.9, patience=2)
    here, there = (models_of(boosted.fit_origins(table, USED, SPEC, b, task_rows=n)) for n in (10 ** 6, 100))
    assert len(here) == 5 and here.keys() == there.keys()
    for o, m in here.items():
        assert m["kept"] == there[o]["kept"] and m["feature"] == there[o]["feature"]
        for c in ("errors", "edge", "leaf", "gain"):
            assert m[c] == pytest.approx(there[o][c], rel=1e-9)
    assert {len(m["errors"]) for m in here.values()} != {14}
    spec = Backtest(**{**SPEC.__dict__, "first": "2020-01-15"})
    a, z = (sorted(map(tuple, boosted.forecasts(table, USED, spec, boosted.fit_origins(table, USED, spec, b, task_rows=n), b).collect()))
            for n in (10 ** 6, 100))
    assert len(a) == 2 * 2 * 40 and [r[:4] for r in a] == [r[:4] for r in z] and [r[-1] for r in a] == pytest.approx([r[-1] for r in z])


def test_early_stop_keeps_the_rounds_of_the_whole_length(load):
    table = frame(load)
    spec = Backtest(**{**SPEC.__dict__, "first": "2020-01-14", "last": "2020-01-14"})
    for rate in (0.1, 1.0):
        b = trees.Boosting(rounds=40, rate=rate, patience=2, depth=2)
        (staged,), (whole,) = (models_of(boosted.fit_origins(table, USED, spec, b, all_rounds=x)).values() for x in (False, True))
        assert staged["kept"] == whole["kept"] and staged["errors"] == whole["errors"][:len(staged["errors"])] and len(whole["errors"]) == 40
    assert len(staged["errors"]) < 40


def test_forecast_does_not_look_ahead(load):
    spec, b = Backtest(**{**SPEC.__dict__, "first": "2020-01-14", "last": "2020-01-14"}), trees.Boosting(rounds=4, depth=2)
    changed = load.withColumn("value", F.when(F.col("ts") > F.to_timestamp(F.lit("2020-01-13 07:00:00")), F.col("value") * 3 + 7).otherwise(F.col("value")))

    def forecast(rows):
        # The two-day lag reaches past the end of training only after step 40.
        out, _ = boosted.boosted_backtest(frame(rows), USED, spec, b, residual_order=(1, 0, 0), residual_seasonal=(0, 0, 0))
        return [r["predicted"] for r in out.orderBy("series_id", "step").collect()]

    assert forecast(load) == pytest.approx(forecast(changed), rel=1e-9)


def test_residual_layer_works_on_each_origins_own_residuals(load):
    from tidegrid.functions.solve import seasonal_arma_forecast
    table, b = frame(load), trees.Boosting(rounds=4, depth=2)
    out, models = boosted.boosted_backtest(table, USED, SPEC, b, residual_order=(1, 0, 0), residual_seasonal=(0, 0, 0))
    rows = boosted.predicted_rows(table, USED, SPEC, models, b, window=True).where("series_id = 'b'").toPandas().sort_values("ts")
    got = out.where("series_id = 'b'").toPandas()
    assert got.origin.nunique() == 5 and len(got) == 200
    for o, part in got.groupby("origin"):
        own = rows[rows._o == int(o.timestamp())]
        left = (own.value - own.prediction).to_numpy()[:SPEC.train]
        want = seasonal_arma_forecast(left, 40, (1, 0, 0), (0, 0, 0), 24)
        assert part.sort_values("step").residual.tolist() == pytest.approx(list(want), rel=1e-6, abs=1e-9)


def test_missing_inputs_are_told_apart(load):
    rows = load.where("series_id = 'a'").withColumn("h", F.when(F.hour("ts") >= 12, F.lit(1.0))).withColumn(
        "value", F.when(F.col("h").isNull(), 10.0).otherwise(50.0))
    spec = Backtest(train=SPEC.train, first="2020-01-14", last="2020-01-14")
    out, _ = boosted.boosted_backtest(boosted.store_features(rows.select("series_id", "ts", "value", "h")), ["h"], spec,
                                      trees.Boosting(rounds=40, rate=0.3, row_share=1.0, tree_share=1.0, column_share=1.0))
    assert out.agg(F.max(F.abs(F.col("actual") - F.col("predicted")))).first()[0] < 0.5


def test_series_of_different_span(series):
    rows = series({"long": hours("2020-01-01 00:00:00", wave(24 * 16)), "late": hours("2020-01-03 05:00:00", wave(24 * 14, seed=2))})
    out, models = boosted.boosted_backtest(frame(rows), USED, SPEC, trees.Boosting(rounds=3, depth=2))
    want = {(r["series_id"], r["origin"]) for r in origin_list(rows, SPEC).collect()}
    assert {(r["series_id"], r["origin"]) for r in out.select("series_id", "origin").distinct().collect()} == want and models.count() == 5


def test_best_round_waits_for_patience():
    assert boosted.best_round([5, 4, 3, 4, 4, 2, 9], patience=2) == 3
    assert boosted.best_round([5, 4, 3, 4, 4, 2, 9], patience=3) == 6
    assert boosted.best_round([3.0], patience=1) == 1


def test_every_weekly_origin_of_the_daily_table_is_fitted(spark, small):
    table = _boosted_table(spark, small)
    models = boosted.fit_origins(table, _DAY_FEATURES, BOOSTED_SPEC, BOOSTING)
    assert BOOSTING == trees.Boosting() and BOOSTING.rounds == 120
    assert sorted(models_of(models)) == boosted.origins(table, BOOSTED_SPEC) and models.count() > 150
    for m in models_of(models).values():
        assert trees.settled(m["errors"], BOOSTING.patience) or len(m["errors"]) == 120
    shares = boosted.importance(models, _DAY_FEATURES).toPandas()
    assert len(shares) == len(_DAY_FEATURES) + 2 and shares.importance.sum() == pytest.approx(1)
