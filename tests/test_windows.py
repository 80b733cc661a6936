"""Window figures and fits by prefix sums against plain loops over every origin."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import hours
from tests.test_models import wave
from tidegrid.operators import features, windows
from tidegrid.plans.backtest import Backtest, origin_list, training_rows

SPECS = {"rolling": Backtest(train=24 * 4 + 8), "growing": Backtest(train=24 * 4 + 8, expanding=True),
         "odd": Backtest(train=53, horizon=9, score_from=5, every=7), "long steps": Backtest(train=10, horizon=4, score_from=2, every=36)}


@pytest.fixture(scope="module")
def load(series):
    return series({"a": hours("2020-01-01 00:00:00", wave(24 * 20)), "b": hours("2020-01-03 05:00:00", wave(24 * 12, seed=9))}).cache()


def plain(load, spec):
    rows, out = {k: p.sort_values("ts") for k, p in load.toPandas().groupby("series_id")}, {}
    listed = origin_list(load, spec).toPandas()
    for k, part in listed.groupby("series_id"):
        begin = part.train_start.min()
        for o in part.itertuples():
            p = rows[k]
            start = begin if spec.expanding else o.train_start
            out[k, o.origin] = p[(p.ts >= start) & (p.ts <= o.train_end)]
    return out


@pytest.mark.parametrize("block", [3, 256])
@pytest.mark.parametrize("name", SPECS)
def test_sums_edges_and_fits(load, monkeypatch, name, block):
    monkeypatch.setattr(windows, "BLOCK", block)
    monkeypatch.setattr(windows.running, "__defaults__", ((), (), block))
    spec = SPECS[name]
    made = features.load_frame(load, lags={"l2": 48}, need=[]).select("series_id", "ts", "value", "l2", F.hour("ts").alias("h")).cache()
    want = plain(made, spec)
    sums = {(r["series_id"], r["origin"]): r for r in windows.window_sums(made, spec, {"n": F.lit(1), "v": F.col("value")}).collect()}
    edges = {(r["series_id"], r["origin"]): r for r in windows.window_edges(made, spec).collect()}
    fits = {(r["series_id"], r["origin"]): r for r in windows.window_coefficients(made, ["l2", "h"], spec, block=block).collect()}
    assert sums.keys() == edges.keys() == fits.keys() == want.keys() and len(want) > 10
    for k, p in want.items():
        assert sums[k]["n"] == len(p) and sums[k]["v"] == pytest.approx(p.value.sum(), rel=1e-10)
        assert (edges[k]["first_ts"], edges[k]["last_ts"]) == (p.ts.min(), p.ts.max())
        x = np.column_stack([p.l2, p.h, np.ones(len(p))])
        beta = np.linalg.lstsq(x, p.value.to_numpy(), rcond=None)[0]
        got = fits[k]
        assert got["n"] == len(p)
        if name != "long steps":
            assert x[:, :2] @ np.array(got["coefficients"]) + got["intercept"] == pytest.approx(x @ beta, rel=1e-6)


def test_rows_missing_cells_and_empty_tables(load):
    spec = SPECS["growing"]
    holed = load.withColumn("value", F.when(F.hour("ts") != 3, F.col("value"))).withColumn("x", F.hour("ts"))
    want = plain(holed, spec)
    for r in windows.window_coefficients(holed, ["x"], spec).collect():
        p = want[r["series_id"], r["origin"]].dropna()
        assert r["n"] == len(p) and r["coefficients"][0] == pytest.approx(np.polyfit(p.x, p.value, 1)[0], rel=1e-8)
    none = holed.limit(0)
    assert windows.window_sums(none, spec, {"n": F.lit(1)}).count() == 0 and windows.window_edges(none, spec).count() == 0
    assert windows.window_coefficients(none, ["x"], spec).count() == 0


def test_shuffled_rows_do_not_grow_with_the_origins(load):
    """Twelve times as many origins: the cells stay below two for each row or origin, training rows are multiplied."""
    few, many = (replace(SPECS["rolling"], every=n) for n in (24, 2))
    cells = [windows._memberships(load, s, ["series_id"]).groupBy("series_id", "_enters", "_leaves").count().count() for s in (few, many)]
    copies = [training_rows(load, s).count() for s in (few, many)]
    origins = [origin_list(load, s).count() for s in (few, many)]
    assert copies[1] > 10 * copies[0] and all(c <= 2 * o + 2 * load.count() ** 0.5 + 200 for c, o in zip(cells, origins))
    assert cells[1] <= load.count()
