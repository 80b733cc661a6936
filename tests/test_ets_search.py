"""Searched smoothing models against plain recursions, rolling and growing windows."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import hours
from tests.test_models import wave
from tidegrid.operators import ets, ets_search
from tidegrid.plans.backtest import Backtest, origin_list

SPEC = Backtest(train=24 * 4 + 8)


@pytest.fixture(scope="module")
def load(series):
    return series({"a": hours("2020-01-01 00:00:00", wave(24 * 14)), "b": hours("2020-01-01 00:00:00", wave(24 * 10, seed=9))}).cache()


def plain(y, alpha, beta, phi, form):
    level, slope, sse = y[0], 0.0 if form == "ANN" else (y[10] - y[0]) / 10, 0.0
    for v in y[1:]:
        e = v - level - phi * slope
        level, slope, sse = level + phi * slope + alpha * e, phi * slope + beta * e, sse + e * e
    return sse, level, slope


def criterion(sse, n, form):
    k = ets_search.VALUES[form]
    return (n - 1) * np.log(sse) + 2 * k + 2 * k * (k + 1) / (n - 1 - k - 1)


@pytest.mark.parametrize("growing", [False, True])
@pytest.mark.parametrize("lam", [None, "auto"])
def test_models_of_every_origin(load, growing, lam):
    spec = replace(SPEC, expanding=growing)
    got = ets_search.fitted_models(load, spec, lam=lam).collect()
    coarse = {} if growing else {(r["series_id"], r["origin"]): r for r in ets.ets_models(load, spec, lam=lam).collect()}
    rows = {k: p.sort_values("ts") for k, p in load.toPandas().groupby("series_id")}
    listed = origin_list(load, spec).toPandas()
    assert len(got) == len(listed) > 10
    begin = listed.groupby("series_id").train_start.min()
    ends = {(o.series_id, o.origin): (begin[o.series_id] if growing else o.train_start, o.train_end) for o in listed.itertuples()}
    for m in got:
        a, b = ends[m["series_id"], m["origin"]]
        p = rows[m["series_id"]]
        y = p[(p.ts >= a) & (p.ts <= b)].value.to_numpy()
        if lam:
            y = ets_search._transformed(y, m["lam"])
        sse, level, slope = plain(y, m["alpha"], m["beta"], m["phi"], m["form"])
        assert (m["sse"], m["l"], m["n"]) == (pytest.approx(sse, rel=1e-8), pytest.approx(level, rel=1e-8), len(y) - 1)
        assert m["b"] == pytest.approx(slope, rel=1e-6, abs=1e-9) and m["aicc"] == pytest.approx(criterion(sse, len(y), m["form"]), rel=1e-9)
        if coarse:
            grid = coarse[m["series_id"], m["origin"]]
            assert m["aicc"] <= grid["aicc"] + 1e-9 and (lam is None or m["lam"] == pytest.approx(grid["lam"]))


def test_refining_further_gains_nothing(load):
    spec = replace(SPEC, expanding=True)
    here, there = ({(r["series_id"], r["origin"]): r["aicc"] for r in ets_search.fitted_models(load, spec, tolerance=t).collect()}
                   for t in (ets_search.TOLERANCE, ets_search.TOLERANCE / 16))
    assert max(here[k] - there[k] for k in here) < 0.01 and all(there[k] <= here[k] + 1e-9 for k in here)


def test_forecasts_do_not_look_ahead(load):
    spec = replace(SPEC, expanding=True, first="2020-01-09", last="2020-01-09")
    changed = load.withColumn("value", F.when(F.col("ts") > F.to_timestamp(F.lit("2020-01-08 07:00:00")), F.col("value") * 3 + 7).otherwise(F.col("value")))
    a, b = ([r["predicted"] for r in ets_search.search_forecast(x, spec, ("AAdN",), lam="auto").orderBy("series_id", "step").collect()]
            for x in (load, changed))
    assert len(a) == 80 and a == pytest.approx(b, rel=1e-12)
