"""Tails against tabulated values, closed forms and numerical integration."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegrid.functions import special


def value(spark, column):
    return spark.range(1).select(column).first()[0]


def columns(*values):
    return [F.lit(float(v)) for v in values]


@pytest.mark.parametrize("x", [0.5, 1, 2.5, 7, 40, 1250.5])
def test_log_gamma(spark, x):
    assert value(spark, special.log_gamma(F.lit(float(x)))) == pytest.approx(math.lgamma(x), rel=1e-12, abs=1e-13)


@pytest.mark.parametrize("x,df,want", [(3.841459, 1, 0.05), (5.991465, 2, 0.05), (11.0705, 5, 0.05), (18.30704, 10, 0.05), (0.0, 3, 1.0)])
def test_chi_square(spark, x, df, want):
    assert value(spark, special.chi_square_tail(*columns(x, df))) == pytest.approx(want, abs=1e-6)


def test_chi_square_of_even_degrees_in_closed_form(spark):
    rows = spark.createDataFrame([(float(x), d) for x in (0.1, 3, 30, 90, 400) for d in (2, 10, 60, 300)], "x double, d int")
    for r in rows.withColumn("p", special.chi_square_tail(F.col("x"), F.col("d"))).collect():
        half = r["x"] / 2
        want = math.fsum(math.exp(-half + i * math.log(half) - math.lgamma(i + 1)) for i in range(r["d"] // 2))
        assert r["p"] == pytest.approx(want, rel=1e-9, abs=1e-15)


@pytest.mark.parametrize("t,df,want", [(12.706205, 1, 0.05), (2.228139, 10, 0.05), (1.959964, 10 ** 7, 0.05), (0, 5, 1.0), (-4.032143, 5, 0.01)])
def test_t(spark, t, df, want):
    assert value(spark, special.t_tail(*columns(t, df))) == pytest.approx(want, abs=2e-7)


def test_f(spark):
    for f, a, b in ((1.0, 3, 7), (2.5, 4, 30), (0.2, 10, 12), (9.0, 1, 50)):
        u = np.linspace(0, math.sqrt(f), 200_001)  # u squared is the variable, so the density has no pole
        front = math.exp(math.lgamma((a + b) / 2) - math.lgamma(a / 2) - math.lgamma(b / 2)) * (a / b) ** (a / 2)
        density = 2 * front * u ** (a - 1) * (1 + a / b * u ** 2) ** (-(a + b) / 2)
        assert value(spark, special.f_tail(*columns(f, a, b))) == pytest.approx(1 - np.trapezoid(density, u), abs=1e-8)


def test_undefined(spark):
    assert value(spark, special.t_tail(*columns(1, 0))) is None and value(spark, special.chi_square_tail(*columns(float("nan"), 3))) is None
