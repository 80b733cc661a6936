"""Model terms: Fourier pairs, powers, interactions and Box-Cox."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Harmonics and periods of the calendar terms.
HOUR_HARMONICS = (1, 2, 3, 4, 5, 6, 8, 9, 10, 11, 12)
WEEKDAY_HARMONICS = (1, 2, 3, 4)
MONTH_HARMONICS = (1, 2, 3, 4, 5, 6)
YEARDAY_HARMONICS = (1, 2, 90, 180, 270)
HOURS, WEEKDAYS, MONTHS, YEARDAYS, MONTHDAYS = 24.0, 7.0, 12.0, 365.25, 30.0


def wave(fn, x: Column, harmonic: float, period: float) -> Column:
    return fn(F.lit(2 * math.pi * harmonic) * x / F.lit(period))


def fourier(col: str, harmonics, period: float, number_by_rank: bool = False) -> dict[str, Column]:
    """``{col}_sin{k}`` and ``{col}_cos{k}`` for each harmonic.

    ``number_by_rank`` names the pairs 1, 2, 3 ... instead of by harmonic.
    """
    out = {}
    for rank, k in enumerate(harmonics, 1):
        n = rank if number_by_rank else k
        out[f"{col}_sin{n}"] = wave(F.sin, F.col(col), k, period)
        out[f"{col}_cos{n}"] = wave(F.cos, F.col(col), k, period)
    return out


def hour_fourier() -> dict[str, Column]:
    return fourier("hour", HOUR_HARMONICS, HOURS)


def weekday_fourier() -> dict[str, Column]:
    return fourier("day_week", WEEKDAY_HARMONICS, WEEKDAYS)


def month_fourier() -> dict[str, Column]:
    return fourier("month", MONTH_HARMONICS, MONTHS)


def yearday_fourier() -> dict[str, Column]:
    return fourier("day_year", YEARDAY_HARMONICS, YEARDAYS, number_by_rank=True)


def monthday_fourier() -> dict[str, Column]:
    return fourier("day_month", (1,), MONTHDAYS)


def shifted_hour(shift: int, half_period: bool = False) -> tuple[Column, Column]:
    """(sin, cos) of the hour moved by ``shift``; ``half_period`` uses pi, not 2 pi."""
    moved = F.pmod(F.col("hour") + shift, F.lit(24))
    k = 0.5 if half_period else 1.0
    return wave(F.sin, moved, k, HOURS), wave(F.cos, moved, k, HOURS)


def half_sine(col: str, period: float) -> Column:
    return wave(F.sin, F.col(col), 0.5, period)


def power(col: str, n: int) -> Column:
    """Small integer power as a product: exact and cheaper than ``pow``."""
    out = F.col(col).cast("double")
    for _ in range(n - 1):
        out = out * F.col(col)
    return out


def powers(col: str, *degrees: int) -> dict[str, Column]:
    return {f"{col}_{n}": power(col, n) for n in degrees}


def product(*cols: str) -> Column:
    out = F.col(cols[0]).cast("double")
    for c in cols[1:]:
        out = out * F.col(c)
    return out


def box_cox(y: Column, lam: Column) -> Column:
    return F.when(F.abs(lam) < 1e-12, F.log(y)).otherwise((F.pow(y, lam) - 1) / lam)


def inverse_box_cox(z: Column, lam: Column) -> Column:
    base = z * lam + 1
    return F.when(F.abs(lam) < 1e-12, F.exp(z)).when(base > 0, F.pow(base, F.lit(1.0) / lam))
