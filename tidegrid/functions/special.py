"""Tails of test statistics as column expressions: incomplete gamma and beta functions.

Continued fractions and series run inside the JVM as ``aggregate`` over a fixed number of terms; a term
that changes nothing any more leaves the value as it is.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TERMS = 400
TINY = 1e-300
# Lanczos' approximation of the gamma function (g = 7, nine terms).
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
           12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x >= 0.5."""
    y = x - 1
    total = F.lit(LANCZOS[0])
    for i, c in enumerate(LANCZOS[1:], 1):
        total = total + F.lit(c) / (y + i)
    t = y + 7.5
    return F.log(F.sqrt(2 * F.pi())) + (y + 0.5) * F.log(t) - t + F.log(total)


def _away(x: Column) -> Column:
    """A divisor that is never zero."""
    return F.when(F.abs(x) < TINY, F.lit(TINY)).otherwise(x)


def _state(c: Column, d: Column, h: Column) -> Column:
    return F.struct(c.cast("double").alias("c"), d.cast("double").alias("d"), h.cast("double").alias("h"))


def _fraction(first_d: Column, term) -> Column:
    """Continued fraction by Lentz' recursion; ``term(k)`` is a list of (numerator, added) pairs of step k."""
    def step(s, k):
        c, d, h = s["c"], s["d"], s["h"]
        for numerator, added in term(k.cast("double")):
            d = 1 / _away(added + numerator * d)
            c = _away(added + numerator / c)
            h = h * c * d
        return _state(c, d, h)

    start = 1 / _away(first_d)
    return step, start


def upper_gamma(a: Column, x: Column) -> Column:
    """Regularised upper incomplete gamma function Q(a, x) for a >= 0.5; 1 at x <= 0."""
    front = F.exp(a * F.log(x) - x - log_gamma(a))
    steps = F.sequence(F.lit(1), F.lit(TERMS))
    series = F.aggregate(steps, F.struct((1 / a).alias("t"), (1 / a).alias("s")),
                         lambda s, k: F.struct((s["t"] * x / (a + k)).alias("t"), (s["s"] + s["t"] * x / (a + k)).alias("s")), lambda s: s["s"])
    first = x + 1 - a
    step, start = _fraction(first, lambda k: [(k * (a - k), x + 2 * k + 1 - a)])
    fraction = F.aggregate(steps, _state(F.lit(1 / TINY), start, start), step, lambda s: s["h"])
    return F.when(x <= 0, F.lit(1.0)).when(x < a + 1, 1 - front * series).otherwise(front * fraction)


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """Regularised incomplete beta function I_x(a, b) for a, b >= 0.5."""
    def side(x, a, b):
        def term(m):
            return [(m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), F.lit(1.0)),
                    (-(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)), F.lit(1.0))]
        step, start = _fraction(1 - (a + b) * x / (a + 1), term)
        value = F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), _state(F.lit(1.0), start, start), step, lambda s: s["h"])
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.log(x) + b * F.log(1 - x))
        return front * value / a

    inner = F.when(x < (a + 1) / (a + b + 2), side(x, a, b)).otherwise(1 - side(1 - x, b, a))
    return F.when(x <= 0, F.lit(0.0)).when(x >= 1, F.lit(1.0)).otherwise(inner)


def chi_square_tail(x: Column, df: Column) -> Column:
    """P(X > x); null for no degree of freedom or an undefined x."""
    return F.when((df >= 1) & ~F.isnan(x), upper_gamma(df / 2.0, x / 2.0))


def t_tail(t: Column, df: Column) -> Column:
    """P(|T| > |t|), both tails; null for no degree of freedom."""
    return F.when(df >= 1, incomplete_beta(df / (df + t * t), df / 2.0, F.lit(0.5)))


def f_tail(f: Column, df1: Column, df2: Column) -> Column:
    """P(F > f); null for no degree of freedom."""
    return F.when((df1 >= 1) & (df2 >= 1), incomplete_beta(df2 / (df2 + df1 * f), df2 / 2.0, df1 / 2.0))
