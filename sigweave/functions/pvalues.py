"""p-values of aggregated rows: binomial and Fisher tails as native expressions, normal and
Student tails as Arrow UDFs. None runs on the scoring path."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def normal_upper(z: float) -> float:
    """P(Z >= z)."""
    return 0.5 * math.erfc(z / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function, evaluated from the front."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 1_000_000):  # takes about the square root of a + b rounds
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1.0 + num * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + num / c
            c = c if abs(c) > tiny else tiny
            value *= d * c
        if abs(d * c - 1.0) < 1e-15:
            return value
    raise ArithmeticError(f"the incomplete beta function did not converge for a={a}, b={b}, x={x}")


def _stirling_rest(x: float) -> float:
    """lgamma(x) less its leading Stirling terms (x - 1/2) ln x - x + ln(2 pi) / 2."""
    if x < 15.0:
        return math.lgamma(x) - ((x - 0.5) * math.log(x) - x + 0.5 * math.log(2 * math.pi))
    r = 1.0 / (x * x)
    return (1.0 / 12 - r * (1.0 / 360 - r * (1.0 / 1260 - r / 1680))) / x


def _log1p_rest(u: float) -> float:
    """log(1 + u) - u, without cancellation near 0."""
    if abs(u) > 0.1:
        return math.log1p(u) - u
    return -sum((-u) ** k / k for k in range(2, 20))


def _beta_front(a: float, b: float, x: float, y: float) -> float:
    """x^a y^b / B(a, b) with y = 1 - x, from differences of size one and not of size a log a.

    Both logarithms are taken at their distance from the mean a / (a + b).
    """
    shift = a * y - b * x
    power = a * _log1p_rest(-shift / a) + b * _log1p_rest(shift / b)
    rest = _stirling_rest(a + b) - _stirling_rest(a) - _stirling_rest(b)
    return math.sqrt(a / (a + b) * b / (2 * math.pi)) * math.exp(power + rest)


def beta_regularized(a: float, b: float, x: float, y: float | None = None) -> float:
    """I_x(a, b); ``y`` is 1 - x where the caller knows it more exactly."""
    y = 1.0 - x if y is None else y
    if x <= 0.0:
        return 0.0
    if y <= 0.0:
        return 1.0
    front = _beta_front(a, b, x, y)
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, y) / b


def student_two_sided(t: float, df: float) -> float:
    return beta_regularized(df / 2.0, 0.5, df / (df + t * t), t * t / (df + t * t))


def binomial_upper(k: int, n: int, p: float) -> float:
    """P(X >= k) for X ~ Bin(n, p)."""
    return 1.0 if k <= 0 else beta_regularized(k, n - k + 1, p)


def fisher_two_sided(a: int, b: int, c: int, d: int) -> float:
    """Sum of the hypergeometric probabilities not above that of the observed table.

    Terms further than 60 standard deviations and 60 counts from both the mode and the table
    are left out: they lie below 1e-300 of the largest one.
    """
    row, col, n = a + b, a + c, a + b + c + d
    lo, hi = max(0, row + col - n), min(row, col)
    mode = int((row + 1) * (col + 1) / (n + 2)) if n else 0
    sd = math.sqrt(max(row * col / max(n, 1) * (1 - row / max(n, 1)), 1.0))
    reach = int(60 * sd) + 60
    ks = np.arange(max(lo, min(mode, a) - reach), min(hi, max(mode, a) + reach) + 1, dtype=float)
    lg = np.vectorize(math.lgamma, otypes=[float])
    logp = -(lg(ks + 1) + lg(row - ks + 1) + lg(col - ks + 1) + lg(n - row - col + ks + 1))
    p = np.exp(logp - logp.max())
    p /= p.sum()
    here = p[np.searchsorted(ks, a)]
    return float(min(1.0, p[p <= here * (1 + 1e-7)].sum()))


def _series(fn, *args) -> pd.Series:
    ok = ~np.logical_or.reduce([pd.isna(a) for a in args])
    return pd.Series([fn(*v) if good else None for good, v in zip(ok, zip(*args))], dtype="float64")


@F.pandas_udf(DoubleType())
def normal_upper_p(z: pd.Series) -> pd.Series:
    return _series(normal_upper, z)


@F.pandas_udf(DoubleType())
def student_two_sided_p(t: pd.Series, df: pd.Series) -> pd.Series:
    return _series(student_two_sided, t, df)


# Exact tails as native expressions: probabilities from saddle-point terms, sums by the ratio of
# neighbouring terms, outwards from the largest one until what is left is below 1e-15 of the sum.

#: Standard deviations, and counts on top, after which the remaining terms are left out.
REACH_SD, REACH = 12.0, 40


def _stirling_error(x: Column) -> Column:
    """ln x! less sqrt(2 pi x) (x / e)^x in logarithms, for whole x >= 0."""
    known = F.array(*[F.lit(_stirling_rest(float(i)) if i else 0.0) for i in range(16)])
    small = F.get(known, F.least(x, F.lit(15)).cast("int"))
    r = 1.0 / (x * x)
    series = (1.0 / 12 - r * (1.0 / 360 - r * (1.0 / 1260 - r / 1680))) / x
    # ln x! = ln gamma(x) + ln x: both sides of the Stirling form move by ln x, so the rests agree.
    return F.when(x <= 15, small).otherwise(series)


def _deviance(x: Column, mean: Column) -> Column:
    """x ln(x / mean) + mean - x; ``mean`` itself at x = 0."""
    d = (mean - x) / F.when(x > 0, x)
    return F.when(x > 0, x * (d - F.log1p(d))).otherwise(mean)


def _binomial_term(k: Column, n: Column, p: Column) -> Column:
    """P(X = k), 0 < p < 1 and 0 <= k <= n."""
    rest = n - k
    inner = F.exp(_stirling_error(n) - _stirling_error(k) - _stirling_error(rest) - _deviance(k, n * p) - _deviance(rest, n * (1.0 - p)))
    scaled = inner * F.sqrt(n / (2.0 * math.pi * F.when((k > 0) & (rest > 0), k * rest)))
    return F.when(k == 0, F.exp(n * F.log1p(-p))).when(rest == 0, F.exp(n * F.log(p))).otherwise(scaled)


def _ratio_sum(steps: Column, ratio: Callable[[Column], Column]) -> Column:
    """1 + r(1) + r(1) r(2) + ... over ``steps`` terms."""
    start = F.struct(F.lit(1.0).alias("t"), F.lit(1.0).alias("s"))

    def add(acc: Column, i: Column) -> Column:
        t = acc["t"] * ratio(i)
        return F.struct(t.alias("t"), (acc["s"] + t).alias("s"))

    terms = F.when(steps > 0, F.sequence(F.lit(1).cast("long"), steps)).otherwise(F.array().cast("array<long>"))
    return F.aggregate(terms, start, add, lambda acc: acc["s"])


def binomial_upper_p(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) for X ~ Bin(n, p), 0 < p < 1; NULL where an argument is."""
    x, m = k.cast("double"), n.cast("double")
    reach = F.ceil(REACH_SD * F.sqrt(m * p * (1.0 - p)) + REACH)
    up = _binomial_term(x, m, p) * _ratio_sum(F.least(m - x, reach).cast("long"), lambda i: (m - x - i + 1) / (x + i) * p / (1.0 - p))
    y = x - 1.0
    down = _binomial_term(y, m, p) * _ratio_sum(F.least(y, reach).cast("long"), lambda i: (y - i + 1) / (m - y + i) * (1.0 - p) / p)
    tail = F.when(x > m * p, up).otherwise(1.0 - down)
    return F.when(k.isNull() | n.isNull() | p.isNull(), None).when(k <= 0, 1.0).when(k > n, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))


def fisher_two_sided_p(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Two-sided p of a 2 x 2 table: the tables with the same margins that are not likelier than this one.

    Terms are taken relative to the likeliest table, outwards on both sides.
    """
    a, b, c, d = [x.cast("double") for x in (a, b, c, d)]
    row, col, n = a + b, a + c, a + b + c + d
    low, high = F.greatest(F.lit(0.0), row + col - n), F.least(row, col)
    mode = F.greatest(low, F.least(high, F.floor((row + 1) * (col + 1) / (n + 2)).cast("double")))
    share = row / F.greatest(n, F.lit(1.0))
    reach = F.ceil(REACH_SD * 5 * F.sqrt(F.greatest(col * share * (1 - share), F.lit(1.0))) + REACH + 20) + F.abs(a - mode)

    def next_term(x: Column) -> Column:
        """Term at x + 1 over the term at x."""
        return (row - x) * (col - x) / ((x + 1) * (n - row - col + x + 1))

    def steps(count: Column) -> Column:
        return F.when(count >= 1, F.sequence(F.lit(1).cast("long"), count.cast("long"))).otherwise(F.array().cast("array<long>"))

    def step(t: Column, i: Column, upwards: bool) -> Column:
        return t * next_term(mode + i - 1.0) if upwards else t / next_term(mode - i)

    one = F.lit(1.0)
    here = F.aggregate(steps(a - mode), F.aggregate(steps(mode - a), one, lambda t, i: step(t, i, False)), lambda t, i: step(t, i, True))
    cut = F.struct((here * (1 + 1e-7)).alias("cut"))

    def side(count: Column, upwards: bool, cut: Column) -> Column:
        """Sum of a side's terms, and of those that are not above ``cut``."""
        def add(acc: Column, i: Column) -> Column:
            t = step(acc["t"], i, upwards)
            return F.struct(t.alias("t"), (acc["s"] + t).alias("s"), (acc["low"] + F.when(t <= cut, t).otherwise(0.0)).alias("low"))

        return F.aggregate(steps(F.least(count, reach)), F.struct(one.alias("t"), F.lit(0.0).alias("s"), F.lit(0.0).alias("low")), add)

    def share_of(c: Column) -> Column:
        sides = F.array(side(high - mode, True, c["cut"]), side(mode - low, False, c["cut"]))
        start = F.struct(one.alias("s"), F.when(c["cut"] >= 1.0, 1.0).otherwise(0.0).alias("low"))
        whole = F.aggregate(sides, start, lambda acc, x: F.struct((acc["s"] + x["s"]).alias("s"), (acc["low"] + x["low"]).alias("low")),
                            lambda acc: acc["low"] / acc["s"])
        return F.least(one, whole)

    missing = a.isNull() | b.isNull() | c.isNull() | d.isNull()
    return F.when(~missing, F.transform(F.array(cut), share_of)[0])  # the cut is worked out once
