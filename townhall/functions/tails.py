"""Tail probabilities by series and continued fractions (no numeric library is needed)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def gamma_upper(a: float, x: float) -> float:
    """The regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    lead = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * lead)
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = h = 1 / b
    for i in range(1, 10_000):
        step = -i * (i - a)
        b += 2
        d = 1 / (step * d + b or tiny)
        c = b + step / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return lead * h


def chi2_tail(statistic: float, dof: int) -> float:
    """P(X >= statistic); 1 for no degrees of freedom."""
    return gamma_upper(dof / 2, statistic / 2) if dof > 0 else 1.0


def erfc_of(z: Column) -> Column:
    """The complementary error function of a column that is not negative: a series below 2, a continued
    fraction from there on."""
    steps = lambda a, b: F.sequence(F.lit(a), F.lit(b))
    term = lambda s, k: s["term"] * 2 * z * z / (2 * k + 1)
    begin = F.struct(z.alias("term"), z.alias("total"))
    grow = lambda s, k: F.struct(term(s, k).alias("term"), (s["total"] + term(s, k)).alias("total"))
    lead = F.exp(-z * z) / math.sqrt(math.pi)
    near = 1 - 2 * lead * F.aggregate(steps(1, 60), begin, grow, lambda s: s["total"])
    far = lead / F.aggregate(steps(60, 1), z, lambda below, k: z + k / 2 / below)
    return F.when(z < 2, near).otherwise(far)


def chi2_tail_of(statistic: Column, dof: Column) -> Column:
    """``chi2_tail`` of columns, by the finite sums that whole degrees of freedom have."""
    y = statistic.cast("double") / 2
    odd = dof % 2 == 1
    half = F.floor(dof / 2).cast("int")
    shift = F.when(odd, F.lit(0.5)).otherwise(F.lit(0.0))
    first = F.exp(-y) * F.when(odd, 2 * F.sqrt(y / math.pi)).otherwise(F.lit(1.0))
    places = F.when(half > 0, F.sequence(F.lit(1), F.greatest(half, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    begin = F.struct(first.alias("term"), F.lit(0.0).alias("total"))
    grow = lambda s, i: F.struct((s["term"] * y / (i + shift)).alias("term"), (s["total"] + s["term"]).alias("total"))
    total = F.aggregate(places, begin, grow, lambda s: s["total"])
    return F.when(dof <= 0, F.lit(1.0)).otherwise(total + F.when(odd, erfc_of(F.sqrt(y))).otherwise(F.lit(0.0)))


def beta_lower(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_lower(b, a, 1 - x)
    lead = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(10_000):
        m = i // 2
        if i == 0:
            step = 1.0
        elif i % 2 == 0:
            step = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            step = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or tiny)
        c = 1 + step / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-15:
            break
    return lead * (f - 1)


def t_two_sided(t: float, dof: float) -> float:
    """P(|T| >= |t|) of Student's distribution."""
    return beta_lower(dof / 2, 0.5, dof / (dof + t * t)) if dof > 0 else float("nan")
