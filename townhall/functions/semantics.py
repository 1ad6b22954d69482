"""Null, rounding and division rules, as plain column expressions so that pushdown and code
generation stay available.

Missing values are NULL everywhere; NaN is turned into NULL at ingestion, because Spark orders NaN
above every number and finds it equal to itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def differs(c: Column, value) -> Column:
    """``c != value`` where a missing ``c`` differs from every value."""
    return ~c.eqNullSafe(F.lit(value))


def flag(predicate: Column) -> Column:
    """A predicate that is false, not unknown, where its operands are missing."""
    return F.coalesce(predicate, F.lit(False))


def safe_div(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def total(c: Column) -> Column:
    """A sum that is 0 over nothing but missing values."""
    return F.coalesce(F.sum(c), F.lit(0))


def row_sum(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in columns])


def row_count(columns: list[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])


def row_mean(columns: list[str]) -> Column:
    return safe_div(row_sum(columns), row_count(columns))


def any_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, [flag(p) for p in predicates])


def all_of(predicates: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, [flag(p) for p in predicates])


def round_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def round_exact(c: Column, digits: int = 2) -> Column:
    """Halves to even, where a half is one only if the stored binary value is exactly that.

    5.215 is stored a little below and rounds to 5.21, as Python rounds; decimal rounding sees the
    shortest decimal and gives 5.22. The product's rounding error is recovered by splitting the
    number into two halves of 26 bits.
    """
    scale = 10.0**digits
    high = c * 134217729.0 - (c * 134217729.0 - c)
    product = c * scale
    error = (high * scale - product) + (c - high) * scale
    low = F.floor(product)
    over = (product - low - 0.5) + error
    up = F.when(over > 0, 1).when(over < 0, 0).otherwise(low % 2)
    return (low + up) / scale


def round_up(c: Column, digits: int = 0) -> Column:
    """Halves toward plus infinity, as JavaScript rounds."""
    scale = 10.0**digits
    return F.floor(c * scale + 0.5) / scale


def number(c: Column) -> Column:
    """A number from text, NULL for suppression codes and other non-numbers."""
    return F.trim(c).try_cast("double")


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = [c for c, t in df.dtypes if t in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in floats})


def expect(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """One row per named check with the number of rows that fail it (unknown counts as failing)."""
    counts = df.agg(*[F.count_if(~flag(p)).alias(n) for n, p in checks.items()])
    pairs = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("failures")) for n in checks])
    return counts.select(F.inline(pairs))


def truncation_suspect(n: int, limits: tuple[int, ...] = (1000, 10000, 50000)) -> bool:
    """Whether a row count looks like a paging limit or a power of two rather than an end."""
    return n in limits or (n >= 256 and n & (n - 1) == 0)
