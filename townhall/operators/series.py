"""Annual and other keyed series in long form: alignment, indexing, changes, gaps, cohorts.

A series is a DataFrame of (keys..., order, value). Alignment by label, which is implicit in array
libraries, is an explicit join here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.semantics import flag, safe_div


def align_full(frames: dict[str, DataFrame], key: str | list[str], value: str = "value") -> DataFrame:
    """One column per named series over the union of their keys."""
    keys = [key] if isinstance(key, str) else key
    parts = [df.select(*keys, F.col(value).alias(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.join(b, keys, "full"), parts)


def align_left(df: DataFrame, other: DataFrame, key: str | list[str], value: str, name: str) -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    return df.join(other.select(*keys, F.col(value).alias(name)), keys, "left")


def ratio(a: DataFrame, b: DataFrame, key: str | list[str], value: str = "value", out: str = "ratio") -> DataFrame:
    """a / b over the union of keys; missing where either is, or where b is 0."""
    keys = [key] if isinstance(key, str) else key
    return align_full({"_a": a, "_b": b}, keys, value).select(*keys, safe_div(F.col("_a"), F.col("_b")).alias(out))


def difference(a: DataFrame, b: DataFrame, key: str | list[str], value: str = "value", out: str = "difference") -> DataFrame:
    keys = [key] if isinstance(key, str) else key
    return align_full({"_a": a, "_b": b}, keys, value).select(*keys, (F.col("_a") - F.col("_b")).alias(out))


def _of(keys: list[str]) -> Window:
    return Window.partitionBy(*keys)


def pct_change(df: DataFrame, keys: list[str], order: str, value: str, out: str = "pct_change") -> DataFrame:
    before = F.lag(value).over(_of(keys).orderBy(order))
    return df.withColumn(out, safe_div(F.col(value), before) - 1)


def index_to_base(df: DataFrame, keys: list[str], order: str, value: str, base, scale: float = 100.0, out: str = "indexed") -> DataFrame:
    """value / value at ``base`` * scale; missing where the series lacks its base."""
    at_base = F.max(F.when(F.col(order) == F.lit(base), F.col(value))).over(_of(keys))
    return df.withColumn(out, safe_div(F.col(value), at_base) * scale)


def endpoints(df: DataFrame, keys: list[str], order: str, value: str, first, last) -> DataFrame:
    """keys, start, end, change, growth between two places of each series."""
    at = lambda x: F.max(F.when(F.col(order) == F.lit(x), F.col(value)))
    ends = df.groupBy(*keys).agg(at(first).alias("start"), at(last).alias("end"))
    return ends.withColumn("change", F.col("end") - F.col("start")).withColumn("growth", safe_div(F.col("end"), F.col("start")) - 1)


def latest_minus_first(df: DataFrame, keys: list[str], order: str, value: str, out: str = "gain") -> DataFrame:
    return df.groupBy(*keys).agg((F.max_by(value, order) - F.min_by(value, order)).alias(out))


def valid_ends(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys, and place and value of the first and last observation that is not missing."""
    there = df.filter(F.col(value).isNotNull())
    return there.groupBy(*keys).agg(
        F.min(order).alias("first_at"), F.min_by(value, order).alias("first_value"), F.max(order).alias("last_at"), F.max_by(value, order).alias("last_value")
    )


def complete(df: DataFrame, keys: list[str], domain: DataFrame, fill: dict | None = None) -> DataFrame:
    """Every combination of ``df``'s distinct keys with the rows of ``domain`` (a small dimension)."""
    groups = df.select(*keys).distinct() if keys else None
    full = groups.crossJoin(F.broadcast(domain)) if keys else domain
    out = full.join(df, [*keys, *domain.columns], "left")
    return out.fillna(fill) if fill else out


def years(spark, first: int, last: int, name: str = "year") -> DataFrame:
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias(name))


def fill_gap(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """A single missing place becomes the floor of its neighbours' mean."""
    w = _of(keys).orderBy(order)
    middle = F.floor((F.lag(value).over(w) + F.lead(value).over(w)) / 2).cast(df.schema[value].dataType)
    return df.withColumn(value, F.coalesce(F.col(value), middle))


def median_by_year(df: DataFrame, keys: list[str], date: str, value: str, out: str = "median") -> DataFrame:
    return df.groupBy(*keys, F.year(date).alias("year")).agg(F.median(value).alias(out))


def crossover(df: DataFrame, keys: list[str], order: str, below: Column, out: str = "crossover") -> DataFrame:
    """The first place of each series where ``below`` holds; missing if it never does."""
    return df.groupBy(*keys).agg(F.min(F.when(flag(below), F.col(order))).alias(out))


def cohort_steps(df: DataFrame, keys: list[str], order: str, step: str, value: str, out: str = "change") -> DataFrame:
    """Along each diagonal (order - step), value minus the value one place and one step before."""
    diagonal = df.withColumn("cohort", F.col(order) - F.col(step))
    w = _of([*keys, "cohort"]).orderBy(step)
    before = F.when(F.lag(step).over(w) == F.col(step) - 1, F.lag(value).over(w))
    return diagonal.withColumn(out, F.col(value) - before).filter(F.col(step) > 0)


def adjacent(df: DataFrame, keys: list[str], order: str, columns: list[str]) -> DataFrame:
    """Each row with the next row's columns (suffix _next); the last row of a series goes."""
    w = _of(keys).orderBy(order)
    after = {f"{c}_next": F.lead(c).over(w) for c in [order, *columns]}
    return df.withColumns(after).filter(F.col(f"{order}_next").isNotNull())
