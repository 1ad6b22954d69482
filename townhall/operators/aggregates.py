"""Counts, shares, weights, cross-tabulations and regressions, as partial aggregates throughout."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.semantics import flag, safe_div
from ..functions.tails import t_two_sided


def share_within(df: DataFrame, keys: list[str], value: str, out: str = "share") -> DataFrame:
    return df.withColumn(out, safe_div(F.col(value), F.sum(value).over(Window.partitionBy(*keys))))


def value_counts(df: DataFrame, column: str, least: int = 0) -> DataFrame:
    """column, n, share of non-missing values; cells below ``least`` go, after the shares."""
    counts = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    shared = counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))
    return shared.filter(F.col("n") >= least)


def crosstab(df: DataFrame, row: str, column: str) -> DataFrame:
    """row, column, n, row_share for the combinations that occur."""
    counts = df.filter(F.col(row).isNotNull() & F.col(column).isNotNull()).groupBy(row, column).agg(F.count("*").alias("n"))
    return counts.withColumn("row_share", F.col("n") / F.sum("n").over(Window.partitionBy(row)))


def item_audit(df: DataFrame, items: list[str], literal: str) -> DataFrame:
    """item, n, answered, answered_share, literal_share (of all rows), without reshaping rows."""
    n = F.count(F.lit(1))
    one = lambda c: F.struct(
        F.lit(c).alias("item"), n.alias("n"), F.count(c).alias("answered"), safe_div(F.count(c), n).alias("answered_share"),
        safe_div(F.count_if(flag(F.col(c).cast("string") == literal)), n).alias("literal_share"),
    )
    return df.agg(F.array(*[one(c) for c in items]).alias("_a")).select(F.inline("_a"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Over rows where both are present."""
    both = value.isNotNull() & weight.isNotNull()
    return safe_div(F.sum(F.when(both, value * weight)), F.sum(F.when(both, weight)))


def effective_n(weight: Column) -> Column:
    return safe_div(F.sum(weight) * F.sum(weight), F.sum(weight * weight))


def design_effect(weight: Column) -> Column:
    return safe_div(F.count(weight).cast("double"), effective_n(weight))


def described(df: DataFrame, columns: list[str]) -> DataFrame:
    """column, n, mean, std (sample), min, max."""
    one = lambda c: F.struct(F.lit(c).alias("column"), F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(F.col(c).cast("double")).alias("min"), F.max(F.col(c).cast("double")).alias("max"))
    return df.agg(F.array(*[one(c) for c in columns]).alias("_a")).select(F.inline("_a"))


def bands(value: str, points: tuple[int, ...] = (5, 25, 50, 75, 95)) -> list[Column]:
    """Exact, linearly interpolated percentiles p5, p25, ..., all from one buffer of distinct values."""
    all_of = F.percentile(value, [p / 100 for p in points])
    return [all_of[i].alias(f"p{p}") for i, p in enumerate(points)]


def tally_map(df: DataFrame, key: str, out: str = "tally") -> DataFrame:
    """One row: a map from each non-missing key to its count."""
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"))
    return counts.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(key, "n")))).alias(out))


def linreg(df: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """keys, n, slope, intercept, r of least squares; pairs with a missing end are left out."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*keys).agg(
        F.regr_count(b, a).alias("n"), F.regr_slope(b, a).alias("slope"), F.regr_intercept(b, a).alias("intercept"), F.corr(a, b).alias("r")
    )


def expanding_linreg(df: DataFrame, keys: list[str], order: str, x: str, y: str) -> DataFrame:
    """Slope and intercept over each row and those before it in its series (two points at least)."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    fits = df.withColumns({"points": F.count("*").over(w), "slope": F.regr_slope(b, a).over(w), "intercept": F.regr_intercept(b, a).over(w)})
    return fits.filter("points >= 2")


def forecast(fits: DataFrame, at: Column, out: str = "forecast") -> DataFrame:
    return fits.withColumn(out, F.col("intercept") + F.col("slope") * at)


def linreg_inference(df: DataFrame, x: str, y: str) -> dict[str, float]:
    """slope, intercept, r, standard error and two-sided p of one fit, from six sums."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    n, sxx, syy, sxy, slope, intercept = df.agg(F.regr_count(b, a), F.regr_sxx(b, a), F.regr_syy(b, a), F.regr_sxy(b, a), F.regr_slope(b, a), F.regr_intercept(b, a)).first()
    if not n or n < 3 or not sxx:
        return {"n": n or 0, "slope": slope, "intercept": intercept, "r": None, "stderr": None, "p": None}
    r = sxy / math.sqrt(sxx * syy) if syy else 0.0
    stderr = math.sqrt(max(0.0, (1 - r * r) * syy / sxx / (n - 2)))
    p = t_two_sided(slope / stderr, n - 2) if stderr else 0.0
    return {"n": n, "slope": slope, "intercept": intercept, "r": r, "stderr": stderr, "p": p}


def mean_interval(df: DataFrame, keys: list[str], row: str, value: str, draws: int = 200, level: float = 0.95, seed: int = 42) -> DataFrame:
    """keys, n, mean, low, high: the mean with its percentile interval over Poisson bootstrap draws.

    A row's weight in a draw follows from a hash of its ``row`` number, so draws need no order and agree
    on any partitioning. Only sums by (keys, draw) are shuffled.
    """
    known = df.filter(F.col(value).isNotNull())
    u = F.conv(F.substring(F.md5(F.concat_ws("/", F.lit(seed), F.col("draw"), F.col(row).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    below, term, weight = math.exp(-1), math.exp(-1), F.lit(0)
    for k in range(1, 12):  # a Poisson count of mean 1, by its distribution function
        weight = F.when(u >= below, F.lit(k)).otherwise(weight)
        term /= k
        below += term
    drawn = known.withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).withColumn("w", weight)
    means = drawn.groupBy(*keys, "draw").agg((F.sum(F.col(value) * F.col("w")) / F.nullif(F.sum("w"), F.lit(0))).alias("m"))
    ends = F.percentile("m", [(1 - level) / 2, (1 + level) / 2])
    spread = means.groupBy(*keys).agg(ends[0].alias("low"), ends[1].alias("high"))
    return known.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).join(spread, keys)
