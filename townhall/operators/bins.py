"""Half-open bins and range dimensions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Birth years of generations (both ends included).
GENERATIONS = [
    ("Greatest", 1901, 1927), ("Silent", 1928, 1945), ("Boomer", 1946, 1964), ("GenX", 1965, 1980), ("Millennial", 1981, 1996),
    ("GenZ", 1997, 2012), ("Alpha", 2013, 2024), ("Beta", 2025, 2040), ("Gamma", 2041, 2050),
]
#: Edges of age bins, in populations and among voters.
POPULATION_AGES = [0, 25, 35, 45, 55, 65, 101]
VOTER_AGES = [18, 25, 35, 45, 55, 65, 110]


def labels(edges: list) -> list[str]:
    return [f"{a}-{b - 1}" for a, b in zip(edges, edges[1:])]


def cut(c: Column, edges: list, names: list[str] | None = None) -> Column:
    """The label of the bin [a, b) that holds ``c``; missing outside all bins."""
    out: Column | None = None
    for name, a, b in zip(names or labels(edges), edges, edges[1:]):
        inside = (c >= a) & (c < b)
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def dimension(spark: SparkSession, rows: list[tuple], name: str = "label") -> DataFrame:
    """(ord, label, lo, hi) rows as a small dimension."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"ord int, {name} string, lo int, hi int")


def range_join(df: DataFrame, c: Column, dim: DataFrame, how: str = "left") -> DataFrame:
    """``df`` with the dimension's row whose [lo, hi] holds ``c``; dim is a literal table."""
    return df.join(F.broadcast(dim), c.between(F.col("lo"), F.col("hi")), how)


def histogram(df: DataFrame, value: str, bins: int = 20) -> DataFrame:
    """bin (0-based), lo, hi, n over the value's own range; the last bin is closed."""
    ends = df.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    with_ends = df.crossJoin(F.broadcast(ends))
    width = (F.col("_hi") - F.col("_lo")) / bins
    place = F.when(F.col("_hi") == F.col("_lo"), 0).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(value) - F.col("_lo")) / width))).cast("int")
    counted = with_ends.filter(F.col(value).isNotNull()).groupBy(place.alias("bin"), "_lo", "_hi").agg(F.count("*").alias("n"))
    return counted.select("bin", (F.col("_lo") + F.col("bin") * width).alias("lo"), (F.col("_lo") + (F.col("bin") + 1) * width).alias("hi"), "n")
