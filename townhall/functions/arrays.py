"""Dense vectors as arrays: products, norms, pooling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """The vector at length 1; NULL for the zero vector."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x.cast("double") / norm(a)))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def pooled(df: DataFrame, key: str, vector: str, weight: Column | None = None, out: str = "pooled") -> DataFrame:
    """The (weighted) mean vector of each group at length 1.

    Element sums are partial aggregates by (group, place): no group's vectors meet in one task.
    """
    w = F.lit(1.0) if weight is None else weight.cast("double")
    flat = df.select(key, w.alias("_w"), F.posexplode(vector).alias("_i", "_x"))
    means = flat.groupBy(key, "_i").agg(F.try_divide(F.sum(F.col("_x").cast("double") * F.col("_w")), F.sum("_w")).alias("_m"))
    ordered = means.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_m"))), lambda s: s["_m"]).alias("_v"))
    return ordered.select(key, normalised(F.col("_v")).alias(out))


def first_vector(df: DataFrame, key: str, order: str, vector: str, out: str = "pooled") -> DataFrame:
    return df.groupBy(key).agg(F.min_by(vector, order).alias(out)).select(key, normalised(F.col(out)).alias(out))
