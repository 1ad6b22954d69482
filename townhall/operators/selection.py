"""Ranks, top-k, first matches and fallbacks, each under a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.semantics import flag


def rank_first(df: DataFrame, keys: list[str], value: str, tie: list, out: str = "rank") -> DataFrame:
    """Rank from the largest, ties by ``tie``; a missing value stays unranked."""
    w = Window.partitionBy(*keys).orderBy(F.col(value).desc_nulls_last(), *tie)
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.row_number().over(w)))


def top_k(df: DataFrame, order: list, k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def top_k_within(df: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")


def first_match(df: DataFrame, keys: list[str], predicate: Column, order: list) -> DataFrame:
    return top_k_within(df.filter(predicate), keys, order, 1)


def fallback_cascade(df: DataFrame, keys: list[str], predicates: list[Column], otherwise: str = "none") -> DataFrame:
    """Per group, the rows of the first predicate that any of its rows meets; else none or all.

    Flags per group are a partial aggregate joined back, so a large group is not one task's window.
    """
    named = {f"_p{i}": flag(p) for i, p in enumerate(predicates)}
    marked = df.withColumns(named)
    flags = marked.groupBy(*keys).agg(*[F.max(F.col(n)).alias(f"{n}_any") for n in named])
    both = marked.alias("m").join(flags.alias("f"), [F.col(f"m.{k}").eqNullSafe(F.col(f"f.{k}")) for k in keys])
    keep: Column = F.lit(otherwise == "all")
    for n in reversed(named):
        keep = F.when(F.col(f"f.{n}_any"), F.col(f"m.{n}")).otherwise(keep)
    return both.filter(keep).select(*[F.col(f"m.{c}") for c in df.columns])


def deepest(items: Column, amount: str, name: str, least: float = 0.01) -> Column:
    """The name of the struct with the largest amount above ``least``; the first one on ties."""
    placed = F.transform(items, lambda x, i: F.struct(x[amount].alias("v"), (-i).alias("i"), x[name].alias("n")))
    best = F.array_max(placed)
    return F.when(best["v"] > least, best["n"])


def extremes(pairs: DataFrame, a: str, b: str, value: str) -> DataFrame:
    """For each ``a``: nearest and farthest other ``b`` (ties to the smaller b)."""
    up = Window.partitionBy(a).orderBy(F.col(value).desc(), b)
    down = Window.partitionBy(a).orderBy(F.col(value), b)
    ranked = pairs.filter(F.col(a) != F.col(b)).withColumns({"_u": F.row_number().over(up), "_d": F.row_number().over(down)})
    pick = lambda r, c: F.max(F.when(F.col(r) == 1, F.col(c)))
    return ranked.groupBy(a).agg(pick("_u", b).alias("nearest"), pick("_u", value).alias("nearest_value"), pick("_d", b).alias("farthest"), pick("_d", value).alias("farthest_value"))
