"""Long and wide forms, unions, keyed deduplication, column selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def wide_to_long(df: DataFrame, ids: list[str], columns: list[str], name: str = "name", value: str = "value", keep_missing: bool = False) -> DataFrame:
    long = df.unpivot(ids, columns, name, value)
    return long if keep_missing else long.filter(F.col(value).isNotNull())


def long_to_wide(df: DataFrame, keys: list[str], name: str, domain: list, aggregate: Column, fill=None) -> DataFrame:
    """One column for every value of ``domain``, whether it occurs or not."""
    wide = df.groupBy(*keys).pivot(name, domain).agg(aggregate)
    return wide.fillna(fill) if fill is not None else wide


def stack(frames: list[DataFrame]) -> DataFrame:
    """Union by name; columns that a frame lacks are missing there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stack_keyed(frames: dict[str, DataFrame], key: str = "key") -> DataFrame:
    return stack([df.withColumn(key, F.lit(name)) for name, df in frames.items()])


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a stated order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def canonical(df: DataFrame, order: list[str]) -> DataFrame:
    return df.select(*[c for c in order if c in df.columns])


def rename_first_wins(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename by a synonym table (lower case, trimmed); of columns with one new name the first stays."""
    taken, chosen = set(), []
    for c in df.columns:
        new = names.get(c.strip().lower(), c.strip().lower())
        if new not in taken:
            taken.add(new)
            chosen.append(F.col(f"`{c}`").alias(new))
    return df.select(*chosen)


def recode(df: DataFrame, column: str, mapping: dict) -> DataFrame:
    return df.replace(mapping, subset=[column])


def min_max_scaled(df: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*keys)
    lo, hi = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn(out, F.try_divide(F.col(value) - lo, hi - lo))


def clamp(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), c))


def with_separator(df: DataFrame, order: str, label: str, text: str, at: float) -> DataFrame:
    """``df`` with one otherwise empty row that carries ``text`` at place ``at`` of the order."""
    row = df.sparkSession.range(1).select(*[F.lit(at if c == order else text if c == label else None).cast(t).alias(c) for c, t in df.dtypes])
    return df.unionByName(row)


def toggled(chosen: Column, option: str, exclusive: str) -> Column:
    """A multi-select answer after one click: the exclusive option stands alone."""
    others = F.array_remove(F.coalesce(chosen, F.array().cast("array<string>")), exclusive)
    if option == exclusive:
        return F.when(F.array_contains(chosen, exclusive), F.array().cast("array<string>")).otherwise(F.array(F.lit(exclusive)))
    return F.when(F.array_contains(others, option), F.array_remove(others, option)).otherwise(F.array_union(others, F.array(F.lit(option))))


def by_position(a: DataFrame, b: DataFrame, order_a: str, order_b: str) -> DataFrame:
    """Rows of two short lists matched by rank; keyed joins are to be preferred."""
    left = a.withColumn("_n", F.row_number().over(Window.orderBy(order_a)))
    right = b.withColumn("_n", F.row_number().over(Window.orderBy(order_b)))
    return left.join(right, "_n").drop("_n")


def transposed(df: DataFrame, key: str, columns: list[str], domain: list) -> DataFrame:
    """One row for each of ``columns``, one column for each value of ``key`` in ``domain``."""
    return long_to_wide(wide_to_long(df, [key], columns, "name", "value"), ["name"], key, domain, F.first("value"))


def column_sets(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    """Names in both, only in ``a`` and only in ``b``, in their order."""
    return {"both": [c for c in a.columns if c in b.columns], "left": [c for c in a.columns if c not in b.columns], "right": [c for c in b.columns if c not in a.columns]}
