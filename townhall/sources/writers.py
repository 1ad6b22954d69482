"""Sinks: single CSV files, nested JSON, vectors, dictionaries, provenance, one-row tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, order: list | None = None, one_file: bool = True) -> None:
    """A small table as one sorted file, a large one in parts."""
    out = df.orderBy(*order) if order else df
    (out.coalesce(1) if one_file else out).write.mode("overwrite").option("header", True).csv(path)


def write_nested_json(df: DataFrame, path: str, order: str, **fields: Column) -> None:
    """One JSON object: the given fields, and all rows in order under ``items`` (a small table)."""
    rows = F.array_sort(F.collect_list(F.struct(order, *[c for c in df.columns if c != order])))
    df.agg(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()], rows.alias("items"))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_vectors(df: DataFrame, path: str, key: str, vector: str) -> None:
    df.select(key, F.col(vector).cast("array<float>").alias(vector)).write.mode("overwrite").parquet(path)


def provenance(files: DataFrame, rows: DataFrame) -> DataFrame:
    """path, sha256, n_rows, members of every input file, also of those without a row.

    ``n_rows`` counts what was read, before any deduplication.
    """
    counts = rows.groupBy("path").agg(F.count("*").alias("n_rows"), F.array_sort(F.collect_set("member")).alias("members"))
    hashed = files.select("path", F.sha2("content", 256).alias("sha256"))
    return hashed.join(counts, "path", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))


def data_dictionary(df: DataFrame, area: str = "area_name", code: str = "area_code", year: str = "year") -> DataFrame:
    """area, first and last year, codes: what a panel's dictionary says of each area."""
    return df.groupBy(area).agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.array_sort(F.collect_set(code)).alias("codes"))


def dictionary_markdown(summary: DataFrame, area: str = "area_name") -> DataFrame:
    line = F.format_string("| %s | %d-%d | %s |", F.col(area), F.col("first_year"), F.col("last_year"), F.array_join("codes", ", "))
    return summary.select(line.alias("value"))


def headline(values: dict[str, Column], df: DataFrame) -> DataFrame:
    """name, value rows of pinned scalars, each an aggregate over ``df``."""
    pairs = F.array(*[F.struct(F.lit(n).alias("name"), v.cast("double").alias("value")) for n, v in values.items()])
    return df.agg(pairs.alias("_a")).select(F.inline("_a"))


def replace_one_row(df: DataFrame, path: str) -> None:
    df.coalesce(1).write.mode("overwrite").parquet(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)
