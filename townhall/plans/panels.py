"""Occupational wage panels from archives whose layout changes by year, and quarterly slices."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.reshape import canonical, keep_first, stack
from ..operators.selection import fallback_cascade
from ..sources.readers import with_header, year_in_name, zip_rows

#: Column names of the panel in order, and the headers that stand for each;
#: of a header under two names the later one holds.
SYNONYMS = {
    "area_code": ["area", "area_code", "msa_code", "pmsa_code", "cbsa_code", "state_code", "naics_code"],
    "area_name": ["area_name", "area_title", "area_titl", "msa", "pmsa", "cbsa", "state_name"],
    "prim_state": ["prim_state", "state", "st"],
    "occ_code": ["occ_code", "soc", "oes_code", "occ"],
    "occ_title": ["occ_title", "occ_titl", "occupation", "occupation_title", "oes_title"],
    "occ_group": ["occ_group", "o_group", "group"],
    "tot_emp": ["tot_emp", "emp", "employment"],
    "emp_prse": ["emp_prse"],
    "h_mean": ["h_mean", "hrly_mean"],
    "a_mean": ["a_mean", "annl_mean"],
    "mean_prse": ["mean_prse"],
    "h_median": ["h_median", "hrly_median"],
    "a_median": ["a_median", "annl_median"],
    "h_pct10": ["h_pct10", "h_wpct10"],
    "h_pct25": ["h_pct25", "h_wpct25"],
    "h_pct75": ["h_pct75", "h_wpct75"],
    "h_pct90": ["h_pct90", "h_wpct90"],
    "a_pct10": ["a_pct10", "a_wpct10"],
    "a_pct25": ["a_pct25", "a_wpct25"],
    "a_pct75": ["a_pct75", "a_wpct75"],
    "a_pct90": ["a_pct90", "a_wpct90"],
    "jobs_1000": ["jobs_1000"],
    "loc_quotient": ["loc_quotient", "loc quotient", "loc_q"],
    "annual": ["annual"],
    "hourly": ["hourly"],
}
ORDER = ["year", *SYNONYMS]
#: Headers that mark a table, and the names and codes of the whole country.
OCCUPATION = ["occ_code", "occ_title", "occ_titl"]
NATIONAL_NAME = r"(?i)^\s*(u\.?\s?s\.?|united states|u\.?s\.? total|national|all u\.?s\.?)\s*$"
NATIONAL_CODES = ["99", "0000000", "00000", "N0000000", "099", "1"]


@dataclass(frozen=True)
class Scope:
    """Which rows of each table belong to a panel: predicates tried in turn, then none or all."""

    predicates: tuple[Column, ...]
    otherwise: str = "none"
    area_name: str | None = None
    label: str | None = None


def metro(name: str, codes: list[str]) -> Scope:
    return Scope((F.col("area_name").rlike(f"(?i){name}"), F.trim("area_code").isin(codes)), label=name)


def state(name: str, abbreviation: str, fips: list[str]) -> Scope:
    return Scope((F.trim("area_name").rlike(f"(?i)^{name}$"), F.upper(F.trim("prim_state")) == abbreviation, F.trim("area_code").isin(fips)), label=name)


def national(label: str = "U.S.") -> Scope:
    return Scope((F.trim("area_name").rlike(NATIONAL_NAME), F.trim("area_code").isin(NATIONAL_CODES)), "all", label)


def normalised(rows: DataFrame) -> DataFrame:
    """``fields`` as the panel's columns: the first present header of each name's synonyms."""
    pick = lambda names: F.coalesce(*[F.try_element_at(F.col("fields"), F.lit(n)) for n in names])
    return rows.select("path", "member", "row", *[pick(names).alias(c) for c, names in SYNONYMS.items()])


def wage_panel(files: DataFrame, scope: Scope) -> tuple[DataFrame, DataFrame]:
    """(panel, errors) from ``binaryFile`` rows of archives.

    Tables are filtered one by one (inner file by inner file), stacked, reduced to the first row of
    each year and occupation in file order, and sorted by year, occupation and file order.
    """
    rows = zip_rows(files)
    tables = normalised(with_header(rows.filter("error IS NULL"), OCCUPATION))
    kept = fallback_cascade(tables, ["path", "member"], list(scope.predicates), scope.otherwise)
    dated = kept.withColumn("year", year_in_name(F.element_at(F.split("path", "/"), -1)))
    if scope.area_name:
        dated = dated.withColumn("area_name", F.lit(scope.area_name))
    elif scope.label:  # only where no row of the panel has a name
        blank = dated.agg((F.count(F.nullif(F.trim("area_name"), F.lit(""))) == 0).alias("blank"))
        dated = dated.crossJoin(F.broadcast(blank)).withColumn("area_name", F.when(F.col("blank"), F.lit(scope.label)).otherwise(F.col("area_name"))).drop("blank")
    place = ["path", "member", "row"]
    panel = keep_first(dated.filter(F.col("occ_code").isNotNull()), ["year", "occ_code"], place).orderBy("year", "occ_code", *place)
    return canonical(panel, ORDER), rows.filter("error IS NOT NULL").select("path", "member", "error")


def quarterly(frames: list[DataFrame], numeric: list[str], keys: list[str]) -> DataFrame:
    """Stacked all-text slices without repeated rows, numbers cast where they are numbers, sorted by
    year and quarter as numbers and by codes as text."""
    whole = stack(frames).distinct()
    cast = whole.withColumns({c: F.col(c).try_cast("double") for c in numeric})
    order = [F.col(k).try_cast("int") if k in ("year", "qtr") else F.col(k) for k in keys]
    return cast.orderBy(*order)
