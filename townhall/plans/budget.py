"""Scoring of submitted budgets, their validation, and the public tally."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import round_up, row_count
from ..operators.selection import deepest

#: General-fund departments, locked funds and revenue sources in $M.
DEPARTMENTS = {
    "police": 50.2, "genadmin": 38.4, "fire": 29.1, "hhs": 13.0, "it": 10.4, "manager": 9.7, "facilities": 6.9, "finance": 6.9,
    "parksrec": 6.5, "attorney": 5.1, "other": 18.3,
}
LOCKED = {
    "capital": 113.3, "water": 34.0, "openspace": 28.0, "transpo": 27.0, "wastewater": 23.0, "internal": 26.2, "stormwater": 12.0, "parkstax": 11.0,
    "ahf": 11.0, "recact": 10.0, "climate": 9.0, "pds": 8.0, "ssb": 5.0, "ccrs": 3.0, "arts": 2.5, "evict": 2.0, "airport": 1.5,
}
REVENUE = {"fees": 12.3, "property": 39.0, "sales": 80.4}
#: Gaps by year, tolerance of balance, bound of sliders and of reserves.
GAPS, BALANCED, SLIDER, MOST_RESERVES = {2026: 7.5, 2027: 6.5}, 0.05, 25, 1000


def _sum(terms: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, terms)


def _pct(column: str, amount: float) -> Column:
    return F.coalesce(F.col(column).cast("double"), F.lit(0.0)) / 100 * amount


def scored(df: DataFrame) -> DataFrame:
    """Submissions with net spending, cuts, revenue, what remains of both gaps, and the top cut."""
    spend = _sum([_pct(f"gf_{d}", a) for d, a in DEPARTMENTS.items()])
    revenue = _sum([_pct(f"rev_{r}", a) for r, a in REVENUE.items()])
    trapped = _sum([_pct(f"fund_{f}", a) for f, a in LOCKED.items() if f"fund_{f}" in df.columns] or [F.lit(0.0)])
    reserves = F.coalesce(F.col("reserves").cast("double"), F.lit(0.0))
    out = df.withColumns({"spend_change": spend, "revenue_only": revenue, "trapped_change": trapped})
    out = out.withColumns({"net_cuts": F.greatest(F.lit(0.0), -F.col("spend_change")), "revenue_total": F.col("revenue_only") + reserves})
    out = out.withColumns(
        {
            "remaining_2026": GAPS[2026] + F.col("spend_change") - F.col("revenue_total"),
            "remaining_2027": GAPS[2027] + F.col("spend_change") - F.col("revenue_only"),
            "used_revenue": F.col("revenue_only") > 0.01,
            "used_vote": F.coalesce(F.col("rev_sales") > 0, F.lit(False)) | F.coalesce(F.col("rev_property") > 0, F.lit(False)),
            "used_reserves": reserves > 0,
        }
    )
    cuts = F.array(*[F.struct((-_pct(f"gf_{d}", a)).alias("amount"), F.lit(d).alias("name")) for d, a in DEPARTMENTS.items()])
    fix = F.col("revenue_total") + F.col("net_cuts")
    return out.withColumns(
        {
            "balanced": (F.col("remaining_2026") <= BALANCED) & (F.col("remaining_2027") <= BALANCED),
            "binding_gap": F.greatest("remaining_2026", "remaining_2027"),
            "top_cut": deepest(cuts, "amount", "name"),
            "rev_share": F.when(fix > 0, F.col("revenue_total") / fix).otherwise(0.0),
        }
    )


def stored(df: DataFrame) -> DataFrame:
    """Scored amounts as they are stored: cents, halves rounded up."""
    return df.withColumns({c: round_up(F.col(c), 2) for c in ("spend_change", "revenue_total", "revenue_only")})


def constraints(df: DataFrame, demographics: list[str]) -> dict[str, Column]:
    """The named rules that a row has to meet; a missing value is within every bound."""
    within = lambda c: F.coalesce(F.col(c), F.lit(0)).between(-SLIDER, SLIDER)
    reserves = F.coalesce(F.col("reserves"), F.lit(0))
    short = lambda c, n: F.char_length(F.coalesce(F.col(c), F.lit(""))) <= n
    rules = {
        "gf_in_range": reduce(lambda a, b: a & b, [within(f"gf_{d}") for d in DEPARTMENTS if f"gf_{d}" in df.columns] or [F.lit(True)]),
        "rev_in_range": reduce(lambda a, b: a & b, [within(f"rev_{r}") for r in REVENUE]),
        "reserves_in_range": (reserves >= 0) & (reserves <= MOST_RESERVES),
        "answered": row_count(demographics) >= 1 if demographics else F.lit(True),
    }
    for c, n in (("scenario", 64), ("top_cut", 200), ("raw", 8000)):
        if c in df.columns:
            rules[f"{c}_length"] = short(c, n)
    if "client_version" in df.columns:
        rules["client_version"] = F.coalesce(F.col("client_version").between(0, 1000), F.lit(True))
    return rules


def validated(df: DataFrame, demographics: list[str]) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected); rejected rows name the rules they break."""
    rules = constraints(df, demographics)
    broken = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]), lambda x: x.isNotNull())
    marked = df.withColumn("broken", broken)
    return marked.filter(F.size("broken") == 0).drop("broken"), marked.filter(F.size("broken") > 0)


def stamped(df: DataFrame) -> DataFrame:
    """Server-owned id and time, whatever the client sent."""
    return df.withColumns({"id": F.uuid(), "created_at": F.current_timestamp()})


def public_tally(df: DataFrame) -> DataFrame:
    """One row: n, usedRevenue, usedVote, usedReserves, revShareSum, cutTally (a map).

    Cuts are counted by name before they become a map, so the map's size is the number of names.
    """
    revenue, spend = F.coalesce(F.col("revenue_total"), F.lit(0.0)), F.coalesce(F.col("spend_change"), F.lit(0.0))
    denominator = revenue + F.greatest(F.lit(0.0), -spend)
    share = F.when(denominator > 0, revenue / denominator).otherwise(0.0)
    flags = {"usedRevenue": "used_revenue", "usedVote": "used_vote", "usedReserves": "used_reserves"}
    cuts = df.groupBy("top_cut").agg(F.count("*").alias("n"), *[F.count_if(c).alias(k) for k, c in flags.items()], F.sum(share).alias("revShareSum"))
    total = lambda c, zero: F.coalesce(F.sum(c), F.lit(zero)).alias(c)
    named = F.when(F.col("top_cut").isNotNull(), F.struct("top_cut", F.col("n").alias("c")))
    tally = F.map_from_entries(F.array_sort(F.collect_list(named))).alias("cutTally")
    return cuts.agg(total("n", 0), *[total(k, 0) for k in flags], total("revShareSum", 0.0), tally)


def tally_json(tally: DataFrame) -> DataFrame:
    return tally.select(F.to_json(F.struct("*")).alias("agg"))


def tally_display(tally: DataFrame) -> DataFrame:
    """Percentages for display, 0 for an empty tally, and the most frequent top cut."""
    pct = lambda c: F.coalesce(F.try_divide(F.col(c) * 100.0, F.col("n")), F.lit(0.0)).alias(f"{c}Pct")
    entries = F.transform(F.map_entries("cutTally"), lambda e: F.struct(e["value"].alias("v"), e["key"].alias("k")))
    best = F.try_element_at(F.array_sort(entries, lambda a, b: F.when(a["v"] > b["v"], -1).when(a["v"] < b["v"], 1).when(a["k"] < b["k"], -1).otherwise(1)), F.lit(1))
    return tally.select("n", pct("usedRevenue"), pct("usedVote"), pct("usedReserves"), pct("revShareSum"), best["k"].alias("topCut"))
