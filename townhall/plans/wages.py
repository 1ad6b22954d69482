"""Minimum-wage scenarios, affordability, cost burden and Monte Carlo bands."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.semantics import round_exact, safe_div
from ..operators.aggregates import bands
from ..operators.series import index_to_base

#: Year, full wage, tipped wage.
SCHEDULE = [
    (2015, 8.23, 5.21), (2016, 8.31, 5.29), (2017, 9.30, 6.28), (2018, 10.20, 7.18), (2019, 11.10, 8.08), (2020, 12.00, 8.98),
    (2021, 12.32, 9.30), (2022, 12.56, 9.54), (2023, 13.65, 10.63), (2024, 14.42, 11.40), (2025, 16.82, 13.80), (2026, 18.17, 15.15),
]
#: Projected full wages.
PROJECTED = [(2025, 16.82), (2026, 18.17), (2027, 18.81), (2028, 19.47), (2029, 20.15), (2030, 20.86)]
#: Tip offset, its legal share, freeze level and last frozen year, share of option D,
#: growth past the projection, growth of the last increments, hours a year, share of income for rent.
OFFSET, OFFSET_SHARE, FREEZE, FREEZE_UNTIL, SHARE_D = 3.02, 0.25, 13.80, 2029, 0.20
GROWTH, STEP_GROWTH, HOURS, RENT_SHARE = 1.035, 1.025, 2080, 0.30
#: Variants of the freeze: first frozen year, level, whether wages catch up after 2028.
VARIANTS = [("E1a", 2026, 13.80, False), ("E1b", 2026, 13.80, True), ("E2a", 2027, 15.15, False), ("E2b", 2027, 15.15, True)]
#: Mean and coefficient of variation of tips; hours; rent growth.
TIPS = {"low": (4.0, 0.9), "moderate": (10.0, 0.7), "high": (26.2, 0.3)}
HOURS_A_WEEK, RENT_GROWTH, SIMULATIONS = (30.0, 6.0, 15.0, 45.0), (0.035, 0.015, 0.0, 0.10), 8000


def schedule(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(SCHEDULE, "year int, full double, tipped double").withColumns(
        {"offset": F.round(F.col("full") - F.col("tipped"), 2), "annual_full": F.col("full") * HOURS, "annual_tipped": F.col("tipped") * HOURS}
    )


def projected(spark: SparkSession, last: int = 2030) -> DataFrame:
    """year, full: projected wages, grown and rounded year by year past the last given one."""
    rows = list(PROJECTED)
    while rows[-1][0] < last:
        rows.append((rows[-1][0] + 1, round(rows[-1][1] * GROWTH, 2)))
    return spark.createDataFrame(rows, "year int, full double")


def scenarios(wages: DataFrame, base_year: int = 2025) -> DataFrame:
    """option (A-D), year, full, offset, tipped.

    A keeps the offset, B scales it with the wage, C freezes the tipped wage and then keeps the
    offset's share, D takes a fifth; none above a quarter of the full wage. The row of the base year
    and of the last frozen year are joined as one row, not looked up per row.
    """
    at = lambda y: F.max(F.when(F.col("year") == y, F.col("full")))
    ends = wages.agg(at(base_year).alias("_base"), at(FREEZE_UNTIL).alias("_frozen"))
    options = wages.sparkSession.createDataFrame([("A",), ("B",), ("C",), ("D",)], "option string")
    grid = wages.crossJoin(F.broadcast(ends)).crossJoin(F.broadcast(options))
    full = F.col("full")
    offset = (
        F.when(F.col("option") == "A", F.lit(OFFSET)).when(F.col("option") == "B", F.lit(OFFSET) * (full / F.col("_base")))
        .when((F.col("option") == "C") & (F.col("year") <= FREEZE_UNTIL), full - FREEZE)
        .when(F.col("option") == "C", (F.col("_frozen") - FREEZE) * (full / F.col("_frozen"))).otherwise(full * SHARE_D)
    )
    capped = F.least(offset, full * OFFSET_SHARE)
    return grid.select("option", "year", "full", round_exact(capped, 2).alias("offset"), round_exact(full - capped, 2).alias("tipped"))


def freeze_variants(wages: DataFrame) -> DataFrame:
    """variant, year, tipped through 2032: freeze, then resume by option A's steps or catch up.

    Steps past 2030 grow by ``STEP_GROWTH``; resumed wages are a running sum of the steps.
    """
    a = scenarios(wages.filter(F.col("year") <= 2030)).filter("option = 'A'").select("year", F.col("tipped").alias("a"))
    before = F.lag("a").over(Window.orderBy("year"))
    step = a.withColumn("step", round_exact(F.col("a") - before, 2))
    last = step.filter("year = 2030").select(F.col("a").alias("a30"), round_exact(F.col("step") * STEP_GROWTH, 2).alias("s31"))
    last = last.withColumn("s32", round_exact(F.col("s31") * STEP_GROWTH, 2))
    spark = wages.sparkSession
    calendar = spark.range(2025, 2033).select(F.col("id").cast("int").alias("year"))
    variants = spark.createDataFrame(VARIANTS, "variant string, freeze_year int, level double, catch_up boolean")
    grid = calendar.join(F.broadcast(step), "year", "left").crossJoin(F.broadcast(last)).crossJoin(F.broadcast(variants))
    steps = F.when(F.col("year") == 2031, F.col("s31")).when(F.col("year") == 2032, F.col("s32")).otherwise(F.col("step"))
    w = Window.partitionBy("variant").orderBy("year")
    resumed = F.col("level") + F.sum(F.when(F.col("year") >= 2029, steps)).over(w)
    caught = F.coalesce(F.col("a"), F.col("a30") + F.col("s31") * (F.col("year") - 2030))
    tipped = (
        F.when(F.col("year") < F.col("freeze_year"), F.coalesce("a", "level")).when(F.col("year") <= 2028, F.col("level"))
        .when(F.col("catch_up"), caught).otherwise(round_exact(resumed, 2))
    )
    return grid.select("variant", "year", tipped.alias("tipped"))


def wage_to_afford(rent: Column, hours: float = HOURS) -> Column:
    """The hourly wage at which a monthly rent is 30 % of pay."""
    return rent * 12 / RENT_SHARE / hours


def grown_rent(rent: Column, year: Column, since: int = 2023) -> Column:
    return rent * F.pow(F.lit(GROWTH), (year - since).cast("double"))


def affordability(rents: DataFrame, wages: DataFrame) -> DataFrame:
    """year, rent, needed, and the gap to full and tipped wages."""
    both = rents.join(wages, "year", "left").withColumn("needed", wage_to_afford(F.col("rent")))
    return both.withColumns({"gap_full": F.col("needed") - F.col("full"), "gap_tipped": F.col("needed") - F.col("tipped")})


def break_even_hours(today: Column, wage: Column, tips: Column) -> Column:
    """Weekly hours at a new wage that pay what today pays in a year."""
    return safe_div(today, (wage + tips) * 52)


def rebuttal(rows: DataFrame, tips: Column, today: Column) -> DataFrame:
    """``rows`` (label, base, hours) with weekly and annual pay and its change from ``today``."""
    pay = F.when(F.col("base") == 0, F.lit(0.0)).otherwise((F.col("base") + tips) * F.col("hours"))
    return rows.withColumn("weekly", pay).withColumn("annual", F.col("weekly") * 52).withColumn("vs_today", F.col("annual") - today)


def hours_table(rates: DataFrame, hours: list[float]) -> DataFrame:
    """Annual pay for every rate and weekly hours."""
    grid = rates.withColumn("hours", F.explode(F.array(*[F.lit(float(h)) for h in hours])))
    return grid.withColumn("annual", F.col("rate") * F.col("hours") * 52)


def cost_burden(brackets: DataFrame) -> DataFrame:
    """Shares of renters at 30 % of income and more, and at 40 % and more."""
    severe = F.col("b40_50") + F.col("b50_plus")
    burdened = F.col("b30_35") + F.col("b35_40") + severe
    return brackets.withColumns(
        {"cost_burdened": burdened, "severely_burdened": severe, "pct_burdened": safe_div(burdened, F.col("total")), "pct_severely": safe_div(severe, F.col("total"))}
    )


def _uniform(i: Column, stream: int, seed: int) -> Column:
    """A number in (0, 1) from the row's own id: the same on any partitioning and on recomputation."""
    digest = F.md5(F.concat_ws("/", i.cast("string"), F.lit(str(stream)), F.lit(str(seed))))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def normal_draw(i: Column, stream: int, seed: int) -> Column:
    """A standard normal by the polar form of two uniforms."""
    return F.sqrt(-2 * F.log(_uniform(i, 2 * stream, seed))) * F.cos(2 * math.pi * _uniform(i, 2 * stream + 1, seed))


def _truncated(i: Column, stream: int, seed: int, mean: float, sd: float, lo: float, hi: float, tries: int = 12) -> Column:
    """A truncated normal: the first of several draws inside the bounds, else the bound it left by."""
    draws = F.array(*[mean + sd * normal_draw(i, stream + 50 * k, seed) for k in range(tries)])
    inside = F.filter(draws, lambda x: (x >= lo) & (x <= hi))
    return F.coalesce(F.try_element_at(inside, F.lit(1)), F.greatest(F.lit(lo), F.least(F.lit(hi), F.element_at(draws, 1))))


def draws(spark: SparkSession, n: int = SIMULATIONS, seed: int = 42) -> DataFrame:
    """sim, hours, rent_growth and tips of each kind: common random numbers for all scenarios."""
    i = F.col("sim")
    mean, sd, lo, hi = HOURS_A_WEEK
    g_mean, g_sd, g_lo, g_hi = RENT_GROWTH
    growth = F.greatest(F.lit(g_lo), F.least(F.lit(g_hi), g_mean + g_sd * normal_draw(i, 2, seed)))
    tips = {}
    for k, (name, (m, cv)) in enumerate(TIPS.items()):
        var = math.log(1 + cv * cv)
        tips[f"tips_{name}"] = F.exp(math.log(m) - var / 2 + math.sqrt(var) * normal_draw(i, 3 + k, seed))
    return spark.range(n).select(F.col("id").alias("sim")).withColumns({"hours": _truncated(i, 1, seed, mean, sd, lo, hi), "rent_growth": growth, **tips})


def monte_carlo(drawn: DataFrame, wages: DataFrame, rent: float, tips: str = "moderate", points: tuple[int, ...] = (10, 25, 50, 75, 90)) -> DataFrame:
    """scenario, year: percentiles of income and threshold, and the share that cannot afford rent.

    ``wages``: scenario, year, tipped (a small dimension crossed with the draws).
    """
    grid = drawn.crossJoin(F.broadcast(wages))
    income = (F.col("tipped") + F.col(f"tips_{tips}")) * F.col("hours") * 52
    needed = rent * F.pow(1 + F.col("rent_growth"), (F.col("year") - 2023).cast("double")) * 12 / RENT_SHARE
    lived = grid.withColumns({"income": income, "needed": needed})
    cant = F.avg((F.col("income") < F.col("needed")).cast("int")).alias("p_unaffordable")
    return lived.groupBy("scenario", "year").agg(*bands("income", points), F.percentile("needed", 0.5).alias("needed_p50"), cant)


def employment_index(employment: DataFrame, base: int = 2019) -> DataFrame:
    """area, year, value and its index to the base year at 100."""
    return index_to_base(employment, ["area"], "year", "value", base)


def real_wages(wages: DataFrame, parity: DataFrame) -> DataFrame:
    """metro, wage, parity, real: wages at average prices; metros without parity stay, unknown."""
    return wages.join(parity, "metro", "left").withColumn("real", safe_div(F.col("wage"), F.col("parity")) * 100)


def rent_share(wage: Column, rent: Column, hours: float = HOURS) -> Column:
    return safe_div(rent * 12, wage * hours)
