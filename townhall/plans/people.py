"""Population composition, enrolment forecasts, cohort progression, turnout, sister places."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.semantics import differs, safe_div
from ..operators import bins, series
from ..operators.aggregates import linreg
from ..operators.reshape import long_to_wide, wide_to_long


def generation_mix(people: DataFrame, keys: list[str], birth_year: Column, n: Column) -> DataFrame:
    """keys x generation counts; births before the first generation are in none."""
    dim = bins.dimension(people.sparkSession, bins.GENERATIONS, "generation")
    joined = bins.range_join(people, birth_year, dim, "inner")
    return joined.groupBy(*keys, "ord", "generation").agg(F.sum(n).alias("n"))


def age_mix(people: DataFrame, keys: list[str], age: Column, n: Column, edges: list[int] | None = None) -> DataFrame:
    """One row for each of ``keys``, one column for each age bin, empty bins at 0."""
    edges = edges or bins.POPULATION_AGES
    binned = people.withColumn("_bin", bins.cut(age, edges)).filter(F.col("_bin").isNotNull()).withColumn("_n", n)
    return long_to_wide(binned, keys, "_bin", bins.labels(edges), F.sum("_n"), 0)


def ratio_series(a: DataFrame, b: DataFrame, key: str, value: str = "value") -> DataFrame:
    """Jobs per home, students per resident and the like: full alignment, then division."""
    return series.ratio(a, b, key, value)


def enrolment_forecast(history: DataFrame, projection: DataFrame, x: str, y: str, first: int, last: int) -> DataFrame:
    """year, x, forecast over ``projection`` from least squares on ``history`` between two years."""
    model = linreg(history.filter(F.col("year").between(first, last)), [], x, y).select("slope", "intercept")
    return projection.crossJoin(F.broadcast(model)).select("year", x, (F.col("intercept") + F.col("slope") * F.col(x)).alias("forecast"))


def trough(df: DataFrame, order: str, value: str) -> DataFrame:
    """Where a series is lowest; the earliest on ties."""
    low = df.filter(F.col(value).isNotNull()).agg(F.min(F.struct(value, order)).alias("m"))
    return low.select(F.col(f"m.{order}").alias(order), F.col(f"m.{value}").alias(value))


def cohort_progression(enrolments: DataFrame, grades: list[str], first_year: int | None = None) -> DataFrame:
    """start_year, transition, change: how each entering class changes from grade to grade."""
    long = wide_to_long(enrolments, ["year"], grades, "grade", "n")
    place = F.array_position(F.array(*[F.lit(g) for g in grades]), F.col("grade")).cast("int") - 1
    steps = series.cohort_steps(long.withColumn("step", place), [], "year", "step", "n").filter(F.col("change").isNotNull())
    names = F.array(*[F.lit(f"{a}-{b}") for a, b in zip(grades, grades[1:])])
    out = steps.select(F.col("cohort").alias("start_year"), F.element_at(names, F.col("step")).alias("transition"), "step", "change")
    return out.filter(F.col("start_year") >= first_year) if first_year is not None else out


def turnout(voters: DataFrame, history: DataFrame, elections: list[int], edges: list[int] | None = None) -> DataFrame:
    """age_bin, cycle, turnout: mean over years of votes per registered voter.

    ``voters``: voter_id, birth_year, registered (year); ``history``: voter_id, year, description, kind.
    The universe is voters with a qualifying vote; years before registration are out, votes in them
    included. Every bin is emitted for every year. Votes per voter and year are row counts.
    """
    edges = edges or bins.VOTER_AGES
    spark = voters.sparkSession
    votes = history.filter(differs(F.col("kind"), "Primary")).groupBy("voter_id", "year").agg(F.count("*").alias("voted"))
    calendar = spark.createDataFrame([(y,) for y in elections], "year int")
    universe = votes.select("voter_id").distinct().join(voters, "voter_id")
    grid = universe.crossJoin(F.broadcast(calendar)).filter(F.col("year") >= F.col("registered"))
    cells = grid.join(votes, ["voter_id", "year"], "left").withColumn("age_bin", bins.cut(F.col("year") - F.col("birth_year"), edges))
    grouped = cells.filter(F.col("age_bin").isNotNull()).groupBy("year", "age_bin").agg(F.sum(F.coalesce("voted", F.lit(0))).alias("votes"), F.count_distinct("voter_id").alias("voters"))
    domain = spark.createDataFrame([(b,) for b in bins.labels(edges)], "age_bin string")
    full = calendar.crossJoin(domain).join(grouped, ["year", "age_bin"], "left").fillna(0, ["votes", "voters"])
    rated = full.withColumn("rate", safe_div(F.col("votes"), F.col("voters"))).withColumn("cycle", F.when(F.col("year") % 2 == 0, "Even").otherwise("Odd"))
    return rated.groupBy("age_bin", "cycle").agg(F.avg("rate").alias("turnout"))


def unmatched(history: DataFrame, voters: DataFrame) -> DataFrame:
    """Votes of ids that the register lacks or holds more than once: rejected, not guessed."""
    counts = voters.groupBy("voter_id").agg(F.count("*").alias("n"))
    return history.join(counts, "voter_id", "left").filter(F.coalesce("n", F.lit(0)) != 1).drop("n")


def sister_growth(places: DataFrame, counties: DataFrame, catalogue: DataFrame, first: int, last: int) -> DataFrame:
    """place, place_growth, county_growth, ratio, matched through catalogue keys (place, county)."""
    a = series.endpoints(places, ["place"], "year", "value", first, last).select("place", F.col("growth").alias("place_growth"))
    b = series.endpoints(counties, ["county"], "year", "value", first, last).select("county", F.col("growth").alias("county_growth"))
    both = catalogue.join(a, "place", "left").join(b, "county", "left")
    return both.withColumn("ratio", safe_div(F.col("place_growth"), F.col("county_growth")))


def plan_era(year: Column) -> Column:
    """Eras by strict upper bounds."""
    return F.when(year < 1980, "1970s").when(year < 1990, "1980s").when(year < 2000, "1990s").when(year < 2015, "2000-2014").otherwise("2015+")
