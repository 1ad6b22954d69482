"""Vote shares over time and linear forecasts of the final count."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggregates import expanding_linreg, forecast, linreg, share_within
from ..operators.reshape import wide_to_long

#: Fixed value: the number of ballots that forecasts are made for.
BALLOTS = 34_500


def counts_to_long(wide: DataFrame, name: str, pattern: str = "M/d/yy H:mm") -> DataFrame:
    """name, ts, votes from a table whose columns are named by time."""
    long = wide_to_long(wide, [name], [c for c in wide.columns if c != name], "ts", "votes")
    return long.withColumn("ts", F.to_timestamp("ts", pattern))


def shares(votes: DataFrame, name: str, ballots: DataFrame) -> DataFrame:
    """name, ts, share, ballots: shares within each count, joined with the ballots counted by then."""
    return share_within(votes, ["ts"], "votes").join(ballots, "ts").select(name, "ts", "votes", "share", "ballots")


def final_forecast(shared: DataFrame, name: str, at: int = BALLOTS) -> DataFrame:
    """name, forecast, final, error: least squares of share on ballots against the last count."""
    fits = forecast(linreg(shared, [name], "ballots", "share"), F.lit(at))
    final = shared.groupBy(name).agg(F.max_by("share", "ts").alias("final"))
    return fits.join(final, name).select(name, "slope", "intercept", "forecast", "final", (F.col("final") - F.col("forecast")).alias("error"))


def forecast_quality(forecasts: DataFrame) -> DataFrame:
    return forecasts.agg(F.avg(F.abs("error")).alias("mean_abs_error"), F.max(F.abs("error")).alias("max_abs_error"))


def reference_cumulative_error(shared: DataFrame, name: str, at: int = BALLOTS, most: int = 6) -> DataFrame:
    """At each count from the second: the whole series' fitted value minus what the counts so far
    forecast for ``at`` ballots (two different places on the line, as published)."""
    full = linreg(shared, [name], "ballots", "share").select(name, F.col("slope").alias("_s"), F.col("intercept").alias("_i"))
    steps = expanding_linreg(shared, [name], "ts", "ballots", "share").filter(F.col("points") <= most)
    both = forecast(steps, F.lit(at)).join(full, name)
    return both.select(name, "ts", "points", (F.col("_i") + F.col("_s") * F.col("ballots") - F.col("forecast")).alias("error"))
