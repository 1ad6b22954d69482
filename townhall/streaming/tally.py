"""A submission log and its public tally, kept up by a stream.

The stream appends accepted rows to a log and then replaces the one-row tally from the whole log.
All terms are counts and sums, so recomputing and adding give the same; recomputing also covers
deletions and edits, which a stream cannot say, and makes a repeated batch harmless: a batch's rows
carry its id and replace those of an earlier try.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..plans.budget import public_tally, stamped, validated


def read_submissions(spark: SparkSession, path: str, schema: str, form: str = "json") -> DataFrame:
    return spark.readStream.format(form).schema(schema).load(path)


def refresh(spark: SparkSession, log: str, tally: str) -> None:
    """The tally from the whole log, in place of the one before."""
    public_tally(spark.read.parquet(log)).coalesce(1).write.mode("overwrite").parquet(tally)


def keep_tally(stream: DataFrame, demographics: list[str], log: str, tally: str, checkpoint: str, rejected: str | None = None) -> StreamingQuery:
    """Run over all that is there and stop: accepted rows to ``log``, the aggregate to ``tally``."""

    def batch(rows: DataFrame, number: int) -> None:
        good, bad = validated(rows, demographics)
        at = F.lit(number).alias("batch")
        session = rows.sparkSession
        session.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
        stamped(good).select("*", at).write.mode("overwrite").partitionBy("batch").parquet(log)
        if rejected:
            bad.select("*", at).write.mode("overwrite").partitionBy("batch").parquet(rejected)
        refresh(session, log, tally)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def running_tally(stream: DataFrame) -> DataFrame:
    """The counts alone as an incremental aggregate, for complete or update mode."""
    return stream.groupBy().agg(
        F.count("*").alias("n"), F.count_if("used_revenue").alias("usedRevenue"), F.count_if("used_vote").alias("usedVote"), F.count_if("used_reserves").alias("usedReserves")
    )


def first_submissions(stream: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """One row for each key within the watermark."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, width: str, delay: str, *keys: str) -> DataFrame:
    return stream.withWatermark(time, delay).groupBy(F.window(time, width), *keys).agg(F.count("*").alias("n"))
