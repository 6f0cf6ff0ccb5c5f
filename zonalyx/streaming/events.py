"""The event aggregates as streaming queries; each works on a batch table too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def _late(events: DataFrame, ts: str, delay: str) -> DataFrame:
    return events.withWatermark(ts, delay) if events.isStreaming else events


def daily_counts(events: DataFrame, ts: str, kind: str, value: str, delay: str = "2 days") -> DataFrame:
    """day, kind, n, total: tumbling days; rows later than delay are left out of a stream."""
    g = _late(events, ts, delay).groupBy(F.window(ts, "1 day").alias("w"), kind)
    return g.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), kind, "n", "total")


def monthly_counts(events: DataFrame, ts: str, kind: str) -> DataFrame:
    """month, kind, n: calendar months, which no window has."""
    return events.groupBy(F.date_format(ts, "yyyy-MM").alias("month"), kind).agg(F.count(F.lit(1)).alias("n"))


def sliding_counts(events: DataFrame, ts: str, width: str = "3 days", step: str = "1 day", delay: str = "2 days") -> DataFrame:
    g = _late(events, ts, delay).groupBy(F.window(ts, width, step).alias("w"))
    return g.agg(F.count(F.lit(1)).alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("start"), "n")


def sessions(events: DataFrame, ts: str, user: str, gap: str = "4 hours", delay: str = "2 days") -> DataFrame:
    g = _late(events, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), user)
    return g.agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("start"), "n")
