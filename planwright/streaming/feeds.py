"""Streams: the operation log, aggregates kept by signed changes, windows over events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.store import LOG_SCHEMA


def log_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Operations as they are appended to files of a folder."""
    return spark.readStream.schema(LOG_SCHEMA).json(folder)


def signed_changes(before: DataFrame, after: DataFrame, key: list[str], value: str) -> DataFrame:
    """Rows whose keys or value changed, as what goes (-1) and what comes (+1): key..., value, sign."""
    old = before.select(*key, value, F.lit(-1).alias("sign"))
    new = after.select(*key, value, F.lit(1).alias("sign"))
    whole = old.unionByName(new)
    return whole.groupBy(*key, value).agg(F.sum("sign").alias("sign")).filter("sign <> 0").select(*key, F.col(value).alias("value"), "sign")


def maintained(changes: DataFrame, key: list[str]) -> DataFrame:
    """SUM, COUNT and AVG by key from signed changes; on a stream, kept up by each."""
    v = F.col("value") * F.col("sign")
    n = F.sum(F.when(F.col("value").isNotNull(), F.col("sign")).otherwise(0))
    total = F.sum(F.coalesce(v, F.lit(0.0)))
    return changes.groupBy(*key).agg(total.alias("total"), n.alias("n"), F.when(n > 0, total / n).alias("mean"))


def windowed(events: DataFrame, time: str, late: str, size: str, slide: str | None = None, by: list[str] = (), value: str = "value") -> DataFrame:
    """Tumbling or sliding windows with a watermark: start, by..., n, total."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    source = events.withWatermark(time, late) if events.isStreaming else events
    out = source.groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, time: str, late: str, gap: str, by: list[str]) -> DataFrame:
    """Session windows: start, end, by..., n."""
    source = events.withWatermark(time, late) if events.isStreaming else events
    out = source.groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")
