"""Event streams: windows with a watermark, sessions, the latest event, and a cache whose entries expire."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import path_of

def tumbling(events: DataFrame, width: str, late: str = "10 minutes", ts: str = "ts", slide: str | None = None) -> DataFrame:
    """(start, event_type, n, total) by windows of event time; on a stream, events later than ``late`` are dropped."""
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    return timed.groupBy(F.window(ts, width, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, key: str, gap: str, late: str = "10 minutes", ts: str = "ts") -> DataFrame:
    timed = events.withWatermark(ts, late) if events.isStreaming else events
    return timed.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest(events: DataFrame, key: str, ts: str = "ts", tie: str = "event_id") -> DataFrame:
    """The latest event of each key; ties by ``tie``."""
    rest = [c for c in events.columns if c not in (key, ts, tie)]
    return events.groupBy(key).agg(F.max(F.struct(ts, tie, *rest)).alias("e")).select(key, *[F.col(f"e.{c}").alias(c) for c in (ts, tie, *rest)])


def live_entries(cache: DataFrame, now: str, ttl_seconds: int) -> DataFrame:
    """The newest entry of each key and version that hasn't expired; a negative time to live never ends."""
    newest = cache.groupBy("key", "version").agg(F.max(F.struct("created_at", "value")).alias("e")).select("key", "version", "e.*")
    if ttl_seconds < 0:
        return newest
    return newest.filter(F.unix_timestamp(F.to_timestamp(F.lit(now))) - F.unix_timestamp("created_at") <= ttl_seconds)


def read_stream(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """Parquet files as a stream: those of a folder, or one file."""
    reader = spark.readStream.schema(like.schema)
    fs, p = path_of(spark, path)
    if fs.exists(p) and fs.getFileStatus(p).isFile():
        return reader.option("pathGlobFilter", p.getName()).parquet(p.getParent().toString())
    return reader.parquet(path)
