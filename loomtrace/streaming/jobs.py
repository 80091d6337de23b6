"""Streaming forms: what isn't known yet is processed once, the latest document wins, sessions are timed."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from loomtrace.sources.memo import Memo


def process_once(stream: DataFrame, memo: Memo, kind: str, fetch: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Fetch values for keys of stream(key) that the memo lacks. A batch that runs again finds them there."""

    def batch(rows: DataFrame, number: int) -> None:
        requests = rows.select("key").distinct().withColumn("ord", F.lit(0))
        memo.get(requests, kind, fetch, version=number)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def upsert_stream(stream: DataFrame, memo: Memo, kind: str, checkpoint: str) -> StreamingQuery:
    """Keep the latest value of each key of stream(key, value, version)."""

    def batch(rows: DataFrame, number: int) -> None:
        one = rows.groupBy("key").agg(F.max_by("value", "version").alias("value"), F.max("version").alias("v"))
        one.select(F.lit(kind).alias("type"), "key", "value", F.col("v").alias("version")).write.mode("append").parquet(memo.path)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def sessions(events: DataFrame, gap: str = "30 minutes", late: str | None = None) -> DataFrame:
    """(user_id, session start and end, events, seconds) of events(user_id, ts); streams need a watermark."""
    if late:
        events = events.withWatermark("ts", late)
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return out.select("user_id", "first_ts", "last_ts", "events", F.expr("timestampdiff(SECOND, first_ts, last_ts)").alias("seconds"))
