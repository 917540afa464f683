"""Event logs: the same functions serve tables and streams.

A stream needs a watermark on ``ts``; state older than it is dropped, so state stays bounded.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.tables import checkpoint_dir

SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"
GAP, LATE = "30 minutes", "1 hour"


def read_stream(spark: SparkSession, folder: str, pattern: str = "events.parquet", files: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream of events."""
    raw = spark.readStream.schema(SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(events: DataFrame, late: str = LATE) -> DataFrame:
    """Events and their value per hour and type."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    out = seen.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("value"))
    return out.select(F.col("w.start").cast("timestamp_ntz").alias("hour"), "event_type", "events", F.round("value", 4).alias("value"))


def sessions(events: DataFrame, gap: str = GAP, late: str = LATE) -> DataFrame:
    """Runs of a user's events with pauses below the gap."""
    seen = events.withWatermark("ts", late) if events.isStreaming else events
    out = seen.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("events"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return out.select("user_id", F.col("first").cast("timestamp_ntz").alias("first"), F.col("last").cast("timestamp_ntz").alias("last"), "events")


REPEAT_OUT = "event_id long, user_id long, event_type string, repeat boolean"
REPEAT_STATE = "event_type string, props string"


def mark_repeats(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Whether each event repeats the one before it of the same user (type and properties)."""
    if state.hasTimedOut:
        state.remove()
        return
    last = tuple(state.get) if state.exists else None
    rows = pd.concat(list(batches)).sort_values(["ts", "event_id"])
    out = []
    for r in rows.itertuples():
        now = (r.event_type, r.props)
        out.append((r.event_id, r.user_id, r.event_type, now == last))
        last = now
    state.update(last)
    newest = int(rows.ts.max().timestamp() * 1000)
    state.setTimeoutTimestamp(max(newest, state.getCurrentWatermarkMs()) + 24 * 3600 * 1000)
    yield pd.DataFrame(out, columns=["event_id", "user_id", "event_type", "repeat"])


def repeats_stream(events: DataFrame) -> DataFrame:
    """A user's state is dropped a day of event time after the last event."""
    seen = events.withWatermark("ts", LATE)
    return seen.groupBy("user_id").applyInPandasWithState(mark_repeats, REPEAT_OUT, REPEAT_STATE, "append", GroupStateTimeout.EventTimeTimeout)


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into Parquet files of the shared folder, and read these.

    Aggregates close with the watermark in 'append' mode; in 'complete' mode each batch is a whole result, and the last one counts.
    """
    spark = stream.sparkSession
    place = f"{checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "complete":
        done: list[int] = []

        def keep(rows: DataFrame, batch: int) -> None:
            rows.write.mode("overwrite").parquet(f"{place}/rows/{batch}")
            done.append(batch)

        stream.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{place}/rows/{max(done)}") if done else spark.createDataFrame([], stream.schema)
    stream.writeStream.format("parquet").option("path", f"{place}/rows").option("checkpointLocation", f"{place}/state").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{place}/rows")


def log_stream(events: DataFrame, folder: str, state: str) -> None:
    """Write a stream of events as JSON lines in a folder per user, once each, over what is there now."""
    events.writeStream.format("json").partitionBy("user_id").option("path", folder).option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start().awaitTermination()
