"""Tile and job states over event streams.

Events (ts timestamp, user_id, event_type, value) arrive as files; states are kept by key with a watermark, so late
events within it still count and older state is dropped."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Share of finished tiles' states by event: what an event makes of a tile.
NEXT = {"view": "processing", "click": "processing", "purchase": "done", "signup": "queued", "error": "failed"}


def events_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 16) -> DataFrame:
    """A stream of event files; timestamps without a zone become UTC instants."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(events: DataFrame, length: str = "1 hour", late: str = "1 day") -> DataFrame:
    """Stage counts and sums in tumbling windows."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("ms")).select(F.col("window.start").alias("start"), "event_type", "n", "ms")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """Sessions of a user that end after a gap."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def tile_states(events: DataFrame) -> DataFrame:
    """tile, state, steps, failures after each batch that touches a tile; failures survive restarts by the checkpoint."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        steps, failures, at, now = state.get if state.exists else (0, 0, -1, "queued")
        for pdf in batches:
            steps += len(pdf)
            failures += int((pdf["event_type"] == "error").sum())
            last = pdf.sort_values(["t", "event_id"]).iloc[-1]
            if int(last["t"]) >= at:
                at, now = int(last["t"]), NEXT.get(last["event_type"], now)
        state.update((steps, failures, at, now))
        yield pd.DataFrame({"tile": [key[0]], "state": [now], "steps": [steps], "failures": [failures]})

    timed = events.select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return timed.groupBy("user_id").applyInPandasWithState(step, "tile long, state string, steps long, failures long", "steps long, failures long, at long, now string", "update", GroupStateTimeout.NoTimeout)


def replay(stream: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there into a table in memory."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
