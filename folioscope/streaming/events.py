"""Streams of events and jobs; the checkpoint folder keeps what was consumed, so a restart repeats nothing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from folioscope.operators.service import newest


def event_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """Parquet files of events as they arrive."""
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def windowed_metrics(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum per window and type; a window is final when the watermark has passed it."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def limited(events: DataFrame, seconds: int, limit: int) -> DataFrame:
    """``user_id, event_id, allowed`` of a sliding limit per user: kept state is the times of allowed events in the window."""

    def decide(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        out = []
        for e, t in zip(rows["event_id"], rows["ts"], strict=True):
            at = pd.Timestamp(t).timestamp()
            kept = [k for k in kept if at - k < seconds]
            ok = len(kept) < limit
            if ok:
                kept.append(at)
            out.append((key[0], int(e), ok))
        state.update((kept,))
        yield pd.DataFrame(out, columns=["user_id", "event_id", "allowed"])

    return events.groupBy("user_id").applyInPandasWithState(
        decide, "user_id bigint, event_id bigint, allowed boolean", "kept array<double>", "append", GroupStateTimeout.NoTimeout
    )


def upsert_into(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Newest row per user in ``target``, rewritten batch by batch under a new version folder; a repeated batch writes the same version."""

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        merged = batch.select("user_id", "ts", "event_id", "event_type")
        if number:
            merged = merged.unionByName(spark.read.parquet(f"{target}/version={number - 1}"))
        newest(merged, "user_id", "ts", "event_id").write.mode("overwrite").parquet(f"{target}/version={number}")

    return events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_to(events: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append-only log as Parquet, each event once."""
    return events.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
