"""Structured Streaming: validated ingest, deduplication, sessions, roll-ups and stateful rules."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.ingest import EVENT_TYPES, MODALITIES

log = logging.getLogger(__name__)
FUTURE = "60 seconds"


def with_time(events: DataFrame) -> DataFrame:
    """Events with ``ts``, their time as a timestamp; unusable times give null."""
    usable = F.col("timestamp").isNotNull() & ~F.isnan("timestamp") & (F.col("timestamp") > 0) & (F.col("timestamp") < 1e11)
    return events.withColumn("ts", F.when(usable, F.timestamp_seconds("timestamp")))


def valid_stream(events: DataFrame, now: str | None = None) -> DataFrame:
    """Events of a stream that pass validation; ``now`` fixes the clock for replays, else it is the trigger's."""
    clock = F.to_timestamp(F.lit(now)) if now else F.current_timestamp()
    named = with_time(events)
    return named.where((F.col("event_id") != "") & F.col("ts").isNotNull() & (F.col("ts") <= clock + F.expr(f"interval {FUTURE}")) & F.col("modality").isin(*MODALITIES) & F.col("event_type").isin(*EVENT_TYPES))


def deduplicated(events: DataFrame, lateness: str = "10 minutes") -> DataFrame:
    """Each event_id once inside the watermark; what comes later than ``lateness`` may pass again or be dropped."""
    return events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"])


def stream_sessions(events: DataFrame, gap: str = "300 seconds", lateness: str = "10 minutes") -> DataFrame:
    """(modality, app_name, start, end, n_events): sessions of a stream, given out once the watermark has passed their end."""
    keyed = events.withColumn("app_name", F.coalesce(F.lower(F.trim("app_name")), F.lit(""))).withWatermark("ts", lateness)
    grouped = keyed.groupBy("modality", "app_name", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n_events"))
    return grouped.select("modality", "app_name", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n_events")


def stream_rollup(events: DataFrame, width: str = "15 minutes", lateness: str = "10 minutes") -> DataFrame:
    """(start, modality, n): counts in tumbling windows."""
    grouped = events.withWatermark("ts", lateness).groupBy(F.window("ts", width).alias("w"), "modality").agg(F.count("*").alias("n"))
    return grouped.select(F.col("w.start").alias("start"), "modality", "n")


def stream_debounced(events: DataFrame, group: str, gap_seconds: float, lateness: str = "10 minutes") -> DataFrame:
    """(group, event_id, timestamp): events at least the gap after the last accepted one of their group; the state is that one time.

    Rows of one trigger are put in order of time, then id; a row older than the last accepted one is dropped.
    """

    def decide(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else float("-inf")
        out = []
        for event, time in pd.concat(pdfs)[["event_id", "timestamp"]].sort_values(["timestamp", "event_id"]).itertuples(index=False):
            if time - last >= gap_seconds:
                last = time
                out.append((key[0], event, time))
        if last != float("-inf"):
            state.update((last,))
        yield pd.DataFrame(out, columns=[group, "event_id", "timestamp"])

    rows = events.withWatermark("ts", lateness).where(F.col(group).isNotNull())
    return rows.groupBy(group).applyInPandasWithState(decide, f"{group} string, event_id string, timestamp double", "last double", "append", GroupStateTimeout.NoTimeout)


def fan_out(events: DataFrame, sinks: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Hand each micro-batch to every sink; an error of one is logged and does not keep the others from theirs."""

    def deliver(batch: DataFrame, number: int) -> None:
        batch.persist()
        try:
            for name, sink in sinks.items():
                try:
                    sink(batch, number)
                except Exception:
                    log.exception("sink %s failed on batch %d", name, number)
        finally:
            batch.unpersist()

    writer = events.writeStream.foreachBatch(deliver).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
