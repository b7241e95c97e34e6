"""Sessions: bursts of work between pauses, of every device in every app."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clean import app_key, epoch_micros, present
from tidemark.operators.ordered import runs_in_order

SEPARATOR = "\x1f"


def sessions(events: DataFrame, gap_seconds: float = 300.0) -> DataFrame:
    """Split each stream (modality, app_name) of ``events`` where it pauses longer than the gap.

    Events are ordered by a secondary sort on (stream, time, event_id) in ranges, and each range is
    read once with one open session in memory. A pause of exactly the gap does not split. Events
    with a missing modality or event_id or an unusable timestamp take no part; all missing apps are one app
    (app_name ''). An event delivered again counts once. Other columns are ignored, an empty table
    gives no session. Columns: modality, app_name, first_event_id, last_event_id, start_time,
    end_time, duration_seconds, n_events.
    """
    named = events.select(F.lower(present(F.col("modality"))).alias("m"), app_key(F.col("app_name")).alias("a"), epoch_micros(F.col("timestamp")).alias("us"), "event_id").where("m is not null")
    runs = runs_in_order(named, F.concat_ws(SEPARATOR, "m", "a"), F.lit(""), F.col("us"), F.col("event_id"), round(gap_seconds * 1e6))
    stream = F.split("stream", SEPARATOR)
    return runs.select(
        stream[0].alias("modality"),
        stream[1].alias("app_name"),
        F.col("first_id").alias("first_event_id"),
        F.col("last_id").alias("last_event_id"),
        (F.col("start_us") / 1e6).alias("start_time"),
        (F.col("end_us") / 1e6).alias("end_time"),
        ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_seconds"),
        F.col("n").alias("n_events"),
    )
