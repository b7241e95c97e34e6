"""What the queries share: the stored event log and its clock, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ingest import first_per_key, stored_events
from tidemark.plans.durable import table

BLOCKLIST = ["schedule", "Budget"]


def clock(spark: SparkSession, folder: str) -> float:
    """The log's own present: its latest time in seconds. One number, from one column."""
    row = table(spark, folder, "spine_events").where("timestamp < 1e11 and not isnan(timestamp)").agg(F.max("timestamp")).first()
    return float(row[0] or 0.0)


BRIEF = ("event_id", "timestamp", "modality", "event_type")
SAID = (*BRIEF, "payload")


def stored(
    spark: SparkSession,
    folder: str,
    as_of: float | None = None,
    since: float | None = None,
    until: float | None = None,
    modality: str | None = None,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The event log as a store holds it, or the part of it that a query asks for."""
    as_of = clock(spark, folder) if as_of is None else as_of
    return stored_events(table(spark, folder, "spine_events"), as_of, since, until, modality, columns)


def once(spark: SparkSession, folder: str, name: str, columns: Sequence[str] | None = None, since: float | None = None) -> DataFrame:
    """A log table with rows delivered again counted once; a row delivered again keeps its time, so a time bound comes first."""
    rows = table(spark, folder, name)
    rows = rows if since is None else rows.where(F.col("timestamp") >= since)
    return first_per_key(rows, "id", "timestamp", columns=columns)


_DOMAIN = """modality IN ('sight','voice','clipboard','system','keys','flow') AND event_type IN ('screen_capture','ocr_result','speech_start','speech_end','transcription',
 'clipboard_change','window_focus','idle_start','idle_end','session_lock','session_unlock','keystroke','typing_burst','typing_pause','shortcut','paste_detected',
 'correction_detected','vocabulary_learned','learning_consolidation','click','scroll','hover_dwell','drag')"""

#: CTEs: clock(now) and stored(... with p, the payload if it is valid JSON).
STORED = f"""WITH clock AS (SELECT max(timestamp) AS now FROM spine_events WHERE timestamp < 1e11 AND NOT isnan(timestamp)),
stored AS (SELECT * EXCLUDE (rn, now), CASE WHEN json_valid(payload) THEN payload END AS p FROM (
  SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY created_at NULLS LAST, timestamp, modality, event_type, app_name NULLS LAST, window_title NULLS LAST,
    monitor_index NULLS LAST, payload NULLS LAST, correlation_id NULLS LAST, attention_score NULLS LAST, cognitive_load NULLS LAST) AS rn
  FROM spine_events, clock WHERE event_id <> '' AND timestamp > 0 AND NOT isnan(timestamp) AND timestamp <= now + 60 AND {_DOMAIN}) WHERE rn = 1)
"""

ACTIVITY = """act AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY timestamp NULLS LAST, window_title NULLS LAST, app_name NULLS LAST,
  monitor_index NULLS LAST, frame_path NULLS LAST, ocr_text NULLS LAST, ocr_confidence NULLS LAST, diff_score NULLS LAST) AS rn FROM activity) WHERE rn = 1)"""
CLIPBOARD = "clip AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY timestamp NULLS LAST, text NULLS LAST) AS rn FROM clipboard) WHERE rn = 1)"
CALLS = "calls AS (SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY timestamp NULLS LAST, tool_name NULLS LAST, client_id NULLS LAST, call_count NULLS LAST) AS rn FROM mcp_calls) WHERE rn = 1)"
MEMORIES = """mem AS (SELECT * EXCLUDE (nth, first_at, created_at), first_at AS created_at FROM (SELECT *, min(created_at) OVER (PARTITION BY key) AS first_at,
  row_number() OVER (PARTITION BY key ORDER BY updated_at DESC NULLS LAST, id DESC) AS nth FROM memories) WHERE nth = 1)"""
