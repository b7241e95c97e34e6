"""Problem 3: sessions of every device in every app."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.operators.sessions import sessions
from tidemark.plans.durable import table


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return sessions(table(spark, folder, "spine_events")).select("first_event_id", "last_event_id")


def p3_sessions(spark: SparkSession, folder: str) -> DataFrame:
    return sessions(table(spark, folder, "spine_events"))


_SESSIONS = r"""
WITH named AS (
  SELECT event_id,
    lower(regexp_replace(modality, '^\s+|\s+$', '', 'g')) AS modality,
    regexp_replace(lower(regexp_replace(coalesce(app_name, ''), '^\s+|\s+$', '', 'g')), '\.exe$', '') AS app_name,
    CAST(round(CASE WHEN timestamp < 1e11 THEN timestamp WHEN timestamp < 1e14 THEN timestamp / 1e3
      WHEN timestamp < 1e17 THEN timestamp / 1e6 ELSE timestamp / 1e9 END * 1e6) AS BIGINT) AS us
  FROM spine_events WHERE timestamp > 0 AND NOT isnan(timestamp)
), once AS (SELECT DISTINCT event_id, modality, app_name, us FROM named WHERE modality <> '' AND event_id IS NOT NULL),
marked AS (
  SELECT *, CASE WHEN us - lag(us) OVER w <= 300000000 THEN 0 ELSE 1 END AS begins
  FROM once WINDOW w AS (PARTITION BY modality, app_name ORDER BY us, event_id)
), numbered AS (
  SELECT *, sum(begins) OVER (PARTITION BY modality, app_name ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS session FROM marked
), grouped AS (
  SELECT modality, app_name, first(event_id ORDER BY us, event_id) AS first_event_id, last(event_id ORDER BY us, event_id) AS last_event_id,
    min(us) / 1e6 AS start_time, max(us) / 1e6 AS end_time, (max(us) - min(us)) / 1e6 AS duration_seconds, count(*) AS n_events
  FROM numbered GROUP BY modality, app_name, session
)
"""

QUERIES = {"p3_found": p3_found, "p3_sessions": p3_sessions}
ORACLES = {
    "p3_found": _SESSIONS + "SELECT first_event_id, last_event_id FROM grouped",
    "p3_sessions": _SESSIONS + "SELECT modality, app_name, first_event_id, last_event_id, start_time, end_time, duration_seconds, n_events FROM grouped",
}
