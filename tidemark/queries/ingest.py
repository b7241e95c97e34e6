"""Queries for ingestion (A)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.payload import parsed
from tidemark.operators import ingest
from tidemark.plans.durable import table
from tidemark.queries.base import ACTIVITY, BRIEF, MEMORIES, SAID, STORED, clock, once, stored


def a1_quarantine(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.validated(table(spark, folder, "spine_events"), clock(spark, folder))[1].select("event_id", "modality", "event_type", "reason")


def a2_stored_events(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder, columns=(*BRIEF, "created_at"))


def a3_payload_codec(spark: SparkSession, folder: str) -> DataFrame:
    there = stored(spark, folder, columns=SAID).select("event_id", parsed(F.col("payload")).alias("v"))
    return there.select("event_id", F.size(F.json_object_keys(F.to_json("v"))).alias("n_fields")).where("n_fields is not null")


def a5_late_ocr(spark: SparkSession, folder: str) -> DataFrame:
    captures = once(spark, folder, "activity", ("id", "ocr_confidence"))
    late = stored(spark, folder, columns=("event_type", "monitor_index", "created_at")).where("event_type = 'ocr_result'").groupBy(F.col("monitor_index").cast("bigint").alias("id")).agg(F.max("created_at").alias("ocr_confidence"))
    return ingest.late_update(captures.select("id", "ocr_confidence"), late, "id", ["ocr_confidence"])


def a7_memory_upsert(spark: SparkSession, folder: str) -> DataFrame:
    return ingest.upsert_memories(table(spark, folder, "memories")).select("key", "id", "value", F.array_join("tags", ",").alias("tags"), "created_at", "updated_at")


def a8_quota(spark: SparkSession, folder: str) -> DataFrame:
    rows = ingest.upsert_memories(table(spark, folder, "memories"))
    existing, incoming = rows.where("modality = 'voice'"), rows.where("modality is null or modality <> 'voice'")
    return ingest.within_quota(existing, incoming, existing.count() + 100).select("key", "created_at")


def a9_ttl(spark: SparkSession, folder: str) -> DataFrame:
    hours = F.pmod(F.col("id"), F.lit(30)).cast("double")
    rows = ingest.upsert_memories(table(spark, folder, "memories"))
    return rows.select("key", ingest.expiry(F.col("updated_at"), hours).alias("expires_at"), ingest.hot_expiry(F.col("updated_at"), hours / 60).alias("hot_expires_at"))


def a10_forget(spark: SparkSession, folder: str) -> DataFrame:
    rows = ingest.upsert_memories(table(spark, folder, "memories"))
    asked = rows.where("attention_score > 0.5").select("key").union(rows.where("attention_score > 0.9").select(F.concat("key", F.lit("!")).alias("key")))
    return ingest.forget(rows, asked)[1]


def a19_delete_by_payload(spark: SparkSession, folder: str) -> DataFrame:
    drop = F.coalesce(F.try_variant_get(parsed(F.col("payload")), "$.storage_mode", "string") == "visual", F.lit(False))
    return stored(spark, folder, columns=SAID).where(~drop).groupBy("event_type").agg(F.count("*").alias("n"))


def a20_token_cost(spark: SparkSession, folder: str) -> DataFrame:
    size = F.col("doc_id")
    return table(spark, folder, "documents").select("doc_id", ingest.text_tokens(F.col("text")).alias("text_tokens"), ingest.image_tokens(size, F.pmod(size, F.lit(7)) * 100).alias("image_tokens"))


QUERIES = {f.__name__: f for f in (a1_quarantine, a2_stored_events, a3_payload_codec, a5_late_ocr, a7_memory_upsert, a8_quota, a9_ttl, a10_forget, a19_delete_by_payload, a20_token_cost)}

_UPSERTED = "WITH " + MEMORIES
ORACLES = {
    "a1_quarantine": STORED.split(",\nstored")[0] + """, marked AS (SELECT *, CASE WHEN event_id IS NULL OR event_id = '' THEN 'no id' WHEN timestamp IS NULL OR isnan(timestamp) OR timestamp <= 0 THEN 'no time'
        WHEN timestamp > now + 60 THEN 'future' WHEN modality IS NULL OR modality NOT IN ('sight','voice','clipboard','system','keys','flow') THEN 'modality'
        WHEN event_type IS NULL OR event_type NOT IN ('screen_capture','ocr_result','speech_start','speech_end','transcription','clipboard_change','window_focus','idle_start','idle_end','session_lock',
        'session_unlock','keystroke','typing_burst','typing_pause','shortcut','paste_detected','correction_detected','vocabulary_learned','learning_consolidation','click','scroll','hover_dwell','drag') THEN 'event type' END AS reason
        FROM spine_events, clock) SELECT event_id, modality, event_type, reason FROM marked WHERE reason IS NOT NULL""",
    "a2_stored_events": STORED + "SELECT event_id, timestamp, modality, event_type, created_at FROM stored",
    "a3_payload_codec": STORED + "SELECT event_id, len(json_keys(p)) AS n_fields FROM stored WHERE p IS NOT NULL AND json_type(p) = 'OBJECT'",
    "a5_late_ocr": STORED + ", " + ACTIVITY + ", late AS (SELECT CAST(monitor_index AS BIGINT) AS id, max(created_at) AS c FROM stored WHERE event_type = 'ocr_result' GROUP BY 1) SELECT act.id, coalesce(c, ocr_confidence) AS ocr_confidence FROM act LEFT JOIN late USING (id)",
    "a7_memory_upsert": _UPSERTED + " SELECT key, id, value, array_to_string(list_sort(tags), ',') AS tags, created_at, updated_at FROM mem",
    "a8_quota": _UPSERTED + " SELECT key, created_at FROM mem WHERE modality IS NULL OR modality <> 'voice' ORDER BY created_at NULLS LAST, key LIMIT 100",
    "a9_ttl": _UPSERTED + " SELECT key, CASE WHEN id % 30 > 0 THEN updated_at + (id % 30) * 3600 END AS expires_at, updated_at + CASE WHEN id % 30 > 0 THEN least((id % 30) * 60, 300) ELSE 300 END AS hot_expires_at FROM mem",
    "a10_forget": _UPSERTED + " SELECT key, true AS existed FROM mem WHERE attention_score > 0.5 UNION ALL SELECT key || '!', false FROM mem WHERE attention_score > 0.9",
    "a19_delete_by_payload": STORED + "SELECT event_type, count(*) AS n FROM stored WHERE coalesce(p->>'$.storage_mode', '') <> 'visual' GROUP BY 1",
    "a20_token_cost": "SELECT doc_id, CASE WHEN text IS NOT NULL THEN greatest(1, length(text) // 4) END AS text_tokens, greatest(1, CAST(round_even(doc_id * ((doc_id % 7) * 100) / 750, 0) AS BIGINT)) AS image_tokens FROM documents",
}
