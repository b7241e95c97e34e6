"""Queries for scans, filters and top-k (B, F) and the lookups of joins (C)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.payload import field
from tidemark.operators import recent
from tidemark.operators.ingest import upsert_memories
from tidemark.plans.durable import table
from tidemark.queries.base import ACTIVITY, BLOCKLIST, BRIEF, SAID, CLIPBOARD, MEMORIES, STORED, clock, once, stored


def b1_recent_events(spark: SparkSession, folder: str) -> DataFrame:
    now = clock(spark, folder)
    return recent.recent_events(stored(spark, folder, now, now - 7200, modality="sight", columns=BRIEF), now, 7200, "sight")


def b2_around(spark: SparkSession, folder: str) -> DataFrame:
    now = clock(spark, folder)
    return recent.around(stored(spark, folder, now, now - 3900, now - 3300, columns=BRIEF), now - 3600, 300)


def b3_count(spark: SparkSession, folder: str) -> DataFrame:
    return stored(spark, folder, columns=("event_id", "modality")).groupBy("modality").agg(F.count("*").alias("n"))


def b4_touch_events(spark: SparkSession, folder: str) -> DataFrame:
    now = clock(spark, folder)
    return recent.recent_events(stored(spark, folder, now, now - 86_400, columns=BRIEF), now, 86_400, None, ["typing_burst", "click", "scroll", "drag", "correction_detected"])


def b5_transcriptions(spark: SparkSession, folder: str) -> DataFrame:
    now = clock(spark, folder)
    p = F.col("payload")
    shown = recent.recent_events(stored(spark, folder, now, now - 360_000, modality="voice", columns=SAID), now, 100 * 3600, "voice", ["transcription"], 200)
    return shown.select("event_id", "timestamp", field(p, "raw_transcript").alias("raw"), field(p, "transcript").alias("clean"), F.coalesce(field(p, "fix_last", kind="boolean"), F.lit(False)).alias("fix_last"))


def b6_corrections(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("payload")
    shown = recent.newest(stored(spark, folder, columns=SAID).where("event_type = 'correction_detected'"), 20)
    return shown.select("event_id", "timestamp", field(p, "original_word", "original_text").alias("original"), field(p, "corrected_word", "corrected_text").alias("corrected"), field(p, "confidence", kind="double").alias("confidence"))


def _warm(spark: SparkSession, folder: str) -> DataFrame:
    return upsert_memories(table(spark, folder, "memories"))


def b7_recall(spark: SparkSession, folder: str) -> DataFrame:
    warm, now = _warm(spark, folder), clock(spark, folder)
    hot = warm.where("updated_at is not null").select("key", F.concat(F.lit("hot "), "value").alias("value"), (F.col("updated_at") + 36_000).alias("expires_at"))
    return recent.recall(hot, warm, warm.select("key"), now)


def b8_list_memories(spark: SparkSession, folder: str) -> DataFrame:
    return recent.list_memories(_warm(spark, folder), clock(spark, folder), "voice").select("key", "updated_at")


def b9_hot_tags(spark: SparkSession, folder: str) -> DataFrame:
    now = clock(spark, folder)
    return _warm(spark, folder).where(recent.live(F.col("expires_at"), now) & F.array_contains("tags", "work")).select("key")


def b10_prune(spark: SparkSession, folder: str) -> DataFrame:
    now = clock(spark, folder)
    gone = F.coalesce(F.col("expires_at") < now, F.lit(False))
    return _warm(spark, folder).agg(F.count_if(gone).alias("pruned"), F.count_if(~gone).alias("left"))


def b11_age_prune(spark: SparkSession, folder: str) -> DataFrame:
    now = clock(spark, folder)
    return once(spark, folder, "activity", ("id", "timestamp", "monitor_index"), now - 86_400).groupBy("monitor_index").agg(F.count("*").alias("n"))


def b13_recent_frames(spark: SparkSession, folder: str) -> DataFrame:
    captures = once(spark, folder, "activity", ("timestamp", "frame_path", "diff_score"))
    frames = captures.where("frame_path is not null and timestamp is not null").groupBy("frame_path").agg(F.min("timestamp").alias("timestamp"))
    return recent.frames_with_diff(frames, captures, 5.0, 50).select("frame_path", "timestamp", "diff_score")


def b15_blocklist(spark: SparkSession, folder: str) -> DataFrame:
    hidden = recent.blocked(F.col("window_title"), BLOCKLIST)
    return once(spark, folder, "activity", ("monitor_index", "window_title")).groupBy("monitor_index").agg(F.count_if(hidden).alias("hidden"), F.count_if(~hidden).alias("shown"))


def b16_masked_titles(spark: SparkSession, folder: str) -> DataFrame:
    return once(spark, folder, "activity", ("id", "app_name", "window_title")).select("id", "app_name", recent.masked_title(F.col("window_title"), BLOCKLIST).alias("window_title"))


def b17_frame_lookup(spark: SparkSession, folder: str) -> DataFrame:
    captures = once(spark, folder, "activity", ("id", "frame_path")).where("frame_path is not null")
    return captures.groupBy("frame_path").agg(F.min("id").alias("id"))


def b19_ocr_gate(spark: SparkSession, folder: str) -> DataFrame:
    return once(spark, folder, "activity").select("id", recent.ocr_due(F.col("diff_score")).alias("due"))


def b20_text_heavy(spark: SparkSession, folder: str) -> DataFrame:
    captures = once(spark, folder, "activity").where("ocr_text is not null and ocr_text <> ''")
    lines = captures.select(F.col("id").alias("frame"), "ocr_confidence", F.posexplode(F.split("ocr_text", "\n")).alias("nth", "text"))
    return recent.text_heavy(lines.select("frame", "nth", "text", F.col("ocr_confidence").alias("confidence"))).select("frame", "text", "chars", "kind")


def b21_storage(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("payload")
    mode = field(p, "storage_mode")
    kind = F.when(field(p, "token_estimate", kind="double") > 500, "text").otherwise("image")
    return stored(spark, folder, columns=("event_id", "event_type", "monitor_index", "payload")).where("event_type = 'screen_capture'").select("event_id", recent.storage_kept(mode, kind, F.col("monitor_index") == 2).alias("kept"))


def b22_clipboard_search(spark: SparkSession, folder: str) -> DataFrame:
    found = once(spark, folder, "clipboard").where(recent.contains_text(F.col("text"), "Receipt"))
    return recent.newest(found, 20, "timestamp", "id").select("id", "timestamp")


def b23_clipboard_history(spark: SparkSession, folder: str) -> DataFrame:
    shown = recent.newest(once(spark, folder, "clipboard").where("text is not null"), 50, "timestamp", "id")
    return shown.select("id", F.length("text").alias("chars"), (F.regexp_count("text", F.lit("\n")) + 1).alias("lines"), F.substring("text", 1, 200).alias("preview"))


def c2_latest_per_monitor(spark: SparkSession, folder: str) -> DataFrame:
    return recent.latest_per_group(once(spark, folder, "activity", ("id", "timestamp", "app_name", "monitor_index")), "monitor_index").select("monitor_index", "id", "timestamp", "app_name")


def c7_nearest(spark: SparkSession, folder: str) -> DataFrame:
    return recent.nearest_row(once(spark, folder, "activity", ("id", "timestamp", "app_name")), clock(spark, folder) - 5000).select("id", "timestamp", "app_name")


def c8_monitor_summary(spark: SparkSession, folder: str) -> DataFrame:
    monitors = spark.range(6).select(F.col("id").cast("int").alias("monitor_index"))
    shown = recent.monitor_summary(monitors, once(spark, folder, "activity"), clock(spark, folder))
    return shown.select("monitor_index", "id", "app_name", "title", "change", "diff")


def j14_smart_captures(spark: SparkSession, folder: str) -> DataFrame:
    return recent.smart_captures(c8_monitor_summary(spark, folder)).select("monitor_index", "change")


def f6_hot_capacity(spark: SparkSession, folder: str) -> DataFrame:
    return recent.newest(_warm(spark, folder), 500, "updated_at", "key").select("key", "updated_at")


_NAMES = "b1_recent_events b2_around b3_count b4_touch_events b5_transcriptions b6_corrections b7_recall b8_list_memories b9_hot_tags b10_prune b11_age_prune b13_recent_frames b15_blocklist b16_masked_titles b17_frame_lookup b19_ocr_gate b20_text_heavy b21_storage b22_clipboard_search b23_clipboard_history c2_latest_per_monitor c7_nearest c8_monitor_summary j14_smart_captures f6_hot_capacity"
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_ACT, _CLIP, _MEM = STORED + ", " + ACTIVITY, STORED + ", " + CLIPBOARD, STORED + ", " + MEMORIES
_SUMMARY = _ACT + """, latest AS (SELECT *, rank() OVER (PARTITION BY monitor_index ORDER BY timestamp DESC NULLS LAST) AS r FROM act),
 summary AS (SELECT m.monitor_index, id, coalesce(nullif(app_name, ''), 'unknown') AS app_name, substr(coalesce(window_title, ''), 1, 80) AS title,
 CASE WHEN id IS NULL THEN 100.0 ELSE coalesce(diff_score, 0.0) END AS diff FROM (SELECT CAST(range AS INT) AS monitor_index FROM range(6)) m LEFT JOIN (SELECT * FROM latest WHERE r = 1) l ON l.monitor_index = m.monitor_index),
 levels AS (SELECT *, CASE WHEN diff >= 50 THEN 'major change' WHEN diff >= 10 THEN 'some change' WHEN diff >= 1 THEN 'minor change' ELSE 'static' END AS change FROM summary)"""
ORACLES = {
    "b1_recent_events": STORED + "SELECT event_id, timestamp, modality, event_type FROM stored, clock WHERE timestamp > now - 7200 AND modality = 'sight' ORDER BY timestamp DESC, event_id DESC LIMIT 50",
    "b2_around": STORED + "SELECT event_id, timestamp, modality, event_type FROM stored, clock WHERE timestamp BETWEEN now - 3900 AND now - 3300",
    "b3_count": STORED + "SELECT modality, count(*) AS n FROM stored GROUP BY 1",
    "b4_touch_events": STORED + "SELECT event_id, timestamp, modality, event_type FROM stored, clock WHERE timestamp > now - 86400 AND event_type IN ('typing_burst','click','scroll','drag','correction_detected') ORDER BY timestamp DESC, event_id DESC LIMIT 50",
    "b5_transcriptions": STORED + "SELECT event_id, timestamp, p->>'$.raw_transcript' AS raw, p->>'$.transcript' AS clean, coalesce(TRY_CAST(p->>'$.fix_last' AS BOOLEAN), false) AS fix_last FROM stored, clock WHERE timestamp > now - 360000 AND modality = 'voice' AND event_type = 'transcription' ORDER BY timestamp DESC, event_id DESC LIMIT 200",
    "b6_corrections": STORED + "SELECT event_id, timestamp, coalesce(p->>'$.original_word', p->>'$.original_text') AS original, coalesce(p->>'$.corrected_word', p->>'$.corrected_text') AS corrected, TRY_CAST(p->>'$.confidence' AS DOUBLE) AS confidence FROM stored WHERE event_type = 'correction_detected' ORDER BY timestamp DESC, event_id DESC LIMIT 20",
    "b7_recall": _MEM + "SELECT key, CASE WHEN updated_at + 36000 >= now THEN 'hot ' || value ELSE value END AS value, CASE WHEN updated_at + 36000 >= now THEN 'hot' ELSE 'warm' END AS tier FROM mem, clock",
    "b8_list_memories": _MEM + "SELECT key, updated_at FROM mem, clock WHERE (expires_at IS NULL OR expires_at > now) AND list_contains(tags, 'voice') ORDER BY updated_at DESC NULLS LAST, key DESC LIMIT 50",
    "b9_hot_tags": _MEM + "SELECT key FROM mem, clock WHERE (expires_at IS NULL OR expires_at > now) AND list_contains(tags, 'work')",
    "b10_prune": _MEM + "SELECT count(*) FILTER (expires_at < now) AS pruned, count(*) FILTER (expires_at IS NULL OR expires_at >= now) AS \"left\" FROM mem, clock",
    "b11_age_prune": _ACT + "SELECT monitor_index, count(*) AS n FROM act, clock WHERE timestamp >= now - 86400 GROUP BY 1",
    "b13_recent_frames": _ACT + ", d AS (SELECT frame_path, min(timestamp) FILTER (timestamp IS NOT NULL) AS timestamp, min(diff_score) AS diff_score FROM act WHERE frame_path IS NOT NULL GROUP BY 1) SELECT * FROM d WHERE timestamp IS NOT NULL AND (diff_score IS NULL OR diff_score >= 5) ORDER BY timestamp DESC, frame_path DESC LIMIT 50",
    "b15_blocklist": _ACT + "SELECT monitor_index, count(*) FILTER (h) AS hidden, count(*) FILTER (NOT h) AS shown FROM (SELECT *, coalesce(contains(lower(window_title), 'schedule') OR contains(lower(window_title), 'budget'), false) AS h FROM act) GROUP BY 1",
    "b16_masked_titles": _ACT + "SELECT id, app_name, CASE WHEN contains(lower(window_title), 'schedule') OR contains(lower(window_title), 'budget') THEN '[BLOCKED]' ELSE window_title END AS window_title FROM act",
    "b17_frame_lookup": _ACT + "SELECT frame_path, min(id) AS id FROM act WHERE frame_path IS NOT NULL GROUP BY 1",
    "b19_ocr_gate": _ACT + "SELECT id, coalesce(diff_score >= 5, false) AS due FROM act",
    "b20_text_heavy": _ACT + "SELECT id AS frame, ocr_text AS text, length(replace(ocr_text, chr(10), '')) AS chars, CASE WHEN length(replace(ocr_text, chr(10), '')) >= 100 AND ocr_confidence >= 0.70 THEN 'text' ELSE 'image' END AS kind FROM act WHERE ocr_text <> ''",
    "b21_storage": STORED + "SELECT event_id, CASE WHEN heavy AND mode IN ('smart', 'text') AND NOT coalesce(monitor_index = 2, false) THEN 'text' WHEN mode = 'visual' AND NOT heavy THEN 'image' ELSE 'both' END AS kept FROM (SELECT *, p->>'$.storage_mode' AS mode, coalesce(TRY_CAST(p->>'$.token_estimate' AS DOUBLE) > 500, false) AS heavy FROM stored WHERE event_type = 'screen_capture')",
    "b22_clipboard_search": _CLIP + "SELECT id, timestamp FROM clip WHERE contains(lower(text), 'receipt') ORDER BY timestamp DESC NULLS LAST, id DESC LIMIT 20",
    "b23_clipboard_history": _CLIP + "SELECT id, length(text) AS chars, length(text) - length(replace(text, chr(10), '')) + 1 AS lines, substr(text, 1, 200) AS preview FROM clip WHERE text IS NOT NULL ORDER BY timestamp DESC NULLS LAST, id DESC LIMIT 50",
    "c2_latest_per_monitor": _ACT + "SELECT monitor_index, id, timestamp, app_name FROM (SELECT *, rank() OVER (PARTITION BY monitor_index ORDER BY timestamp DESC NULLS LAST) AS r FROM act) WHERE r = 1",
    "c7_nearest": _ACT + "SELECT id, timestamp, app_name FROM act, clock WHERE timestamp IS NOT NULL ORDER BY abs(timestamp - (now - 5000)), id LIMIT 1",
    "c8_monitor_summary": _SUMMARY + "SELECT monitor_index, id, app_name, title, change, diff FROM levels",
    "j14_smart_captures": _SUMMARY + "SELECT monitor_index, change FROM levels WHERE diff >= 1 OR id IS NULL",
    "f6_hot_capacity": _MEM + "SELECT key, updated_at FROM mem ORDER BY updated_at DESC NULLS LAST, key DESC LIMIT 500",
}
