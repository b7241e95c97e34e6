"""Queries for time joins (C), aggregations (D), ordered analytics (E) and stateful rules in batch form (G)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.payload import field
from tidemark.operators import changes, summaries, timejoin
from tidemark.operators.ingest import image_tokens, text_tokens, upsert_memories
from tidemark.plans.durable import table
from tidemark.queries.base import ACTIVITY, BRIEF, CALLS, CLIPBOARD, MEMORIES, SAID, STORED, clock, once, stored

DAY = 86_400


def _of(events: DataFrame, kind: str) -> DataFrame:
    return events.where(F.col("event_type") == kind).select("event_id", "timestamp")


def c3_interval_join(spark: SparkSession, folder: str) -> DataFrame:
    events = stored(spark, folder, columns=BRIEF)
    return timejoin.range_join(_of(events, "transcription"), _of(events, "correction_detected"), 0, 30).select("l_event_id", "r_event_id")


def c4_screen_context(spark: SparkSession, folder: str) -> DataFrame:
    events, p = stored(spark, folder, columns=SAID), F.col("payload")
    seen = events.where("event_type = 'ocr_result'").select("event_id", "timestamp", field(p, "ocr_text").alias("text"), F.coalesce(field(p, "ocr_confidence", kind="double"), F.lit(0.0)).alias("confidence"))
    pairs = timejoin.range_join(_of(events, "transcription"), seen.where("confidence >= 0.75"), -60, 60)
    ordered = F.array_sort(F.collect_list(F.struct("r_timestamp", "r_event_id", "r_text")))
    return pairs.groupBy("l_event_id").agg(F.array_join(F.transform(ordered, lambda x: x["r_text"]), " ").alias("screen_text"), F.count("*").alias("n"))


def c6_hash_join(spark: SparkSession, folder: str) -> DataFrame:
    events, p = stored(spark, folder, columns=SAID), F.col("payload")
    clips = events.where("event_type = 'clipboard_change'").select("event_id", "timestamp", F.coalesce(field(p, "hash"), timejoin.content_hash(field(p, "text"))).alias("hash"))
    again = clips.select(F.concat(F.lit("again "), "event_id").alias("event_id"), (F.col("timestamp") + 20).alias("timestamp"), "hash")
    return timejoin.voice_source(again, clips, 30.0)


def c7_nearest_capture(spark: SparkSession, folder: str) -> DataFrame:
    probes = once(spark, folder, "clipboard", ("id", "timestamp")).select(F.col("id").alias("clip_id"), "timestamp")
    captures = once(spark, folder, "activity", ("id", "timestamp")).select(F.col("id").alias("capture_id"), "timestamp")
    return timejoin.nearest_join(probes, captures, "clip_id", "capture_id")


def c9_semi_join(spark: SparkSession, folder: str) -> DataFrame:
    sources = stored(spark, folder, columns=("event_id",)).select(F.col("event_id").alias("source_event_id"))
    return upsert_memories(table(spark, folder, "memories")).join(sources, "source_event_id", "left_semi").select("key", "source_event_id")


def d1_app_summary(spark: SparkSession, folder: str) -> DataFrame:
    since = clock(spark, folder) - DAY
    return summaries.app_summary(once(spark, folder, "activity", ("id", "timestamp", "app_name"), since), since)


def d2_app_share(spark: SparkSession, folder: str) -> DataFrame:
    return d1_app_summary(spark, folder).orderBy(F.desc("n"), F.desc("last_seen"), "app_name").limit(15).select("app_name", "n", "share")


def d1_titles(spark: SparkSession, folder: str) -> DataFrame:
    since = clock(spark, folder) - DAY
    return summaries.recent_titles(once(spark, folder, "activity", ("id", "timestamp", "window_title"), since), since)


def d3_call_stats(spark: SparkSession, folder: str) -> DataFrame:
    since = clock(spark, folder) - DAY
    return summaries.call_stats(once(spark, folder, "mcp_calls", since=since), since)


def d4_voice_stats(spark: SparkSession, folder: str) -> DataFrame:
    now = clock(spark, folder)
    return summaries.voice_stats(stored(spark, folder, now, now - DAY, modality="voice", columns=SAID), now - DAY)


def d5_touch_stats(spark: SparkSession, folder: str) -> DataFrame:
    now = clock(spark, folder)
    return summaries.touch_stats(stored(spark, folder, now, now - DAY, columns=SAID), now - DAY)


def d6_scorecard(spark: SparkSession, folder: str) -> DataFrame:
    now = clock(spark, folder)
    return summaries.scorecard(stored(spark, folder, now, now - DAY, columns=BRIEF), now - DAY)


def d6_corrected_words(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.corrected_words(stored(spark, folder, columns=SAID))


def d7_weekly_trend(spark: SparkSession, folder: str) -> DataFrame:
    day = F.floor(F.col("timestamp") / 3600).cast("string")  # an entry for each hour
    said, fixed = F.count_if(F.col("event_type") == "transcription"), F.count_if(F.col("event_type") == "correction_detected")
    history = stored(spark, folder, columns=BRIEF).groupBy(day.alias("date")).agg(F.try_divide(fixed, said).alias("correction_rate"), said.alias("vocab_user_size"), F.array(F.struct(F.lit("word").alias("word"), fixed.alias("count"))).alias("top_corrected_words"))
    report = summaries.weekly_report(history)
    growth = report["growth"].select("user").first()
    return report["trend"].select("date", "correction_rate", F.lit(growth["user"] if growth else None).cast("bigint").alias("growth"))


def d8_timeline_counts(spark: SparkSession, folder: str) -> DataFrame:
    now = clock(spark, folder)
    return stored(spark, folder, now, now - 3600, columns=BRIEF).where(F.col("timestamp") > now - 3600).groupBy("modality", "event_type").agg(F.count("*").alias("n"))


def d10_escalations(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.escalations(stored(spark, folder, columns=SAID), 0.0, 2)


def d15_cold_windows(spark: SparkSession, folder: str) -> DataFrame:
    windows = summaries.cold_windows(upsert_memories(table(spark, folder, "memories")))
    return windows.select("window_start", "window_end", "text_content", "entry_count", F.array_join("modalities", ",").alias("modalities"), F.array_join("keys", ",").alias("keys"))


def d16_tier_stats(spark: SparkSession, folder: str) -> DataFrame:
    warm = upsert_memories(table(spark, folder, "memories"))
    return summaries.tier_stats({"warm": warm, "cold": summaries.cold_windows(warm).withColumnRenamed("text_content", "value")})


def d17_buffer_status(spark: SparkSession, folder: str) -> DataFrame:
    frames = once(spark, folder, "activity").select("timestamp", "monitor_index", text_tokens(F.col("ocr_text")).alias("text_tokens"), image_tokens(F.lit(1280), F.lit(720)).alias("image_tokens"))
    return summaries.buffer_status(frames)


def d18_profile_titles(spark: SparkSession, folder: str) -> DataFrame:
    now = clock(spark, folder)
    return summaries.recent_titles(stored(spark, folder, now, now - 7200, columns=("timestamp", "window_title")), now - 7200, 10, ["Program Manager"], 4)


def d19_confidence_histogram(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.confidence_histogram(once(spark, folder, "activity"), "ocr_confidence")


def d20_pass_rates(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.pass_rates(once(spark, folder, "mcp_calls"), "tool_name", F.col("client_id") != "unknown")


def e2_no_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return changes.drop_repeats(stored(spark, folder, columns=BRIEF), "event_type", "modality", "timestamp", "event_id").select("event_id", "modality", "event_type")


def e5_idle_wakes(spark: SparkSession, folder: str) -> DataFrame:
    return changes.idle_wakes(once(spark, folder, "activity", ("id", "timestamp", "monitor_index")), "monitor_index").select("id", "gap", changes.adaptive_interval(F.col("gap"), 5.0, 30.0).alias("interval"))


def e6_focus_changes(spark: SparkSession, folder: str) -> DataFrame:
    return changes.focus_changes(once(spark, folder, "activity", ("id", "timestamp", "window_title", "monitor_index"))).select("id", "window_title", "previous_title")


def g1_typing_bursts(spark: SparkSession, folder: str) -> DataFrame:
    moments = F.timestamp_micros(F.round(F.col("timestamp") * 1e6).cast("bigint"))
    keys = stored(spark, folder, columns=BRIEF).select("modality", moments.alias("ts"), F.lit("x").alias("key_char"), (F.col("event_type") == "scroll").alias("is_backspace"), (F.col("event_type") == "drag").alias("is_selection"))
    return changes.typing_bursts(keys, "modality", 30.0).select("modality", "char_count", "word_count", "duration_ms", "backspace_count", "has_selection")


def g3_debounced(spark: SparkSession, folder: str) -> DataFrame:
    return changes.debounced(stored(spark, folder, columns=("event_id", "modality", "timestamp")), "modality", 20.0, key="event_id").select("event_id", "modality")


def g4_stored_clips(spark: SparkSession, folder: str) -> DataFrame:
    return changes.stored_clips(once(spark, folder, "clipboard"), 60.0)


def g7_watch_windows(spark: SparkSession, folder: str) -> DataFrame:
    events = stored(spark, folder, columns=BRIEF)
    return changes.watch_windows(_of(events, "paste_detected"), _of(events, "window_focus"), 600.0)


_NAMES = """c3_interval_join c4_screen_context c6_hash_join c7_nearest_capture c9_semi_join d1_app_summary d1_titles d2_app_share d3_call_stats d4_voice_stats d5_touch_stats d6_scorecard
d6_corrected_words d7_weekly_trend d8_timeline_counts d10_escalations d15_cold_windows d16_tier_stats d17_buffer_status d18_profile_titles d19_confidence_histogram d20_pass_rates
e2_no_repeats e5_idle_wakes e6_focus_changes g1_typing_bursts g3_debounced g4_stored_clips g7_watch_windows"""
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_ACT, _CLIP, _MEM, _CALL = STORED + ", " + ACTIVITY, STORED + ", " + CLIPBOARD, STORED + ", " + MEMORIES, STORED + ", " + CALLS
_APPS = _ACT + ", apps AS (SELECT coalesce(nullif(app_name, ''), 'unknown') AS app_name, count(*) AS n, max(timestamp) AS last_seen, count(*) * 100.0 / sum(count(*)) OVER () AS share FROM act, clock WHERE timestamp >= now - 86400 GROUP BY 1)"
_COLD = _MEM + """, lines AS (SELECT *, CAST(floor(updated_at / 900) * 900 AS DOUBLE) AS window_start, CASE WHEN coalesce(key, '') <> '' AND coalesce(value, '') <> '' THEN key || chr(10) || value ELSE coalesce(nullif(key, ''), value, '') END AS line
  FROM mem WHERE updated_at IS NOT NULL),
 cold AS (SELECT window_start, window_start + 900 AS window_end, coalesce(string_agg(line, chr(10) ORDER BY updated_at, id) FILTER (line <> ''), '') AS text_content, count(*) AS entry_count,
  coalesce(array_to_string(list_sort(list(DISTINCT modality) FILTER (modality IS NOT NULL)), ','), '') AS modalities, string_agg(key, ',' ORDER BY updated_at, id) AS keys FROM lines GROUP BY window_start)"""
ORACLES = {
    "c3_interval_join": STORED + "SELECT l.event_id AS l_event_id, r.event_id AS r_event_id FROM stored l JOIN stored r ON r.timestamp > l.timestamp AND r.timestamp < l.timestamp + 30 WHERE l.event_type = 'transcription' AND r.event_type = 'correction_detected'",
    "c4_screen_context": STORED + "SELECT l.event_id AS l_event_id, string_agg(r.p->>'$.ocr_text', ' ' ORDER BY r.timestamp, r.event_id) AS screen_text, count(*) AS n FROM stored l JOIN stored r ON r.timestamp > l.timestamp - 60 AND r.timestamp < l.timestamp + 60 WHERE l.event_type = 'transcription' AND r.event_type = 'ocr_result' AND TRY_CAST(r.p->>'$.ocr_confidence' AS DOUBLE) >= 0.75 GROUP BY 1",
    "c6_hash_join": STORED + """, clips AS (SELECT event_id, timestamp, coalesce(p->>'$.hash', substr(sha256(p->>'$.text'), 1, 16)) AS hash FROM stored WHERE event_type = 'clipboard_change'),
      pairs AS (SELECT 'again ' || a.event_id AS event_id, b.event_id AS voice_id, a.hash AS h1, b.hash AS h2, row_number() OVER (PARTITION BY a.event_id ORDER BY b.timestamp DESC, b.event_id DESC) AS nth FROM clips a JOIN clips b ON b.timestamp > a.timestamp + 20 - 30 AND b.timestamp < a.timestamp + 20 + 1e-9)
      SELECT event_id, arg_min(voice_id, nth) AS voice_id FROM pairs WHERE nth <= 5 AND h1 = h2 GROUP BY 1""",
    "c7_nearest_capture": _CLIP + ", " + ACTIVITY + ", pairs AS (SELECT clip.id AS clip_id, act.id AS capture_id, abs(act.timestamp - clip.timestamp) AS gap, row_number() OVER (PARTITION BY clip.id ORDER BY abs(act.timestamp - clip.timestamp), act.id) AS nth FROM clip, act WHERE clip.timestamp IS NOT NULL AND act.timestamp IS NOT NULL) SELECT clip_id, capture_id, gap FROM pairs WHERE nth = 1",
    "c9_semi_join": _MEM + "SELECT key, source_event_id FROM mem WHERE source_event_id IN (SELECT event_id FROM stored)",
    "d1_app_summary": _APPS + "SELECT * FROM apps",
    "d1_titles": _ACT + "SELECT window_title, max(timestamp) AS last_seen FROM act, clock WHERE timestamp >= now - 86400 AND window_title <> '' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20",
    "d2_app_share": _APPS + "SELECT app_name, n, share FROM apps ORDER BY n DESC, last_seen DESC, app_name LIMIT 15",
    "d3_call_stats": _CALL + "SELECT client_id, tool_name, count(*) AS calls, min(timestamp) AS first_call, max(timestamp) AS last_call FROM (SELECT coalesce(client_id, 'unknown') AS client_id, coalesce(tool_name, '') AS tool_name, timestamp FROM calls, clock WHERE timestamp >= now - 86400) GROUP BY ROLLUP (client_id, tool_name)",
    "d4_voice_stats": STORED + "SELECT count(*) AS dictations, coalesce(sum(s), 0.0) AS seconds, avg(s) AS mean_seconds, count(*) FILTER (raw IS DISTINCT FROM clean) AS corrected, coalesce(count(*) FILTER (raw IS DISTINCT FROM clean) * 100.0 / nullif(count(*), 0), 0.0) AS corrected_percent, count(*) FILTER (cleaned) AS cleanups FROM (SELECT TRY_CAST(p->>'$.duration_seconds' AS DOUBLE) AS s, p->>'$.raw_transcript' AS raw, p->>'$.transcript' AS clean, TRY_CAST(p->>'$.cleanup_applied' AS BOOLEAN) AS cleaned FROM stored, clock WHERE timestamp > now - 86400 AND modality = 'voice' AND event_type = 'transcription')",
    "d5_touch_stats": STORED + "SELECT count(*) FILTER (b) AS bursts, CAST(coalesce(sum(c) FILTER (b), 0) AS BIGINT) AS chars, CAST(coalesce(sum(k) FILTER (b), 0) AS BIGINT) AS backspaces, avg(w) FILTER (b AND w > 0) AS mean_wpm, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'scroll') AS scrolls, count(*) FILTER (event_type = 'drag') AS drags, count(*) FILTER (event_type = 'correction_detected') AS corrections FROM (SELECT event_type, event_type = 'typing_burst' AS b, TRY_CAST(p->>'$.char_count' AS DOUBLE) AS c, TRY_CAST(p->>'$.backspace_count' AS DOUBLE) AS k, TRY_CAST(p->>'$.wpm' AS DOUBLE) AS w FROM stored, clock WHERE timestamp > now - 86400)",
    "d6_scorecard": STORED + "SELECT t AS transcriptions, c AS corrections, coalesce(round_even(c / nullif(t, 0), 4), 0.0) AS rate FROM (SELECT count(*) FILTER (modality = 'voice' AND event_type = 'transcription') AS t, count(*) FILTER (event_type = 'correction_detected') AS c FROM stored, clock WHERE timestamp > now - 86400)",
    "d6_corrected_words": STORED + "SELECT lower(trim(coalesce(p->>'$.original_word', p->>'$.original_text'))) AS word, count(*) AS n FROM (SELECT * FROM stored WHERE event_type = 'correction_detected' ORDER BY timestamp DESC, event_id DESC LIMIT 100) WHERE word <> '' GROUP BY 1 ORDER BY n DESC, word LIMIT 10",
    "d7_weekly_trend": STORED + ", days AS (SELECT CAST(CAST(floor(timestamp / 3600) AS BIGINT) AS VARCHAR) AS date, count(*) FILTER (event_type = 'correction_detected') / nullif(count(*) FILTER (event_type = 'transcription'), 0) AS correction_rate, count(*) FILTER (event_type = 'transcription') AS v FROM stored GROUP BY 1) SELECT date, correction_rate, (SELECT arg_max(v, date) - arg_min(v, date) FROM days) AS growth FROM (SELECT * FROM days ORDER BY date DESC LIMIT 28)",
    "d8_timeline_counts": STORED + "SELECT modality, event_type, count(*) AS n FROM stored, clock WHERE timestamp > now - 3600 GROUP BY 1, 2",
    "d10_escalations": STORED + "SELECT original, arg_max(corrected, (timestamp, event_id)) AS corrected, count(*) AS n FROM (SELECT lower(trim(coalesce(p->>'$.original_word', p->>'$.original_text'))) AS original, trim(coalesce(p->>'$.corrected_word', p->>'$.corrected_text')) AS corrected, timestamp, event_id FROM stored WHERE event_type = 'correction_detected') WHERE original <> '' AND corrected <> '' AND original <> lower(corrected) GROUP BY 1 HAVING count(*) >= 2",
    "d15_cold_windows": _COLD + "SELECT * FROM cold",
    "d16_tier_stats": _COLD + "SELECT 'warm' AS tier, count(*) AS entries, coalesce(sum(length(value)), 0)::BIGINT AS chars FROM mem UNION ALL SELECT 'cold', count(*), coalesce(sum(length(text_content)), 0)::BIGINT FROM cold",
    "d17_buffer_status": _ACT + "SELECT count(*) AS frames, count(DISTINCT monitor_index) AS monitors, max(timestamp) - min(timestamp) AS span_seconds, sum(CASE WHEN ocr_text IS NOT NULL THEN greatest(1, length(ocr_text) // 4) END)::BIGINT AS text_tokens, (count(*) * 1229)::BIGINT AS image_tokens, (count(*) * 1229 - sum(CASE WHEN ocr_text IS NOT NULL THEN greatest(1, length(ocr_text) // 4) END)) * 100.0 / (count(*) * 1229) AS saved_percent FROM act",
    "d18_profile_titles": STORED + "SELECT window_title, max(timestamp) AS last_seen FROM stored, clock WHERE timestamp >= now - 7200 AND length(window_title) >= 4 AND lower(window_title) <> 'program manager' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "d19_confidence_histogram": _ACT + "SELECT CAST(floor(ocr_confidence / 0.1) AS BIGINT) AS bucket, count(*) AS n FROM act WHERE ocr_confidence IS NOT NULL AND NOT isnan(ocr_confidence) GROUP BY 1",
    "d20_pass_rates": _CALL + "SELECT tool_name, count(*) FILTER (client_id <> 'unknown') AS passed, count(*) AS total FROM calls GROUP BY 1",
    "e2_no_repeats": STORED + "SELECT event_id, modality, event_type FROM (SELECT *, lag(event_type) OVER w AS b FROM stored WINDOW w AS (PARTITION BY modality ORDER BY timestamp, event_id)) WHERE b IS DISTINCT FROM event_type",
    "e5_idle_wakes": _ACT + "SELECT id, gap, CASE WHEN gap >= 60 THEN 30.0 ELSE 5.0 END AS interval FROM (SELECT id, timestamp - lag(timestamp) OVER (PARTITION BY monitor_index ORDER BY timestamp, id) AS gap FROM act WHERE timestamp IS NOT NULL) WHERE gap >= 30",
    "e6_focus_changes": _ACT + "SELECT id, window_title, b AS previous_title FROM (SELECT *, lag(window_title) OVER (PARTITION BY monitor_index ORDER BY timestamp, id) AS b FROM act WHERE window_title <> '') WHERE b <> window_title",
    "g1_typing_bursts": STORED + """, k AS (SELECT modality, CAST(round(timestamp * 1e6) AS BIGINT) AS us, event_type = 'scroll' AS back, event_type = 'drag' AS sel FROM stored),
      m AS (SELECT *, CASE WHEN us - lag(us) OVER w <= 30000000 THEN 0 ELSE 1 END AS b FROM k WINDOW w AS (PARTITION BY modality ORDER BY us)), s AS (SELECT *, sum(b) OVER (PARTITION BY modality ORDER BY us ROWS UNBOUNDED PRECEDING) AS nth FROM m)
      SELECT modality, count(*) FILTER (NOT back AND NOT sel) AS char_count, greatest(1, count(*) FILTER (NOT back AND NOT sel) // 5) AS word_count, ((max(us) + 30000000) // 1000) - (min(us) // 1000) AS duration_ms, count(*) FILTER (back) AS backspace_count, bool_or(sel AND NOT back) AS has_selection FROM s GROUP BY modality, nth HAVING count(*) FILTER (NOT back AND NOT sel) >= 3""",
    "g7_watch_windows": STORED + ", both_ AS (SELECT event_id, timestamp, CASE WHEN event_type = 'paste_detected' THEN 1 ELSE 0 END AS kind FROM stored WHERE event_type IN ('paste_detected', 'window_focus')) SELECT event_id, timestamp AS opened, least(timestamp + 600, coalesce(next, timestamp + 600)) AS closed FROM (SELECT *, lead(timestamp) OVER (ORDER BY timestamp, kind, event_id) AS next FROM both_) WHERE kind = 1",
}
