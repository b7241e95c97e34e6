"""Queries for sources, sinks, pointer and content rules, queues and smaller text functions."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.payload import field
from tidemark.operators import changes, mining, queues, recent, search, summaries
from tidemark.operators.ingest import upsert_memories
from tidemark.plans.durable import checkpoint_dir, stream_table, table
from tidemark.queries.base import ACTIVITY, BRIEF, CALLS, CLIPBOARD, MEMORIES, SAID, STORED, clock, once, stored
from tidemark.queries.oracles import debounced_sql
from tidemark.queries.text import _TAGGED, _bm25_sql
from tidemark.sources import files
from tidemark.streaming import events as streaming


def _scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the checkpoints, which all executors share."""
    return f"{checkpoint_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"


def a2_event_store(spark: SparkSession, folder: str) -> DataFrame:
    """Deliveries in two appends, the second one holding all of the first again; a day of it read back."""
    now, raw = clock(spark, folder), table(spark, folder, "spine_events")
    store = files.EventStore(spark, _scratch(spark, "events"))
    store.append(raw.where("pmod(xxhash64(event_id), 2) = 0"), now)
    store.append(raw, now)
    return store.read(since=now - 86_400).select(*BRIEF)


def a4_fan_out(spark: SparkSession, folder: str) -> DataFrame:
    """A stream of all deliveries handed to two sinks, one of which fails; what the other one got."""
    target, now = _scratch(spark, "fan-out"), clock(spark, folder)
    deliveries = stream_table(spark, folder, "spine_events")
    spark.createDataFrame([], "event_id string, modality string").write.parquet(f"{target}/kept")  # a table of no files has no batch

    def fails(batch: DataFrame, number: int) -> None:
        raise ValueError("a sink that fails")

    def keeps(batch: DataFrame, number: int) -> None:
        batch.select("event_id", "modality").write.mode("append").parquet(f"{target}/kept")

    valid = streaming.valid_stream(deliveries, None).where(F.col("timestamp") <= now + 60)
    streaming.fan_out(valid, {"broken": fails, "kept": keeps}, f"{target}/offsets").awaitTermination()
    return spark.read.parquet(f"{target}/kept").groupBy("modality").agg(F.count("*").alias("n"))


def a6_appended_logs(spark: SparkSession, folder: str) -> DataFrame:
    """Clipboard rows and tool calls appended to their logs, read back by day."""
    out = []
    for name in ("clipboard", "mcp_calls"):
        path, rows = _scratch(spark, name), once(spark, folder, name)
        files.append_log(rows.where("id % 2 = 0"), path)
        files.append_log(rows.where("id % 2 = 1"), path)
        out.append(spark.read.parquet(path).groupBy("day").agg(F.count("*").alias("n")).select(F.lit(name).alias("log"), F.col("day").cast("string").alias("day"), "n"))
    return out[0].unionByName(out[1])


def a13_frame_names(spark: SparkSession, folder: str) -> DataFrame:
    named = once(spark, folder, "activity", ("id", "frame_path")).select("id", files.frame_name(F.col("frame_path")).alias("f"))
    return named.where("f is not null").select("id", "f.timestamp", "f.monitor_index", "f.kind")


def a15_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of each hour appended as JSON lines beside a broken line, read back."""
    path, said = _scratch(spark, "metrics"), F.count_if(F.col("event_type") == "transcription")
    hour = F.floor(F.col("timestamp") / 3600).cast("string").alias("date")
    files.append_metrics(stored(spark, folder, columns=BRIEF).groupBy(hour).agg(said.alias("vocab_user_size")), path)
    spark.range(1).select(F.lit("{broken").alias("value")).write.mode("append").text(path)
    return files.metrics_history(spark, path).where("date is not null").select("date", "vocab_user_size")


def a17_backup(spark: SparkSession, folder: str) -> DataFrame:
    """A version written twice: the second copy does not replace the first."""
    rows = upsert_memories(table(spark, folder, "memories")).select("key", "value")
    path = _scratch(spark, "backup")
    files.backed_up(rows, path, "one")
    return spark.read.parquet(files.backed_up(rows.limit(0), path, "one"))


def a18_workload(spark: SparkSession, folder: str) -> DataFrame:
    return files.synthetic_events(spark, 4.0, 1_700_000_000.0, 3).groupBy("modality", "event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("ids"))


def b12_kept_frames(spark: SparkSession, folder: str) -> DataFrame:
    now = clock(spark, folder)
    frames = once(spark, folder, "activity", ("id", "frame_path")).select("id", files.frame_name(F.col("frame_path"))["timestamp"].alias("timestamp"))
    return files.kept_frames(frames, now, 86_400.0).select("id")


def b18_clamped(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("call_count")
    return once(spark, folder, "mcp_calls").select("id", *(recent.clamped(name, n).cast("double").alias(name) for name in ("count", "limit", "seconds", "minutes", "hours")))


def d19_app_means(spark: SparkSession, folder: str) -> DataFrame:
    return summaries.app_means(once(spark, folder, "activity"), "ocr_confidence", "diff_score").select("app_name", "n", F.round("mean_ocr_confidence", 9).alias("confidence"), F.round("mean_diff_score", 9).alias("diff"))


def e7_monitor_crossings(spark: SparkSession, folder: str) -> DataFrame:
    at = F.col("timestamp").cast("bigint")
    moves = once(spark, folder, "activity").select("id", "timestamp", "monitor_index", F.lit("mouse").alias("pointer"), ((at * 7) % 1900).alias("x"), ((at * 13) % 1000).alias("y"))
    return changes.monitor_crossings(moves, "pointer").select("id", "from_monitor", "to_monitor")


def f7_dictionary(spark: SparkSession, folder: str) -> DataFrame:
    """The layered vocabulary as a sorted dictionary: each key with its place."""
    layered = mining.layered(table(spark, folder, "memories").select(F.lit("user").alias("layer"), F.split("key", ":")[0].alias("key"), "value"))
    return search.ranked(layered, "key").select("key", "value", F.col("rank").alias("place"))


def g2_replayed(spark: SparkSession, folder: str) -> DataFrame:
    """Window titles typed with an 'e' for each backspace."""
    typed = once(spark, folder, "activity", ("id", "window_title")).select("id", F.posexplode(F.split("window_title", "")).alias("nth", "key_char")).where("key_char <> ''")
    return changes.replayed(typed.withColumn("is_backspace", F.col("key_char") == "e"), "id")


def g5_changed_frames(spark: SparkSession, folder: str) -> DataFrame:
    frames = once(spark, folder, "activity").where("timestamp is not null").select("id", "monitor_index", "timestamp", F.array(F.coalesce("diff_score", F.lit(0.0))).alias("pixels"))
    return changes.changed_frames(frames, 10.0).select("id", F.round("diff", 6).alias("diff"))


def g9_new_content(spark: SparkSession, folder: str) -> DataFrame:
    return changes.without_repeated_content(once(spark, folder, "clipboard").where("timestamp is not null"), "text", 3600.0).select("id")


def g10_queue(spark: SparkSession, folder: str) -> DataFrame:
    """Captures of each monitor before a worker that takes ten minutes for one: how many are dropped."""
    seen = queues.bounded_queue(once(spark, folder, "activity").select("id", "timestamp", "monitor_index"), "monitor_index", 600.0)
    return seen.groupBy("monitor_index").agg(F.count("*").alias("n"), F.count_if(~F.col("accepted")).alias("dropped"))


def g11_drags(spark: SparkSession, folder: str) -> DataFrame:
    at, kind = F.col("timestamp").cast("bigint"), F.when(F.col("event_type") == "click", "press").otherwise("release")
    moves = stored(spark, folder, columns=BRIEF).where("event_type in ('click', 'drag', 'scroll')")
    return changes.drags(moves.select(F.col("event_id").alias("id"), kind.alias("kind"), (at % 1900).alias("x"), (at % 1000).alias("y"), "timestamp", F.col("modality").alias("button"))).select("id", F.round("distance", 6).alias("distance"))


def g12_tails(spark: SparkSession, folder: str) -> DataFrame:
    frames = once(spark, folder, "activity").select("app_name", "timestamp", F.col("diff_score").alias("rms"))
    return queues.tail_ends(frames, "app_name", 50.0, 600.0, 500_000.0)


def i8_camel_parts(spark: SparkSession, folder: str) -> DataFrame:
    words = table(spark, folder, "documents").select(F.explode(T.camel_words(F.col("text"))).alias("word")).distinct()
    return words.select("word", F.array_join(F.array_sort(T.camel_parts(F.col("word"))), ",").alias("parts"))


def i9_sections(spark: SparkSession, folder: str) -> DataFrame:
    """Sections and lists of Markdown made from each document's source, language and text."""
    flat = F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")
    value = F.concat(F.lit("# x\n\n## Overview\n\n"), flat, F.lit("\n\n## Goals\n- keep "), F.col("source"), F.lit("\n- abc\n* to\n\n## Other\n- none\n"))
    read = table(spark, folder, "documents").select("doc_id", T.section(value, "Overview").alias("overview"), T.bullets(T.section(value, "Goals")).alias("goals"))
    return read.select("doc_id", "overview", F.array_join("goals", "|").alias("goals"))


def i12_domains(spark: SparkSession, folder: str) -> DataFrame:
    found = table(spark, folder, "documents").select(F.explode(F.concat(F.transform(T.domains(F.col("text")), lambda d: F.concat(F.lit("domain "), d)), F.transform(T.aliases(F.col("text")), lambda a: F.concat(F.lit("alias "), a)))).alias("name"))
    return found.groupBy("name").agg(F.count("*").alias("n"))


def i18_unlike_words(spark: SparkSession, folder: str) -> DataFrame:
    p = F.col("payload")
    fixed = stored(spark, folder, columns=SAID).where("event_type = 'correction_detected'").select("event_id", field(p, "original_word", "original_text").alias("o"), field(p, "corrected_word", "corrected_text").alias("c")).where("o <> '' and c <> ''")
    return fixed.select("event_id", T.unlike_short_words(F.col("o"), F.col("c")).alias("unlike"))


def i29_redundant(spark: SparkSession, folder: str) -> DataFrame:
    layer = F.element_at(F.array(F.lit("user"), F.lit("learned"), F.lit("context")), (F.pmod(F.col("id"), F.lit(3)) + 1).cast("int"))
    rows = table(spark, folder, "memories").select("id", layer.alias("layer"), F.split("key", ":")[0].alias("key"), "value")
    return mining.redundant_context(rows).select("id", "key")


def i37_audio(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select("doc_id", T.audio_seconds(F.col("n_chars") * 1000).alias("seconds"))


def i38_context_names(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "documents").select(F.explode(T.context_names(F.col("text"))).alias("name"))
    return names.groupBy("name").agg(F.count("*").alias("docs"))


def j8_keyword_mode(spark: SparkSession, folder: str) -> DataFrame:
    memories = upsert_memories(table(spark, folder, "memories")).withColumn("tags_text", F.array_join("tags", " "))
    return search.search_memories(memories, "schedule OR budget", None, clock(spark, folder), "hybrid", 30).select("key", F.round("score", 6).alias("score"))


def j12_pooled(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "memories").where("size(embedding) = 128 and not exists(embedding, x -> x is null or isnan(x))")
    tokens, mask = F.array("embedding", F.reverse("embedding"), "embedding"), F.array(F.lit(1), (F.col("id") % 2).cast("int"), F.lit(0))
    pooled = rows.select("id", "updated_at", search.mean_pooled(tokens, mask).alias("v"))
    return pooled.select("id", "updated_at", F.round(F.get("v", F.lit(0)), 5).alias("first"), F.round(F.get("v", F.lit(127)), 5).alias("last"))


def l_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Tools of the catalogue called by name over the stored tables."""
    from tidemark import api

    now, events = clock(spark, folder), stored(spark, folder)
    calls = {
        "get_voice_stats": api.get_voice_stats(events, now, 24).select(F.col("dictations").alias("n")),
        "get_touch_stats": api.get_touch_stats(events, now, 24).select(F.col("bursts").alias("n")),
        "get_recent_touch_events": api.get_recent_touch_events(events, now, 86_400).agg(F.count("*").alias("n")),
        "get_correction_history": api.get_correction_history(events, 50).agg(F.count("*").alias("n")),
    }
    out = None
    for name, df in calls.items():
        named = df.select(F.lit(name).alias("tool"), F.col("n").cast("bigint").alias("n"))
        out = named if out is None else out.unionByName(named)
    return out


_NAMES = """a2_event_store a4_fan_out a6_appended_logs a13_frame_names a15_metrics a17_backup a18_workload b12_kept_frames b18_clamped d19_app_means e7_monitor_crossings f7_dictionary g2_replayed g5_changed_frames
g9_new_content g10_queue g11_drags g12_tails i8_camel_parts i9_sections i12_domains i18_unlike_words i29_redundant i37_audio i38_context_names j8_keyword_mode j12_pooled l_catalogue"""
QUERIES = {name: globals()[name] for name in _NAMES.split()}

_ACT, _CLIP, _MEM, _CALL = STORED + ", " + ACTIVITY, STORED + ", " + CLIPBOARD, STORED + ", " + MEMORIES, STORED + ", " + CALLS
_CAMEL = r"'\b([A-Z][a-z]+(?:[A-Z][a-z]+)+)\b'"
_FRAME = r"""f AS (SELECT id, regexp_extract(frame_path, '([^/]*)$', 1) AS name FROM act), named AS (SELECT id, CAST(regexp_extract(name, '^(\d{1,18})(_m\d+)?\.(jpg|txt)$', 1) AS DOUBLE) / 1000 AS timestamp,
 CASE WHEN regexp_matches(name, '^\d+_m\d{1,6}\.') THEN CAST(regexp_extract(name, '^\d+_m(\d{1,6})\.', 1) AS INT) ELSE 0 END AS monitor_index, regexp_extract(name, '\.(jpg|txt)$', 1) AS kind FROM f WHERE regexp_matches(name, '^\d{1,18}(_m\d+)?\.(jpg|txt)$'))"""
_FIX = "coalesce(p->>'$.original_word', p->>'$.original_text') AS o, coalesce(p->>'$.corrected_word', p->>'$.corrected_text') AS c"
_CHARS = lambda w: f"list_distinct(list_filter(string_split({w}, ''), lambda x: x <> ''))"
ORACLES = {
    "a2_event_store": STORED + "SELECT event_id, timestamp, modality, event_type FROM stored, clock WHERE timestamp >= now - 86400",
    "a4_fan_out": STORED.split(",\nstored")[0] + " SELECT modality, count(*) AS n FROM spine_events, clock WHERE event_id <> '' AND timestamp > 0 AND timestamp < 1e11 AND NOT isnan(timestamp) AND timestamp <= now + 60 AND " + STORED.split("now + 60 AND ")[1].split(") WHERE rn")[0] + " GROUP BY 1",
    "a6_appended_logs": _CLIP + ", " + CALLS + ", both_ AS (SELECT 'clipboard' AS log, timestamp FROM clip UNION ALL SELECT 'mcp_calls', timestamp FROM calls) SELECT log, strftime(make_timestamp(CAST(floor(timestamp * 1000000) AS BIGINT)), '%Y-%m-%d') AS day, count(*) AS n FROM both_ WHERE timestamp IS NOT NULL AND NOT isnan(timestamp) GROUP BY 1, 2",
    "a13_frame_names": _ACT + ", " + _FRAME + " SELECT * FROM named",
    "a15_metrics": STORED + "SELECT CAST(CAST(floor(timestamp / 3600) AS BIGINT) AS VARCHAR) AS date, count(*) FILTER (event_type = 'transcription') AS vocab_user_size FROM stored GROUP BY 1",
    "a17_backup": "WITH " + MEMORIES + " SELECT key, value FROM mem",
    "a18_workload": "SELECT * FROM (VALUES ('sight', 'screen_capture', 2057, 2057), ('voice', 'transcription', 40, 40), ('keys', 'typing_burst', 240, 240), ('flow', 'click', 800, 800), ('clipboard', 'clipboard_change', 60, 60), ('sight', 'ocr_result', 20, 20), ('voice', 'speech_end', 20, 20), ('clipboard', 'paste_detected', 20, 20), ('keys', 'correction_detected', 20, 20)) t(modality, event_type, n, ids)",
    "b12_kept_frames": _ACT + ", " + _FRAME + " SELECT id FROM named, clock WHERE timestamp >= now - 86400",
    "b18_clamped": _CALL + "SELECT id, " + ", ".join(f"CASE WHEN call_count IS NOT NULL THEN CAST(greatest({low}, least({high}, call_count)) AS DOUBLE) END AS {name if name not in ('limit',) else chr(34) + name + chr(34)}" for name, (low, high) in recent.LIMITS.items()) + " FROM calls",
    "d19_app_means": _ACT + "SELECT coalesce(nullif(app_name, ''), 'unknown') AS app_name, count(*) AS n, round(avg(ocr_confidence) FILTER (NOT isnan(ocr_confidence)), 9) AS confidence, round(avg(diff_score) FILTER (NOT isnan(diff_score)), 9) AS diff FROM act GROUP BY 1",
    "e7_monitor_crossings": _ACT + """, m AS (SELECT id, timestamp, monitor_index, (CAST(trunc(timestamp) AS BIGINT) * 7) % 1900 AS x, (CAST(trunc(timestamp) AS BIGINT) * 13) % 1000 AS y FROM act WHERE timestamp IS NOT NULL AND monitor_index IS NOT NULL),
      s AS (SELECT *, sqrt(power(x - lag(x) OVER w, 2) + power(y - lag(y) OVER w, 2)) AS step, first(monitor_index) OVER w AS first_monitor FROM m WINDOW w AS (ORDER BY timestamp, id)),
      j AS (SELECT id, monitor_index AS to_monitor, coalesce(lag(monitor_index) OVER (ORDER BY timestamp, id), first_monitor) AS from_monitor FROM s WHERE step >= 200) SELECT id, from_monitor, to_monitor FROM j WHERE from_monitor <> to_monitor""",
    "f7_dictionary": "SELECT key, min(value) AS value, row_number() OVER (ORDER BY key) AS place FROM (SELECT lower(trim(split_part(key, ':', 1))) AS key, value FROM memories) WHERE key <> '' AND value IS NOT NULL GROUP BY key",
    "g2_replayed": _ACT + ", k AS (SELECT id, list_filter(string_split(window_title, ''), lambda x: x <> '') AS k FROM act WHERE window_title <> '') SELECT id, list_reduce(k, lambda t, x: CASE WHEN x = 'e' THEN substr(t, 1, greatest(length(t) - 1, 0)) ELSE t || x END, '') AS text FROM k",
    "g5_changed_frames": STORED.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + ACTIVITY + """, s AS MATERIALIZED (SELECT id, monitor_index AS m, coalesce(diff_score, 0.0) AS v, row_number() OVER (PARTITION BY monitor_index ORDER BY timestamp, id) AS n FROM act WHERE timestamp IS NOT NULL),
      w AS (SELECT m, n, id, v AS held, CAST(100 AS DOUBLE) AS diff, true AS kept FROM s WHERE n = 1 UNION ALL SELECT s.m, s.n, s.id, CASE WHEN abs(s.v - held) / 255 * 100 >= 10 THEN s.v ELSE held END, abs(s.v - held) / 255 * 100, abs(s.v - held) / 255 * 100 >= 10 FROM w JOIN s ON s.m IS NOT DISTINCT FROM w.m AND s.n = w.n + 1)
      SELECT id, round(diff, 6) AS diff FROM w WHERE kept""",
    "g9_new_content": STORED.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + CLIPBOARD + ", " + debounced_sql("clip", "text", "id", 3600) + " SELECT k AS id FROM acc UNION ALL SELECT id FROM clip WHERE text IS NULL AND timestamp IS NOT NULL",
    "g10_queue": STORED.replace("WITH ", "WITH RECURSIVE ", 1) + ", " + ACTIVITY + """, s AS MATERIALIZED (SELECT id, monitor_index AS m, timestamp AS t, row_number() OVER (PARTITION BY monitor_index ORDER BY timestamp, id) AS n FROM act WHERE timestamp IS NOT NULL AND monitor_index IS NOT NULL),
      w AS (SELECT m, n, t + 600 AS busy, true AS ok FROM s WHERE n = 1 UNION ALL SELECT s.m, s.n, CASE WHEN busy - s.t <= 6000 THEN greatest(busy, s.t) + 600 ELSE busy END, busy - s.t <= 6000 FROM w JOIN s ON s.m = w.m AND s.n = w.n + 1)
      SELECT m AS monitor_index, count(*) AS n, count(*) FILTER (NOT ok) AS dropped FROM w GROUP BY m""",
    "g11_drags": STORED + """, m AS (SELECT event_id AS id, modality, timestamp, event_type = 'click' AS press, CAST(trunc(timestamp) AS BIGINT) % 1900 AS x, CAST(trunc(timestamp) AS BIGINT) % 1000 AS y FROM stored WHERE event_type IN ('click', 'drag', 'scroll')),
      n AS (SELECT id, press, lead(press) OVER w AS next, sqrt(power(lead(x) OVER w - x, 2) + power(lead(y) OVER w - y, 2)) AS distance FROM m WINDOW w AS (PARTITION BY modality ORDER BY timestamp, id)) SELECT id, round(distance, 6) AS distance FROM n WHERE press AND NOT next AND distance > 20""",
    "g12_tails": _ACT + """, q AS (SELECT app_name, timestamp AS t, coalesce(diff_score < 50, false) AS quiet FROM act WHERE app_name IS NOT NULL AND timestamp IS NOT NULL),
      g AS (SELECT *, max(t) FILTER (NOT quiet) OVER (PARTITION BY app_name ORDER BY t) AS loud FROM q), r AS (SELECT app_name, min(t) AS since, max(t) AS until FROM g WHERE quiet GROUP BY app_name, loud),
      s AS (SELECT app_name, min(since) + 600 AS silence FROM r WHERE until - since >= 600 GROUP BY 1), f AS (SELECT app_name, min(t) + 500000 AS latest FROM q GROUP BY 1)
      SELECT app_name, CASE WHEN silence <= latest THEN silence ELSE latest END AS ended_at, coalesce(silence <= latest, false) AS silent FROM f LEFT JOIN s USING (app_name)""",
    "i8_camel_parts": rf"SELECT word, array_to_string(list_sort(list_distinct(list_concat([lower(word)], list_transform(list_filter(regexp_split_to_array(regexp_replace(word, '([a-z])([A-Z])', '\1 \2', 'g'), ' '), lambda x: length(x) > 2), lambda x: lower(x))))), ',') AS parts FROM (SELECT DISTINCT unnest(regexp_extract_all(text, {_CAMEL}, 1)) AS word FROM documents)",
    "i9_sections": r"SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '[ \t\n\x0b\f\r]+', ' ', 'g'), '^ ', ''), ' $', '') AS overview, 'keep ' || source || '|abc|to' AS goals FROM documents",
    "i12_domains": rf"SELECT name, count(*) AS n FROM (SELECT 'domain ' || unnest(list_distinct(list_transform(regexp_extract_all(text, '\b[\w-]+\.(?:com|io|dev|ai|app|co)\b'), lambda x: lower(x)))) AS name FROM documents UNION ALL SELECT 'alias ' || unnest(list_distinct(list_concat(regexp_extract_all(text, '{T.FORMER[0]}', 1), regexp_extract_all(text, '{T.FORMER[1]}', 1)))) FROM documents) GROUP BY 1",
    "i18_unlike_words": STORED + f", x AS (SELECT event_id, {_FIX} FROM stored WHERE event_type = 'correction_detected') SELECT event_id, length(o) <= 6 AND length(c) <= 6 AND len(list_intersect({_CHARS('o')}, {_CHARS('c')})) < 0.4 * greatest(length(o), length(c)) AS \"unlike\" FROM x WHERE o <> '' AND c <> ''",
    "i29_redundant": "WITH r AS (SELECT id, id % 3 AS layer, split_part(key, ':', 1) AS key FROM memories) SELECT id, key FROM r WHERE layer = 2 AND key IN (SELECT key FROM r WHERE layer < 2)",
    "i37_audio": "SELECT doc_id, n_chars * 1000 / 32000.0 AS seconds FROM documents",
    "i38_context_names": rf"SELECT name, count(*) AS docs FROM (SELECT unnest(list_distinct(list_concat(list_filter(regexp_extract_all(substr(text, 1, 2000), {_CAMEL}, 1), lambda x: length(x) >= 6), regexp_extract_all(substr(text, 1, 2000), '[""'']([A-Z][a-zA-Z]{{4,}})[""'']', 1)))) AS name FROM documents) GROUP BY 1",
    "j8_keyword_mode": _MEM + _bm25_sql(_TAGGED, "key", ["key", "value", "tags_text"], {"a": "x = 'schedule'", "b": "x = 'budget'"}, "a > 0 OR b > 0") + "SELECT key, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, key LIMIT 30",
    "j12_pooled": """SELECT id, updated_at, coalesce(round(v[1] / nullif(n, 0), 5), 0) AS first, coalesce(round(v[128] / nullif(n, 0), 5), 0) AS last FROM (SELECT *, sqrt(list_dot_product(v, v)) AS n FROM (SELECT id, updated_at, list_transform(range(1, 129), lambda i: CAST(embedding[i] AS DOUBLE) + CASE WHEN id % 2 = 1 THEN CAST(embedding[129 - i] AS DOUBLE) ELSE 0 END) AS v FROM memories WHERE len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x))) = 0))""",
    "l_catalogue": STORED + """SELECT 'get_voice_stats' AS tool, count(*) FILTER (timestamp > now - 86400 AND modality = 'voice' AND event_type = 'transcription') AS n FROM stored, clock UNION ALL SELECT 'get_touch_stats', count(*) FILTER (timestamp > now - 86400 AND event_type = 'typing_burst') FROM stored, clock
      UNION ALL SELECT 'get_recent_touch_events', least(50, count(*) FILTER (timestamp > now - 86400 AND event_type IN ('typing_burst','click','scroll','drag','correction_detected'))) FROM stored, clock UNION ALL SELECT 'get_correction_history', least(50, count(*) FILTER (event_type = 'correction_detected')) FROM stored""",
}
