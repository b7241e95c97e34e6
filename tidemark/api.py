"""The catalogue of tools by name: each takes tables and arguments and gives a DataFrame.

Tools that grab a screen or run a model take the table of what was grabbed instead. Arguments are
brought into their bounds; every tool takes the present time as ``as_of``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.functions.payload import field, indexed_text
from tidemark.operators import ingest, mining, recent, routing, search, summaries
from tidemark.plans.consolidation import consolidated

SEARCHED = ["window_title", "app_name", "text_content"]


# screen
def get_monitor_summary(monitors: DataFrame, activity: DataFrame, as_of: float) -> DataFrame:
    return recent.monitor_summary(monitors, activity, as_of)


def get_screenshot(monitors: DataFrame, activity: DataFrame, as_of: float) -> DataFrame:
    return recent.smart_captures(recent.monitor_summary(monitors, activity, as_of))


def get_recent(frames: DataFrame, activity: DataFrame, as_of: float, count: int = 3, seconds: float = 60, min_diff: float = 0.0) -> DataFrame:
    within = frames.where(F.col("timestamp") >= as_of - recent.clamp("seconds", seconds))
    return recent.frames_with_diff(within, activity, min_diff, int(recent.clamp("count", count)))


def get_screen_text(lines: DataFrame) -> DataFrame:
    return recent.text_heavy(lines)


def get_buffer_status(frames: DataFrame) -> DataFrame:
    return summaries.buffer_status(frames)


def get_activity_summary(activity: DataFrame, as_of: float, hours: float = 8) -> DataFrame:
    apps = summaries.app_summary(activity, as_of - recent.clamp("hours", hours) * 3600)
    return apps.orderBy(F.desc("n"), F.desc("last_seen"), "app_name").limit(15)


def search_history(activity: DataFrame, query: str, as_of: float, minutes: float = 60, blocklist: list[str] | None = None) -> DataFrame:
    found = search.full_text(activity, ["window_title", "app_name", "ocr_text"], query).where(F.col("timestamp") >= as_of - recent.clamp("minutes", minutes) * 60)
    return recent.newest(found, 20, "timestamp", "id").where(~recent.blocked(F.col("window_title"), blocklist or []))


def get_context_at(activity: DataFrame, minutes_ago: float, as_of: float) -> DataFrame:
    return recent.nearest_row(activity, as_of - minutes_ago * 60)


def get_clipboard_history(clipboard: DataFrame, count: int = 10) -> DataFrame:
    shown = recent.newest(clipboard, int(recent.clamp("count", count)), "timestamp", "id")
    return shown.select("id", "timestamp", F.length("text").alias("chars"), (F.regexp_count("text", F.lit("\n")) + 1).alias("lines"), F.substring("text", 1, 200).alias("preview"))


def search_clipboard(clipboard: DataFrame, query: str, as_of: float, minutes: float = 60) -> DataFrame:
    found = clipboard.where((F.col("timestamp") >= as_of - recent.clamp("minutes", minutes) * 60) & recent.contains_text(F.col("text"), query))
    return recent.newest(found, 20, "timestamp", "id")


def get_agent_stats(calls: DataFrame, as_of: float, hours: float = 24) -> DataFrame:
    return summaries.call_stats(calls, as_of - recent.clamp("hours", hours) * 3600)


def search_all_events(events: DataFrame, query: str, as_of: float, minutes: float = 30, modality: str | None = None, blocklist: list[str] | None = None) -> DataFrame:
    found = search.full_text(events.withColumn("text_content", indexed_text(F.col("payload"))), SEARCHED, query)
    kept = found.where(F.col("timestamp") > as_of - recent.clamp("minutes", minutes) * 60)
    kept = kept if modality is None else kept.where(F.col("modality") == modality)
    shown = search.best(kept, 50, "event_id").where(~recent.blocked(F.col("window_title"), blocklist or []))
    return search.best(shown, 25, "event_id").withColumn("snippet", T.snippet(F.col("text_content"), 150))


def get_event_timeline(events: DataFrame, as_of: float, minutes: float = 5, modality: str | None = None, blocklist: list[str] | None = None) -> DataFrame:
    top = recent.recent_events(events, as_of, recent.clamp("minutes", minutes) * 60, modality, limit=100)
    p = F.col("payload")
    extras = F.concat_ws(
        "  ",
        *(F.when(field(p, name, kind="double") != 0, F.format_string(form, field(p, name, kind="double") * scale)) for name, form, scale in (("diff_score", "diff=%.1f%%", 100), ("ocr_confidence", "ocr_conf=%.0f%%", 100), ("wpm", "wpm=%.0f", 1), ("word_count", "words=%.0f", 1))),
    )
    return top.where(~recent.blocked(F.col("window_title"), blocklist or [])).orderBy("timestamp", "event_id").limit(50).withColumn("extras", extras)


# projects
def identify_project(texts: DataFrame, projects: DataFrame, key: str = "id", top: int = 3) -> DataFrame:
    return routing.routed(texts, projects, key, top)


def get_active_project(windows: DataFrame, root: str, projects: list[tuple[str, list[str]]]) -> DataFrame:
    return windows.withColumn("active", routing.active_project(F.col("cwd"), F.col("window_title"), root, projects))


def list_projects(projects: DataFrame) -> DataFrame:
    return projects.select("name", "overview", "aliases").orderBy("name")


def get_project_context(projects: DataFrame, name: str) -> DataFrame:
    return projects.where(F.lower("name") == name.lower())


def route_to_journal(texts: DataFrame, projects: DataFrame, key: str = "id") -> DataFrame:
    return routing.best_project(texts, projects, key).join(texts, key)


# voice
def get_recent_transcriptions(events: DataFrame, as_of: float, minutes: float = 30, limit: int = 10) -> DataFrame:
    shown = recent.recent_events(events, as_of, recent.clamp("minutes", minutes) * 60, "voice", ["transcription"], int(recent.clamp("limit", limit)))
    p = F.col("payload")
    return shown.select("event_id", "timestamp", field(p, "raw_transcript").alias("raw"), field(p, "transcript").alias("clean"), F.coalesce(field(p, "fix_last", kind="boolean"), F.lit(False)).alias("fix_last"))


def get_voice_stats(events: DataFrame, as_of: float, hours: float = 8) -> DataFrame:
    return summaries.voice_stats(events, as_of - recent.clamp("hours", hours) * 3600)


def get_vocabulary(vocabulary: DataFrame, learned_only: bool = False) -> DataFrame:
    return mining.layered(vocabulary.where("layer = 'learned'") if learned_only else vocabulary).orderBy("key")


def learn_from_session(dictations: DataFrame) -> DataFrame:
    return mining.learned_phrases(dictations)


def rebuild_context_vocabulary(project_files: DataFrame) -> DataFrame:
    from tidemark.sources.files import context_vocabulary

    return context_vocabulary(project_files)


def consolidate_learning(events: DataFrame, clips: DataFrame, vocabulary: DataFrame, as_of: float) -> tuple[DataFrame, DataFrame]:
    return consolidated(events, clips, vocabulary, as_of)


def check_corrections(events: DataFrame, as_of: float, hours: float = 72) -> DataFrame:
    return summaries.escalations(events, as_of - recent.clamp("hours", hours) * 3600)


# touch
def get_recent_touch_events(events: DataFrame, as_of: float, seconds: float = 300, types: tuple[str, ...] = ("typing_burst", "click", "scroll", "drag", "correction_detected")) -> DataFrame:
    return recent.recent_events(events, as_of, recent.clamp("seconds", seconds), None, list(types))


def get_touch_stats(events: DataFrame, as_of: float, hours: float = 8) -> DataFrame:
    return summaries.touch_stats(events, as_of - recent.clamp("hours", hours) * 3600)


def get_correction_history(events: DataFrame, limit: int = 20) -> DataFrame:
    return recent.newest(events.where("event_type = 'correction_detected'"), int(recent.clamp("limit", limit)))


# memory
def memory_store(memories: DataFrame, incoming: DataFrame, quota: int = 50_000) -> DataFrame:
    return ingest.upsert_memories(memories.unionByName(ingest.within_quota(memories, incoming, quota)))


def memory_recall(hot: DataFrame, warm: DataFrame, keys: DataFrame, as_of: float) -> DataFrame:
    return recent.recall(hot, warm, keys, as_of)


def memory_search(memories: DataFrame, query: str, vector: list[float] | None, as_of: float, mode: str = "hybrid", limit: int = 20) -> DataFrame:
    return search.search_memories(memories, query, vector, as_of, mode, limit)


def memory_semantic_search(memories: DataFrame, vector: list[float], as_of: float, limit: int = 20) -> DataFrame:
    return search.semantic(memories, vector, as_of, limit)


def memory_list(memories: DataFrame, as_of: float, tag: str | None = None, limit: int = 50) -> DataFrame:
    return recent.list_memories(memories, as_of, tag, int(recent.clamp("limit", limit)))


def memory_forget(memories: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    return ingest.forget(memories, keys)


def memory_stats(tiers: dict[str, DataFrame]) -> DataFrame:
    return summaries.tier_stats(tiers)
