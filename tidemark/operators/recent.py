"""Scans, filters, top-k and time lookups over the event, activity, clipboard and call logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Bounds of the arguments that callers give.
LIMITS = {"count": (1, 50), "limit": (1, 500), "seconds": (1, 86_400), "minutes": (1, 10_080), "hours": (0.1, 168)}
NO_DATA_DIFF = 100.0


def clamp(name: str, value: float) -> float:
    """An argument brought into its bounds."""
    low, high = LIMITS[name]
    return max(low, min(high, value))


def clamped(name: str, value: Column) -> Column:
    """As clamp, for a column of arguments; null stays null."""
    low, high = LIMITS[name]
    return F.when(value.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), value)))


def newest(df: DataFrame, limit: int, time: str = "timestamp", key: str = "event_id") -> DataFrame:
    """The newest rows, ties by key descending: a top-k without a sort of the table. Rows without time come last."""
    return df.orderBy(F.desc_nulls_last(time), F.desc(key)).limit(limit)


def recent_events(events: DataFrame, as_of: float, seconds: float = 300, modality: str | None = None, types: list[str] | None = None, limit: int = 50) -> DataFrame:
    """Events after ``as_of - seconds`` (the bound itself is out), newest first."""
    kept = events.where(F.col("timestamp") > as_of - seconds)
    kept = kept if modality is None else kept.where(F.col("modality") == modality)
    kept = kept if types is None else kept.where(F.col("event_type").isin(*types))
    return newest(kept, limit)


def around(events: DataFrame, at: float, window_seconds: float = 5) -> DataFrame:
    """Events from ``at - w`` to ``at + w``, both bounds in."""
    return events.where(F.col("timestamp").between(at - window_seconds, at + window_seconds))


def blocked(title: Column, patterns: list[str]) -> Column:
    """Does the title hold one of the patterns, in any case? Never for a missing or empty title or an empty list."""
    if not patterns:
        return F.lit(False)
    return F.coalesce(F.exists(F.array(*(F.lit(p.lower()) for p in patterns)), lambda p: F.contains(F.lower(title), p)) & (title != ""), F.lit(False))


def masked_title(title: Column, patterns: list[str]) -> Column:
    """The title, or '[BLOCKED]' where it is blocked."""
    return F.when(blocked(title, patterns), "[BLOCKED]").otherwise(title)


def contains_text(text: Column, query: str, wildcards: bool = False) -> Column:
    """Does the text hold the query, in any case? '%' and '_' are ordinary characters unless ``wildcards``."""
    if wildcards:
        return F.coalesce(text.ilike(f"%{query}%"), F.lit(False))
    return F.coalesce(F.contains(F.lower(text), F.lit(query.lower())), F.lit(False))


def live(expires: Column, as_of: float) -> Column:
    """Not expired at ``as_of``; what ends exactly then is."""
    return expires.isNull() | (expires > as_of)


def list_memories(memories: DataFrame, as_of: float, tag: str | None = None, limit: int = 50, include_expired: bool = False) -> DataFrame:
    """Memories with a tag, newest update first."""
    kept = memories if include_expired else memories.where(live(F.col("expires_at"), as_of))
    kept = kept if tag is None else kept.where(F.array_contains("tags", tag))
    return newest(kept, limit, "updated_at", "key")


def recall(hot: DataFrame, warm: DataFrame, keys: DataFrame, as_of: float) -> DataFrame:
    """(key, value, tier): each asked key from the hot tier while it lives there, else from the warm one, which knows no expiry; unknown keys give no row."""
    asked = keys.select("key").distinct()
    first = hot.where(F.col("expires_at") >= as_of).select("key", "value").withColumn("tier", F.lit("hot"))
    second = warm.select("key", "value").withColumn("tier", F.lit("warm"))
    both = first.unionByName(second).join(asked, "key", "left_semi")
    return both.groupBy("key").agg(F.min_by("value", "tier").alias("value"), F.min("tier").alias("tier"))


def latest_per_group(df: DataFrame, group: str, time: str = "timestamp") -> DataFrame:
    """The newest rows of each group, all of them on a tie. Rows without time count as oldest."""
    order = Window.partitionBy(group).orderBy(F.desc_nulls_last(time))
    return df.withColumn("__rank", F.rank().over(order)).where("__rank = 1").drop("__rank")


def nearest_row(df: DataFrame, at: float, time: str = "timestamp", key: str = "id") -> DataFrame:
    """The one row nearest in time on either side, ties to the smaller key."""
    return df.where(F.col(time).isNotNull() & ~F.isnan(time)).orderBy(F.abs(F.col(time) - at), key).limit(1)


def frames_with_diff(frames: DataFrame, activity: DataFrame, min_diff: float, count: int) -> DataFrame:
    """The last ``count`` frames in time order whose change reaches ``min_diff``; a frame no capture tells of is kept.

    Frames are (frame_path, timestamp); of several captures of one frame the smallest change counts.
    """
    diffs = activity.where("frame_path is not null").groupBy("frame_path").agg(F.min("diff_score").alias("diff_score"))
    kept = frames.join(diffs, "frame_path", "left").where(F.coalesce(F.col("diff_score") >= min_diff, F.lit(True)))
    return newest(kept, count, "timestamp", "frame_path").orderBy("timestamp", "frame_path")


def freshness(age: Column) -> Column:
    """Age in seconds in words; 'no data' for null."""
    return (
        F.when(age.isNull(), "no data")
        .when(age < 10, "just now")
        .when(age < 60, F.format_string("%ds ago", F.bround(age).cast("bigint")))
        .when(age < 3600, F.format_string("%dm ago", F.bround(age / 60).cast("bigint")))
        .otherwise(F.format_string("%.1fh ago", age / 3600))
    )


def change_level(diff: Column) -> Column:
    """How much of a screen changed, in words; null counts as static."""
    return F.when(diff >= 50, "major change").when(diff >= 10, "some change").when(diff >= 1, "minor change").otherwise("static")


def monitor_summary(monitors: DataFrame, activity: DataFrame, as_of: float) -> DataFrame:
    """One row for each monitor of (monitor_index) and latest capture: app, title, age and change; monitors without capture are unknown and wholly changed."""
    latest = latest_per_group(activity, "monitor_index").select("monitor_index", "id", "timestamp", "app_name", "window_title", "diff_score")
    joined = monitors.select("monitor_index").distinct().join(latest, "monitor_index", "left")
    diff = F.when(F.col("id").isNull(), NO_DATA_DIFF).otherwise(F.coalesce("diff_score", F.lit(0.0)))
    return joined.select(
        "monitor_index",
        "id",
        F.coalesce(F.nullif("app_name", F.lit("")), F.lit("unknown")).alias("app_name"),
        F.substring(F.coalesce("window_title", F.lit("")), 1, 80).alias("title"),
        freshness(F.lit(as_of) - F.col("timestamp")).alias("freshness"),
        change_level(diff).alias("change"),
        diff.alias("diff"),
    )


def smart_captures(summary: DataFrame) -> DataFrame:
    """Monitors worth a look: changed by at least 1 %, or unknown."""
    return summary.where("diff >= 1 or id is null")


def ocr_due(diff: Column, force: bool = False, threshold: float = 5.0) -> Column:
    """Should a frame be read? Forced, or changed enough; an unknown change is not."""
    return F.lit(True) if force else F.coalesce(diff >= threshold, F.lit(False))


def text_heavy(lines: DataFrame) -> DataFrame:
    """(frame, text, chars, confidence, kind): OCR lines (frame, nth, text, confidence) joined by line breaks; 'text' from 100 characters of mean confidence 0.7 on, else 'image'."""
    whole = lines.groupBy("frame").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "text"))), lambda x: x["text"]), "\n").alias("text"),
        F.sum(F.length("text")).alias("chars"),
        F.avg("confidence").alias("confidence"),
    )
    return whole.withColumn("kind", F.when((F.col("chars") >= 100) & (F.col("confidence") >= 0.70), "text").otherwise("image"))


def storage_kept(mode: Column, kind: Column, always_both: Column) -> Column:
    """What is kept of a frame: 'text' when it is text-heavy in mode smart or text and its app is not to keep both; else 'both' with text, 'image' without."""
    return F.when((kind == "text") & mode.isin("smart", "text") & ~F.coalesce(always_both, F.lit(False)), "text").when((mode == "visual") & (kind != "text"), "image").otherwise("both")
