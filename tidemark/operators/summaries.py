"""Aggregations over the logs: activity, calls, voice, touch, memory roll-ups, metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.payload import corrected_word, field, original_word

ROLLUP_SECONDS = 900


def app_summary(activity: DataFrame, since: float) -> DataFrame:
    """(app_name, n, last_seen, share): captures of each app from ``since`` on (bound in), missing apps as 'unknown', and their percentage of all."""
    recent = activity.where(F.col("timestamp") >= since)
    counts = recent.groupBy(F.coalesce(F.nullif("app_name", F.lit("")), F.lit("unknown")).alias("app_name")).agg(F.count("*").alias("n"), F.max("timestamp").alias("last_seen"))
    return counts.withColumn("share", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()))


def recent_titles(rows: DataFrame, since: float, limit: int = 20, skip: list[str] | None = None, min_chars: int = 1) -> DataFrame:
    """(window_title, last_seen): distinct titles by recency, ties by title; missing, skipped and short ones left out."""
    kept = rows.where((F.col("timestamp") >= since) & (F.length("window_title") >= min_chars))
    kept = kept.where(~F.lower("window_title").isin([s.lower() for s in skip])) if skip else kept
    return kept.groupBy("window_title").agg(F.max("timestamp").alias("last_seen")).orderBy(F.desc("last_seen"), "window_title").limit(limit)


def call_stats(calls: DataFrame, since: float) -> DataFrame:
    """(client_id, tool_name, calls, first_call, last_call), with one row for each client (tool null) and one for all (both null); missing clients are 'unknown'."""
    recent = calls.where(F.col("timestamp") >= since).select(F.coalesce("client_id", F.lit("unknown")).alias("client_id"), F.coalesce("tool_name", F.lit("")).alias("tool_name"), "timestamp")
    return recent.rollup("client_id", "tool_name").agg(F.count("*").alias("calls"), F.min("timestamp").alias("first_call"), F.max("timestamp").alias("last_call"))


def voice_stats(events: DataFrame, since: float) -> DataFrame:
    """One row: dictations after ``since``, their seconds, how many were corrected (raw and clean differ, null-safe) and cleaned up."""
    p = F.col("payload")
    spoken = events.where((F.col("timestamp") > since) & (F.col("modality") == "voice") & (F.col("event_type") == "transcription"))
    rows = spoken.select(field(p, "duration_seconds", kind="double").alias("s"), field(p, "raw_transcript").alias("raw"), field(p, "transcript").alias("clean"), field(p, "cleanup_applied", kind="boolean").alias("cleaned"))
    changed = F.count_if(~F.col("raw").eqNullSafe(F.col("clean")))
    return rows.agg(
        F.count("*").alias("dictations"),
        F.coalesce(F.sum("s"), F.lit(0.0)).alias("seconds"),
        F.avg("s").alias("mean_seconds"),
        changed.alias("corrected"),
        F.coalesce(F.try_divide(changed * 100.0, F.count("*")), F.lit(0.0)).alias("corrected_percent"),
        F.count_if("cleaned").alias("cleanups"),
    )


def touch_stats(events: DataFrame, since: float) -> DataFrame:
    """One row: typing bursts, characters, backspaces, mean speed over bursts with one, clicks, scrolls, drags and corrections after ``since``."""
    p = F.col("payload")
    number = lambda name: field(p, name, kind="double")
    of = lambda kind: F.col("event_type") == kind
    recent = events.where(F.col("timestamp") > since).select("event_type", number("char_count").alias("chars"), number("backspace_count").alias("back"), number("wpm").alias("wpm"))
    burst = of("typing_burst")
    total = lambda name: F.coalesce(F.sum(F.when(burst, F.col(name))), F.lit(0.0)).cast("bigint")
    return recent.agg(
        F.count_if(burst).alias("bursts"),
        total("chars").alias("chars"),
        total("back").alias("backspaces"),
        F.avg(F.when(burst & (F.col("wpm") > 0), F.col("wpm"))).alias("mean_wpm"),
        *(F.count_if(of(kind)).alias(name) for kind, name in (("click", "clicks"), ("scroll", "scrolls"), ("drag", "drags"), ("correction_detected", "corrections"))),
    )


def corrected_words(events: DataFrame, newest: int = 100, limit: int = 10) -> DataFrame:
    """(word, n): the words corrected most among the newest corrections; ties by word."""
    p = F.col("payload")
    looked = events.where("event_type = 'correction_detected'").orderBy(F.desc("timestamp"), F.desc("event_id")).limit(newest)
    words = looked.select(F.lower(F.trim(original_word(p))).alias("word")).where("word <> ''")
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(limit)


def scorecard(events: DataFrame, since: float) -> DataFrame:
    """One row: transcriptions, corrections and corrections for each transcription to four places, after ``since``."""
    recent = events.where(F.col("timestamp") > since)
    said, fixed = F.count_if((F.col("modality") == "voice") & (F.col("event_type") == "transcription")), F.count_if(F.col("event_type") == "correction_detected")
    return recent.agg(said.alias("transcriptions"), fixed.alias("corrections"), F.coalesce(F.bround(F.try_divide(fixed, said), 4), F.lit(0.0)).alias("rate"))


def weekly_report(history: DataFrame, weeks: int = 4) -> dict[str, DataFrame]:
    """Trend, growth and words of a metrics history (date, correction_rate, vocab_*_size, top_corrected_words).

    trend: the last 7 * weeks entries by date; growth: last minus first entry over all; words: their
    counts added up over the trend, top 10, ties by word. With fewer than two entries all three are empty.
    """
    enough = history.count() >= 2
    history = history if enough else history.limit(0)
    tail = history.orderBy(F.desc("date")).limit(7 * weeks)
    sizes = [c for c in history.columns if c.startswith("vocab_")]
    growth = history.agg(*((F.max_by(c, "date") - F.min_by(c, "date")).alias(c.removeprefix("vocab_").removesuffix("_size")) for c in sizes), F.count("*").alias("entries")).where("entries > 0")
    words = tail.select(F.explode("top_corrected_words").alias("w")).select("w.word", "w.count").where("word <> ''").groupBy("word").agg(F.sum("count").alias("n")).orderBy(F.desc("n"), "word").limit(10)
    return {"trend": tail.select("date", "correction_rate").orderBy("date"), "growth": growth, "words": words}


def escalations(events: DataFrame, since: float, threshold: int = 3) -> DataFrame:
    """(original, corrected, n): words corrected at least ``threshold`` times after ``since``, with the newest correction; empty words and those equal but for case do not count."""
    p = F.col("payload")
    rows = events.where((F.col("timestamp") > since) & (F.col("event_type") == "correction_detected"))
    rows = rows.select(F.lower(F.trim(original_word(p))).alias("original"), F.trim(corrected_word(p)).alias("corrected"), "timestamp", "event_id")
    rows = rows.where("original <> '' and corrected <> '' and original <> lower(corrected)")
    return rows.groupBy("original").agg(F.max_by("corrected", F.struct("timestamp", "event_id")).alias("corrected"), F.count("*").alias("n")).where(F.col("n") >= threshold)


def cold_windows(memories: DataFrame, seconds: int = ROLLUP_SECONDS) -> DataFrame:
    """Tumbling roll-up of memories by updated_at: (window_start, window_end, text_content, entry_count, modalities, keys).

    The window's text is the non-empty keys and values in the order of update, then id, joined by line
    breaks. Rows without updated_at are left out. A window written again replaces the old one.
    """
    start = F.floor(F.col("updated_at") / seconds) * seconds
    rows = memories.where("updated_at is not null and not isnan(updated_at)").withColumn("window_start", start.cast("double"))
    line = F.concat_ws("\n", F.nullif("key", F.lit("")), F.nullif("value", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("updated_at", "id", line.alias("line"), F.col("key").alias("k"))))
    grouped = rows.groupBy("window_start").agg(ordered.alias("rows"), F.count("*").alias("entry_count"), F.array_sort(F.collect_set("modality")).alias("modalities"))
    return grouped.select(
        "window_start",
        (F.col("window_start") + seconds).alias("window_end"),
        F.array_join(F.filter(F.transform("rows", lambda r: r["line"]), lambda x: x != ""), "\n").alias("text_content"),
        "entry_count",
        "modalities",
        F.transform("rows", lambda r: r["k"]).alias("keys"),
    )


def replace_windows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old roll-ups with those of the same window_start replaced."""
    return old.join(new.select("window_start"), "window_start", "left_anti").unionByName(new)


def tier_stats(tiers: dict[str, DataFrame], sized: str = "value") -> DataFrame:
    """(tier, entries, chars) of each tier; empty tiers count 0."""
    parts = [df.agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.length(sized)), F.lit(0)).alias("chars")).select(F.lit(name).alias("tier"), "entries", "chars") for name, df in tiers.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def buffer_status(frames: DataFrame) -> DataFrame:
    """One row over frames (timestamp, monitor_index, text_tokens, image_tokens): number, monitors, span, tokens as text and image, percent saved by text."""
    text, image = F.coalesce(F.sum("text_tokens"), F.lit(0)), F.coalesce(F.sum("image_tokens"), F.lit(0))
    saved = F.coalesce(F.try_divide((image - text) * 100.0, image), F.lit(0.0))
    return frames.agg(
        F.count("*").alias("frames"), F.count_distinct("monitor_index").alias("monitors"), (F.max("timestamp") - F.min("timestamp")).alias("span_seconds"), text.alias("text_tokens"), image.alias("image_tokens"), saved.alias("saved_percent")
    )


def confidence_histogram(rows: DataFrame, value: str, width: float = 0.1) -> DataFrame:
    """(bucket, n): counts by buckets of a number; null and NaN are left out."""
    return rows.where(F.col(value).isNotNull() & ~F.isnan(value)).groupBy(F.floor(F.col(value) / width).cast("bigint").alias("bucket")).agg(F.count("*").alias("n"))


def pass_rates(results: DataFrame, group: str, passed: Column) -> DataFrame:
    """(group, passed, total) of check results; a null result is no pass."""
    return results.groupBy(group).agg(F.count_if(F.coalesce(passed, F.lit(False))).alias("passed"), F.count("*").alias("total"))


def app_means(rows: DataFrame, *values: str) -> DataFrame:
    """(app_name, n, mean_<value>...) of a benchmark: means for each app, missing apps as 'unknown'; null and NaN do not count."""
    app = F.coalesce(F.nullif("app_name", F.lit("")), F.lit("unknown")).alias("app_name")
    return rows.groupBy(app).agg(F.count("*").alias("n"), *(F.avg(F.when(~F.isnan(v), F.col(v))).alias(f"mean_{v}") for v in values))
