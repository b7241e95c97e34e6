"""Ordered analytics: changes against the row before, and greedy rules that compare with the last accepted row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.ordered import greedy_in_order, runs_in_order, with_previous


def drop_repeats(df: DataFrame, value: str, group: str, time: str, key: str) -> DataFrame:
    """Rows whose value differs from the row before in their group; the first row stays, null counts as a value."""
    before = with_previous(df, group, time, key, [value])
    return before.where(~F.col("has_previous") | ~F.col(value).eqNullSafe(F.col(f"previous_{value}"))).select(*df.columns)


def focus_changes(df: DataFrame, group: str = "monitor_index", time: str = "timestamp", key: str = "id") -> DataFrame:
    """Rows whose title differs from the last title before it that was not missing (missing ones are passed over), with ``previous_title``."""
    titled = with_previous(df.where("window_title <> ''"), group, time, key, ["window_title"]).withColumnRenamed("previous_window_title", "previous_title")
    return titled.where("previous_title is not null and previous_title <> window_title").drop("has_previous")


def idle_wakes(df: DataFrame, group: str, idle_seconds: float = 30.0, time: str = "timestamp", key: str = "id") -> DataFrame:
    """Rows that come at least ``idle_seconds`` after the row before in their group, with the gap."""
    before = with_previous(df.where(f"{time} is not null and not isnan({time})"), group, time, key, [time])
    return before.withColumn("gap", F.col(time) - F.col(f"previous_{time}")).where(F.col("gap") >= idle_seconds).drop("has_previous", f"previous_{time}")


def adaptive_interval(gap: Column, base: float, idle: float, threshold: float = 60.0) -> Column:
    """Seconds until the next capture: the longer of both intervals once idle for the threshold, else the base."""
    return F.when(gap >= threshold, F.greatest(F.lit(base), F.lit(idle))).otherwise(F.lit(base))


def drags(df: DataFrame, min_pixels: float = 20.0) -> DataFrame:
    """Pairs of a press and the next row of the same button (kind, x, y, timestamp, button, id), a release more than ``min_pixels`` away: (id, distance, duration_ms)."""
    window = Window.partitionBy("button").orderBy("timestamp", "id")
    rows = df.select("id", "kind", *(F.lead(c).over(window).alias(f"next_{c}") for c in ("kind", "x", "y", "timestamp")), "x", "y", "timestamp")
    distance = F.sqrt(F.pow(F.col("next_x") - F.col("x"), 2) + F.pow(F.col("next_y") - F.col("y"), 2))
    pressed = rows.where("kind = 'press' and next_kind = 'release'").withColumn("distance", distance)
    return pressed.where(F.col("distance") > min_pixels).select("id", "distance", ((F.col("next_timestamp") - F.col("timestamp")) * 1000).cast("bigint").alias("duration_ms"))


def debounced(df: DataFrame, group: str, gap: float, time: str = "timestamp", key: str = "id") -> DataFrame:
    """Rows of each group that are at least ``gap`` seconds after the last accepted one, with all columns.

    Rows are scanned by ranges, so a group that holds all rows is spread over all cores. Rows with a null group, key or unusable
    time are left out. Equal times: smaller key first.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(key).isNotNull() & F.col(time).isNotNull() & ~F.isnan(time))
    return greedy_in_order(rows, group, time, key, gap)


MAX_CLIP_CHARS = 10_000
CLIP_SUFFIX = "\n[truncated]"


def stored_clips(df: DataFrame, gap: float = 1.0, min_chars: int = 5) -> DataFrame:
    """(id, timestamp, text): what a clipboard watcher stores.

    In time order: non-empty, at least ``gap`` seconds after the last one looked at, trimmed, long
    enough, different from the last stored text, cut at 10,000 characters with a suffix.
    """
    looked = debounced(df.where("text <> ''").withColumn("__all", F.lit(0)), "__all", gap).drop("__all")
    trimmed = looked.withColumn("text", F.regexp_replace("text", r"(?U)^\s+|\s+$", "")).where(F.length("text") >= min_chars)
    # each run of one text is stored once, by its first row
    runs = runs_in_order(trimmed, F.lit(""), F.sha2("text", 256), F.round(F.col("timestamp") * 1e6).cast("bigint"), F.col("id"), 1 << 62)
    kept = trimmed.join(runs.select(F.col("first_id").alias("id")), "id", "left_semi")
    text = F.when(F.length("text") > MAX_CLIP_CHARS, F.concat(F.substring("text", 1, MAX_CLIP_CHARS), F.lit(CLIP_SUFFIX))).otherwise(F.col("text"))
    return kept.select("id", "timestamp", text.alias("text"))


def changed_frames(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """(id, diff): frames (id, monitor_index, timestamp, pixels array) that differ from the last stored frame of their monitor.

    diff is the mean absolute difference in percent of 255; the first frame and one of another size
    count 100. Frames below the threshold are not stored and not compared with.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict = {}
        for pdf in batches:
            out = []
            for frame, monitor, pixels in zip(pdf["id"], pdf["monitor_index"], pdf["pixels"]):
                now = np.asarray(pixels, float)
                before = last.get(monitor)
                diff = 100.0 if before is None or before.shape != now.shape or not len(now) else float(np.abs(now - before).mean() / 255 * 100)
                if diff >= threshold:
                    last = {monitor: now}  # sorted by monitor: one frame is enough
                    out.append((frame, diff))
            yield pd.DataFrame(out, columns=["id", "diff"])

    usable = df.where("pixels is not null and timestamp is not null").select("id", "monitor_index", "timestamp", "pixels")
    kind = usable.schema["id"].dataType.simpleString()
    return usable.repartition("monitor_index").sortWithinPartitions("monitor_index", "timestamp", "id").mapInPandas(run, f"id {kind}, diff double")


def typing_bursts(keys: DataFrame, group: str, timeout_seconds: float = 1.5, min_chars: int = 3) -> DataFrame:
    """Typing bursts of keys (ts timestamp, key_char, is_backspace, is_selection): runs whose pauses do not exceed the timeout.

    A pause of exactly the timeout stays inside. A burst ends when its timer fires, one timeout after the last key, and its
    duration counts from the first key to then. Bursts of fewer than ``min_chars`` characters are dropped.
    Columns: group, start, char_count, word_count, duration_ms, wpm, backspace_count, has_selection.
    """
    window = F.session_window("ts", f"{round(timeout_seconds * 1000)} milliseconds")
    back, select = F.coalesce("is_backspace", F.lit(False)), F.coalesce("is_selection", F.lit(False))
    grouped = keys.where("ts is not null").groupBy(group, window.alias("w")).agg(
        F.count_if(~back & ~select & F.col("key_char").isNotNull()).alias("char_count"), F.count_if(back).alias("backspace_count"), F.bool_or(select & ~back).alias("has_selection")
    )
    words = F.greatest(F.lit(1), F.floor(F.col("char_count") / 5))
    length = F.expr("unix_millis(w.end) - unix_millis(w.start)")
    return grouped.where(F.col("char_count") >= min_chars).select(
        group, F.col("w.start").alias("start"), "char_count", words.cast("bigint").alias("word_count"), length.alias("duration_ms"), F.floor(words / (F.greatest(length, F.lit(1)) / 1000) * 60).cast("bigint").alias("wpm"), "backspace_count", "has_selection"
    )


def watch_windows(pastes: DataFrame, focus: DataFrame, seconds: float = 15.0) -> DataFrame:
    """(event_id, opened, closed): each paste's watch window ends after ``seconds``, at the next paste, or at the next window change.

    Both inputs are (event_id, timestamp); equal times: a change before a paste does not close it.
    """
    rows = pastes.select("event_id", "timestamp", F.lit(1).alias("kind")).unionByName(focus.select("event_id", "timestamp", F.lit(0).alias("kind"))).where("timestamp is not null and not isnan(timestamp)")
    # a row beyond the window can't close it: only neighbours in the same or next slice of time matter
    sliced = rows.withColumn("slice", F.floor(F.col("timestamp") / seconds).cast("bigint"))
    both = sliced.withColumn("slice", F.explode(F.array(F.col("slice"), F.col("slice") - 1)))
    order = Window.partitionBy("slice").orderBy("timestamp", "kind", "event_id")
    own = both.withColumn("next", F.lead("timestamp").over(order)).where(F.col("slice") == F.floor(F.col("timestamp") / seconds))
    return own.where("kind = 1").select("event_id", F.col("timestamp").alias("opened"), F.least(F.col("timestamp") + seconds, F.coalesce("next", F.col("timestamp") + seconds)).alias("closed"))


def replayed(keys: DataFrame, group: str) -> DataFrame:
    """(group, text): what is left of typed characters in order (nth, key_char, is_backspace) when each backspace takes the last one away."""
    folded = F.aggregate(
        "k", F.lit(""), lambda text, k: F.when(k["is_backspace"], F.substring(text, F.lit(1), F.greatest(F.length(text) - 1, F.lit(0)))).otherwise(F.concat(text, F.coalesce(k["key_char"], F.lit(""))))
    )
    return keys.groupBy(group).agg(F.array_sort(F.collect_list(F.struct("nth", "key_char", F.coalesce("is_backspace", F.lit(False)).alias("is_backspace")))).alias("k")).select(group, folded.alias("text"))


def monitor_crossings(df: DataFrame, group: str, min_pixels: float = 200.0) -> DataFrame:
    """Rows of (id, timestamp, x, y, monitor_index) where the pointer jumps at least ``min_pixels`` onto another monitor than it last jumped to: (group, id, from_monitor, to_monitor).

    After each far step the remembered monitor is that step's own, so a look at the far step before
    is enough; before the first one it is the group's first monitor. Rows without position or time are left out.
    """
    rows = df.where("x is not null and y is not null and timestamp is not null and monitor_index is not null")
    window = Window.partitionBy(group).orderBy("timestamp", "id")
    step = F.sqrt(F.pow(F.col("x") - F.lag("x").over(window), 2) + F.pow(F.col("y") - F.lag("y").over(window), 2))
    far = rows.withColumn("step", step).withColumn("first_monitor", F.first("monitor_index").over(window)).where(F.col("step") >= min_pixels)
    jumps = far.withColumn("from_monitor", F.coalesce(F.lag("monitor_index").over(window), "first_monitor"))
    return jumps.where("from_monitor <> monitor_index").select(group, "id", "from_monitor", F.col("monitor_index").alias("to_monitor"))


def without_repeated_content(df: DataFrame, content: str, seconds: float, time: str = "timestamp", key: str = "id") -> DataFrame:
    """Rows whose content hash was not accepted within ``seconds`` before; null contents are kept.

    Rows are grouped by hash, so one group holds only copies of one content.
    """
    named = df.withColumn("__hash", F.xxhash64(content))
    return debounced(named.where(F.col(content).isNotNull()), "__hash", seconds, time, key).drop("__hash").unionByName(df.where(F.col(content).isNull()))
