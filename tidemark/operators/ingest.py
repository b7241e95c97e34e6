"""Validation, idempotent insert, late updates, upserts and deletes, on DataFrames."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The modalities and event types of the event log.
MODALITIES = ("sight", "voice", "clipboard", "system", "keys", "flow")
EVENT_TYPES = (
    "screen_capture ocr_result speech_start speech_end transcription clipboard_change window_focus idle_start idle_end "
    "session_lock session_unlock keystroke typing_burst typing_pause shortcut paste_detected correction_detected "
    "vocabulary_learned learning_consolidation click scroll hover_dwell drag"
).split()
FUTURE_SKEW = 60.0
HOT_TTL_SECONDS = 300.0
MAX_TTL_HOURS = 8760.0


def rejection(as_of: float) -> Column:
    """Why an event is not taken, null if it is: no id, no time, future, modality or type outside the domain."""
    time = F.col("timestamp")
    return (
        F.when(F.col("event_id").isNull() | (F.col("event_id") == ""), "no id")
        .when(time.isNull() | F.isnan(time) | (time <= 0), "no time")
        .when(time > as_of + FUTURE_SKEW, "future")
        .when(F.col("modality").isNull() | ~F.col("modality").isin(*MODALITIES), "modality")
        .when(F.col("event_type").isNull() | ~F.col("event_type").isin(*EVENT_TYPES), "event type")
    )


def validated(events: DataFrame, as_of: float) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): events that pass validation at ``as_of``, and the others with their reason."""
    marked = events.withColumn("reason", rejection(as_of))
    return marked.where("reason is null").drop("reason"), marked.where("reason is not null")


def first_per_key(df: DataFrame, key: str, *order: str, columns: Sequence[str] | None = None) -> DataFrame:
    """One row for each key, the first by ``order`` with nulls last and all other columns as tie-break: insert-or-ignore in bulk.

    Null keys are one key. Only orderable columns serve as tie-break. An empty table stays empty.
    With ``columns`` only those come out, and only what can decide about them is shuffled: ties are
    broken column by column, so none behind the last wanted one matters.
    """
    rest = [c for c, kind in df.dtypes if c != key and c not in order and not kind.startswith(("map", "variant"))]
    if columns is not None:
        rest = rest[: max((n for n, c in enumerate(rest, 1) if c in columns), default=0)]
        df = df.select(*dict.fromkeys((key, *order, *rest, *columns)))
    window = Window.partitionBy(key).orderBy(*(F.col(c).asc_nulls_last() for c in (*order, *rest)))
    first = df.withColumn("__nth", F.row_number().over(window)).where("__nth = 1").drop("__nth")
    return first if columns is None else first.select(*columns)


def acceptable(as_of: float) -> Column:
    """Does an event pass validation? The same rule as ``rejection``, as plain conjuncts that reach the Parquet scan (NaN is above every bound)."""
    time = F.col("timestamp")
    in_time = (time > 0) & (time <= as_of + FUTURE_SKEW)
    return F.col("event_id").isNotNull() & (F.col("event_id") != "") & in_time & F.col("modality").isin(*MODALITIES) & F.col("event_type").isin(*EVENT_TYPES)


def stored_events(
    deliveries: DataFrame, as_of: float, since: float | None = None, until: float | None = None, modality: str | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """The event log as a store holds it: valid events, the first delivery of each id.

    A redelivered event keeps its time and modality, so bounds on them (both inclusive) are applied
    before deliveries meet by id: only the asked part of the log is shuffled, and of it only what ``columns`` need.
    """
    rows = deliveries.where(acceptable(as_of))
    for wanted, condition in ((since, F.col("timestamp") >= F.lit(since)), (until, F.col("timestamp") <= F.lit(until)), (modality, F.col("modality") == F.lit(modality))):
        rows = rows if wanted is None else rows.where(condition)
    return first_per_key(rows, "event_id", "created_at", columns=columns)


def insert_new(target: DataFrame, incoming: DataFrame, key: str, *order: str) -> DataFrame:
    """The rows of ``incoming`` to append to ``target``: first of each key that the target does not hold yet."""
    return first_per_key(incoming, key, *order).join(target.select(key), key, "left_anti")


def late_update(base: DataFrame, updates: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """``base`` with ``columns`` taken from the update of the same key where it has a value; keys only in ``updates`` are ignored.

    ``updates`` must have one row for each key.
    """
    late = updates.select(key, *(F.col(c).alias(f"__{c}") for c in columns))
    joined = base.join(late, key, "left")
    return joined.select(*(F.coalesce(f"__{c}", c).alias(c) if c in columns else F.col(c) for c in base.columns))


def upsert_memories(rows: DataFrame) -> DataFrame:
    """One row for each key: everything from the latest write (updated_at, then id), created_at from the first, tags sorted with repeats kept."""
    latest = Window.partitionBy("key").orderBy(F.desc_nulls_last("updated_at"), F.desc_nulls_last("id"))
    first = F.min("created_at").over(Window.partitionBy("key"))
    return (
        rows.withColumn("__first", first)
        .withColumn("__nth", F.row_number().over(latest))
        .where("__nth = 1")
        .withColumn("created_at", F.col("__first"))
        .withColumn("tags", F.array_sort("tags"))
        .drop("__first", "__nth")
    )


def within_quota(existing: DataFrame, incoming: DataFrame, quota: int, key: str = "key", order: str = "created_at") -> DataFrame:
    """Incoming rows that are stored: updates of known keys always, new keys first come first served while the count is below the quota."""
    room = max(quota - existing.select(key).distinct().count(), 0)
    known = incoming.join(existing.select(key).distinct(), key, "left_semi")
    new = incoming.join(existing.select(key), key, "left_anti")
    admitted = new.groupBy(key).agg(F.min(order).alias("__at")).orderBy(F.col("__at").asc_nulls_last(), key).limit(room).select(key)
    return known.unionByName(new.join(admitted, key, "left_semi"))


def expiry(as_of: Column | float, ttl_hours: Column) -> Column:
    """When a memory ends: after its hours, at most a year; never (null) for no or zero hours, and null for negative ones, which are refused."""
    hours = F.least(ttl_hours, F.lit(MAX_TTL_HOURS))
    return F.when(ttl_hours > 0, as_of + hours * 3600)


def hot_expiry(as_of: Column | float, ttl_hours: Column) -> Column:
    """When the hot copy of a memory ends: after five minutes, or its own time if shorter."""
    return as_of + F.when(ttl_hours > 0, F.least(ttl_hours * 3600, F.lit(HOT_TTL_SECONDS))).otherwise(HOT_TTL_SECONDS)


def forget(rows: DataFrame, keys: DataFrame, key: str = "key") -> tuple[DataFrame, DataFrame]:
    """(kept rows, (key, existed) of every key asked for once)."""
    asked = keys.select(key).distinct()
    there = rows.select(key).distinct().withColumn("existed", F.lit(True))
    return rows.join(asked, key, "left_anti"), asked.join(there, key, "left").withColumn("existed", F.coalesce("existed", F.lit(False)))


def image_tokens(width: Column, height: Column) -> Column:
    """Token cost of an image: pixels / 750, half to even, at least 1."""
    return F.greatest(F.lit(1), F.bround(width * height / 750)).cast("bigint")


def text_tokens(text: Column) -> Column:
    """Token cost of a text: a quarter of its characters, at least 1; null for null."""
    return F.when(text.isNotNull(), F.greatest(F.lit(1), F.floor(F.length(text) / 4))).cast("bigint")
