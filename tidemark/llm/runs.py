"""Runs of captures that show the same window."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.clean import app_key, epoch_micros, present
from tidemark.operators.ordered import runs_in_order

#: Words with which a running program marks its own state in a title.
STATE_WORDS = (
    "loading saving syncing connecting reconnecting uploading downloading updating refreshing working busy waiting "
    "not responding paused muted unmuted playing recording live edited modified unsaved saved autosaved changed new unread "
    "complete completed done idle"
).split()
STATE = r"(?:not responding|" + "|".join(w for w in STATE_WORDS if w not in ("not", "responding")) + r")"
MARK = r"[\p{So}\p{Sk}*!•·●○⏸▶⠀-⣿️]"
PERCENT = r"\d{1,3}(?:[.,]\d+)?\s?%(?:\s+(?:complete|completed|done|loaded))?"
CLOCK = r"\d{1,2}:\d{2}(?::\d{2})?"
COUNT = r"\d+\+?\s+(?:new|unread|messages?|notifications?|updates?|mentions?)(?:\s+(?:messages?|notifications?|updates?|mentions?))?"
#: State in brackets, wherever it stands; a bare number in brackets counts only at the very start.
BRACKETED = rf"[\[(]\s*(?:{PERCENT}|{CLOCK}|{COUNT}|{STATE}(?:\s*(?:…|\.\.\.))?)\s*[\])]"
LEADING = rf"^(?:\s|{MARK}|\(\d+\+?\)|\[\d+\+?\]|{PERCENT}\s*(?:[-–—:|]\s)?|{CLOCK}\s(?:[-–—|]\s)?|{STATE}\s?(?:…|\.\.\.))+"
#: An asterisk or dot glued to the end of a part of the title, and "- Edited" as a part of its own.
ENDING = rf"\s*{MARK}+(?=\s*(?:[-–—|]\s|$))"
OWN_PART = rf"\s+[-–—|]\s+{STATE}(?=\s+[-–—|]\s|\s*$)"


def title_subject(title: Column) -> Column:
    """What a window title is about, without what the program changes in it by itself; '' when missing.

    Dropped: unread and new counts, progress, clocks, busy, paused and (un)saved marks, letter case
    and blanks. Kept: every other number, as it names a page, chapter, sheet, ticket or file.
    """
    text = F.regexp_replace(F.lower(title), r"(?U)\s+", " ")
    for pattern, instead in ((BRACKETED, " "), (OWN_PART, ""), (LEADING, ""), (ENDING, ""), (r"\s+", " ")):
        text = F.regexp_replace(text, pattern, instead)
    return F.coalesce(present(text), F.lit(""))


def boundary_lookup(starts: np.ndarray, rows: int) -> np.ndarray:
    """Rows of each run: each row finds its run by binary search in the sorted run starts."""
    return np.bincount(np.searchsorted(starts, np.arange(starts[0], rows), side="right") - 1, minlength=len(starts))


def window_runs(activity: DataFrame, gap_seconds: float = 600.0) -> DataFrame:
    """Collapse captures of one monitor that follow each other and show the same window into one record.

    The rows of a monitor are cut into ranges of (monitor, time, id); in each, the positions where
    app, subject or a pause longer than the gap begin a run form a sorted array in which every row
    finds its run. A pause of exactly the gap does not end a run. Rows without id or usable
    timestamp take no part; rows without monitor_index are a monitor of their own (null); missing
    titles are all the same, and so are missing apps; a row delivered again counts once. Columns:
    monitor_index, app_name, subject, first_id, last_id, start_time, end_time, duration_seconds, n_captures.
    """
    app, subject = app_key(F.col("app_name")), title_subject(F.col("window_title"))
    monitor = F.coalesce(F.col("monitor_index").cast("string"), F.lit(""))
    shown = F.concat_ws("\x1f", app, subject)
    runs = runs_in_order(activity, monitor, shown, epoch_micros(F.col("timestamp")), F.col("id"), round(gap_seconds * 1e6), boundary_lookup, ("app_name", "window_title"))
    shown = F.split("subject", "\x1f")
    return runs.select(
        F.when(F.col("stream") != "", F.col("stream")).cast("int").alias("monitor_index"),
        shown[0].alias("app_name"),
        shown[1].alias("subject"),
        "first_id",
        "last_id",
        (F.col("start_us") / 1e6).alias("start_time"),
        (F.col("end_us") / 1e6).alias("end_time"),
        ((F.col("end_us") - F.col("start_us")) / 1e6).alias("duration_seconds"),
        F.col("n").alias("n_captures"),
    )
