"""Schema-on-read access to JSON payloads; a broken or missing payload gives nulls everywhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parsed(payload: Column) -> Column:
    """The payload as a variant; null when it is no valid JSON."""
    return F.try_parse_json(payload)


def field(payload: Column, *names: str, kind: str = "string") -> Column:
    """The first of several payload fields that is there, as ``kind``; null if none is or it has another type."""
    values = [F.try_variant_get(parsed(payload), f"$.{name}", kind) for name in names]
    return F.coalesce(*values) if len(values) > 1 else values[0]


def indexed_text(payload: Column) -> Column:
    """What full-text search sees: the first field that is there of OCR text, transcript and text; an empty string stops the search."""
    return F.coalesce(field(payload, "ocr_text", "transcript", "text"), F.lit(""))


def display_text(payload: Column) -> Column:
    """What is shown: as indexed_text, but an empty string lets the next field speak."""
    return F.coalesce(*(F.nullif(field(payload, name), F.lit("")) for name in ("ocr_text", "transcript", "text")), F.lit(""))


def text_content(payload: Column) -> Column:
    """All five text fields that are not empty, joined by blanks."""
    return F.concat_ws(" ", *(F.nullif(field(payload, name), F.lit("")) for name in ("ocr_text", "transcript", "text", "burst_text", "correction_text")))


def original_word(payload: Column) -> Column:
    """The corrected-away word, under either of the names writers use."""
    return field(payload, "original_word", "original_text")


def corrected_word(payload: Column) -> Column:
    """The word put in its place, under either name."""
    return field(payload, "corrected_word", "corrected_text")
