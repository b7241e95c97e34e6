"""The nightly learning run: every miner over the stored log, merged into the vocabulary layers."""

from __future__ import annotations

import logging
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.payload import field
from tidemark.operators import mining, summaries
from tidemark.plans.durable import durable

log = logging.getLogger(__name__)
DAY = 86_400.0


def dictations(events: DataFrame, since: float) -> DataFrame:
    """(raw, clean) of the transcriptions after ``since``."""
    p = F.col("payload")
    said = events.where((F.col("timestamp") > since) & (F.col("modality") == "voice") & (F.col("event_type") == "transcription"))
    return said.select(field(p, "raw_transcript").alias("raw"), field(p, "transcript").alias("clean"))


def consolidated(events: DataFrame, clips: DataFrame, vocabulary: DataFrame, as_of: float) -> tuple[DataFrame, DataFrame]:
    """(vocabulary, audit): the vocabulary with what was learned, and (step, found) of each step.

    Steps: dictation patterns, cross-modal evidence (both into the learned layer), screen terms (into the
    context layer), clipboard terms (counted only) and repeated corrections of three days (learned).
    A step that fails is logged and counts as null; the others go on. Keys of higher layers are
    not written again, and context keys that a higher layer holds are removed.
    """
    steps: dict[str, Callable[[], DataFrame]] = {
        "session_learned": lambda: mining.learned_phrases(dictations(events, as_of - DAY)).select(F.lit("learned").alias("layer"), F.col("original").alias("key"), F.col("corrected").alias("value")),
        "cross_modal": lambda: mining.cross_modal(events, as_of - DAY).where(F.length("original") >= 6).select(F.lit("learned").alias("layer"), F.col("original").alias("key"), F.col("corrected").alias("value")),
        "ocr_harvested": lambda: mining.harvested(events, as_of - DAY).select(F.lit("context").alias("layer"), F.col("phrase").alias("key"), F.col("term").alias("value")),
        "clipboard_harvested": lambda: mining.clipped_terms(clips).select(F.lit("none").alias("layer"), F.col("phrase").alias("key"), F.col("term").alias("value")),
        "escalated": lambda: summaries.escalations(events, as_of - 3 * DAY).select(F.lit("learned").alias("layer"), F.col("original").alias("key"), F.col("corrected").alias("value")),
    }
    audit, learned = [], vocabulary.limit(0)
    for name, step in steps.items():
        try:
            found = durable(step())  # counted, and read again below
            audit.append((name, found.count()))
            if name != "clipboard_harvested":
                learned = learned.unionByName(found)
        except Exception:
            log.exception("step %s failed", name)
            audit.append((name, None))
    fresh = mining.new_entries(learned, vocabulary).groupBy("layer", "key").agg(F.min("value").alias("value"))
    merged = vocabulary.unionByName(fresh.join(vocabulary.select("layer", "key"), ["layer", "key"], "left_anti"))
    redundant = mining.redundant_context(merged)
    audit.append(("deduplicated", redundant.count()))
    kept = merged.join(redundant.select("layer", "key").distinct(), ["layer", "key"], "left_anti")
    return kept, events.sparkSession.createDataFrame(audit, "step string, found bigint")
