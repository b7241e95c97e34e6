"""Term mining: harvests, correction learning and cross-modal evidence."""

from __future__ import annotations

from collections import Counter

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as ST

from tidemark.functions import text as T
from tidemark.functions.payload import corrected_word, field, original_word
from tidemark.operators.timejoin import range_join

# Words that alone are no vocabulary.
COMMON_WORDS = (
    "the and for are but not you all can had her was one our out day get has him his how its may new now old see way who did let say she too use about after again could every first found great house "
    "large later never other place right small still think three under water where which world would write stock trade model island personal screen context"
).split()
LINK_OR_PATH = r"(?i)https?://|www\.|[A-Z]:\\|(?:^|\s)[~/]\S+/"


def term_counts(rows: DataFrame, terms: Column, min_count: int = 1, skip_phrases: list[str] | None = None) -> DataFrame:
    """(term, phrase, n): how often each extracted term occurs, from ``min_count`` on; terms whose spaced form is to be skipped are left out."""
    counts = rows.select(F.explode(terms).alias("term")).groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    phrased = counts.withColumn("phrase", F.coalesce(T.camel_phrase(F.col("term")), F.lower("term")))
    return phrased.where(~F.col("phrase").isin(skip_phrases)) if skip_phrases else phrased


def _screen(events: DataFrame, min_confidence: float) -> DataFrame:
    p = F.col("payload")
    seen = events.where("modality = 'sight' and event_type = 'ocr_result'").select("event_id", "timestamp", field(p, "ocr_text").alias("text"), F.coalesce(field(p, "ocr_confidence", kind="double"), F.lit(0.0)).alias("confidence"))
    return seen.where((F.col("confidence") >= min_confidence) & (F.col("text") != ""))


def hot_words(events: DataFrame, as_of: float, seconds: float = 300, newest: int = 20, limit: int = 50, min_confidence: float = 0.75) -> DataFrame:
    """(term, n): compound names of six letters or more and acronyms on the newest screens; by frequency, ties by term."""
    looked = events.where((F.col("timestamp") > as_of - seconds) & (F.col("modality") == "sight") & (F.col("event_type") == "ocr_result")).orderBy(F.desc("timestamp"), F.desc("event_id")).limit(newest)
    terms = F.concat(T.camel_words(F.col("text"), 6), T.acronyms(F.col("text")))
    return term_counts(_screen(looked, min_confidence), terms).select("term", "n").orderBy(F.desc("n"), "term").limit(limit)


def harvested(events: DataFrame, since: float, min_count: int = 3, min_confidence: float = 0.75) -> DataFrame:
    """(term, phrase, n): compound and dotted names on screens after ``since``."""
    seen = _screen(events.where(F.col("timestamp") > since), min_confidence)
    return term_counts(seen, F.concat(T.camel_words(F.col("text"), 6), T.dotted_names(F.col("text"))), min_count)


def clipped_terms(texts: DataFrame, min_chars: int = 6, max_text: int = 200) -> DataFrame:
    """(term, phrase, n): compound names in short copied texts that are no links or paths."""
    short = texts.where((F.length("text") <= max_text) & ~F.col("text").rlike(LINK_OR_PATH))
    return term_counts(short, T.camel_words(F.col("text"), min_chars))


def learned_phrases(dictations: DataFrame, min_count: int = 2) -> DataFrame:
    """(original, corrected, n, confidence): compound names in clean texts whose spaced form stands in the raw one; phrases of common words only are left out."""
    pairs = dictations.where("raw <> '' and clean <> '' and raw <> clean").select("raw", F.explode(T.camel_words(F.col("clean"))).alias("corrected"))
    phrased = pairs.withColumn("original", T.camel_phrase(F.col("corrected"))).where("original is not null and contains(lower(raw), original)")
    counts = phrased.groupBy("original", "corrected").agg(F.count("*").alias("n")).where(F.col("n") >= min_count)
    common = F.forall(F.split("original", " "), lambda w: w.isin(COMMON_WORDS))
    return counts.where(~common).withColumn("confidence", F.least(F.lit(0.95), 0.5 + F.col("n") * 0.1))


@F.pandas_udf(ST.StructType([ST.StructField("raw_word", ST.StringType()), ST.StructField("clean_word", ST.StringType())]))
def _exchanged(raw: pd.Series, clean: pd.Series) -> pd.DataFrame:
    """The one word of each raw text that the clean one has another for, if it is one: bags are compared in linear time."""
    out = []
    for r, c in zip(raw, clean):
        a, b = Counter(r.lower().split()), Counter(c.lower().split())
        n, m = a.total(), b.total()
        gone, came = a - b, b - a
        one = gone.total() == came.total() == 1 and not (n > 3 and m > 3 and not 0.7 * n <= m <= 1.3 * n)
        out.append((*gone, *came) if one else (None, None))
    return pd.DataFrame(out, columns=["raw_word", "clean_word"])


def word_changes(dictations: DataFrame) -> DataFrame:
    """(raw_word, clean_word): dictations in which exactly one word was exchanged for another that is not a change of style.

    Texts whose word numbers differ by more than 30 % (both over three words) tell nothing; neither do null, empty and unchanged ones.
    """
    rows = dictations.where("raw <> '' and clean <> '' and raw <> clean")
    found = rows.select(_exchanged("raw", "clean").alias("x")).select("x.*").where("raw_word is not null")
    return found.where(~T.is_style_change(F.col("raw_word"), F.col("clean_word")))


def learned_corrections(changes: DataFrame, min_count: int = 3, min_share: float = 0.7) -> DataFrame:
    """(raw_word, clean_word, n, confidence): the usual replacement of each word, ties to the smaller; seen often and mostly enough."""
    counts = changes.groupBy("raw_word", "clean_word").agg(F.count("*").alias("n"))
    best = counts.groupBy("raw_word").agg(F.max_by("clean_word", F.struct("n")).alias("__any"), F.max("n").alias("n"), F.sum("n").alias("all"))
    top = counts.join(best.select("raw_word", "n", "all"), ["raw_word", "n"]).groupBy("raw_word", "n", "all").agg(F.min("clean_word").alias("clean_word"))
    return top.withColumn("confidence", F.col("n") / F.col("all")).where((F.col("n") >= min_count) & (F.col("confidence") >= min_share)).select("raw_word", "clean_word", "n", "confidence")


def frequent_terms(texts: DataFrame, top: int = 50) -> DataFrame:
    """(term, n): proper nouns inside sentences (three times or more) and pairs of words (five times or more, from the ``top`` ones); ties by term."""
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    rows = texts.where("text <> ''").select(words.alias("w"))
    bare = F.transform(F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))), lambda w: F.regexp_replace(w, r"^[.,!?;:'\"]+|[.,!?;:'\"]+$", ""))
    nouns = rows.select(F.explode(F.filter(bare, lambda w: (F.length(w) > 2) & w.rlike(r"^\p{Lu}") & (F.upper(w) != w))).alias("term")).groupBy("term").agg(F.count("*").alias("n")).where("n >= 3")
    low = F.transform("w", lambda w: F.regexp_replace(F.lower(w), r"^[.,!?]+|[.,!?]+$", ""))
    pairs = rows.select(low.alias("l")).select(F.explode(F.zip_with(F.slice("l", 1, F.greatest(F.size("l") - 1, F.lit(0))), F.slice("l", 2, F.greatest(F.size("l") - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))).alias("term"))
    pairs = pairs.where(F.length("term") > 5).groupBy("term").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "term").limit(top).where("n >= 5")
    both = pairs.unionByName(nouns.join(pairs, "term", "left_anti"))
    return both.orderBy(F.desc("n"), "term").limit(top)


def profile(dictations: DataFrame) -> DataFrame:
    """One row: number of dictations and mean words of the non-empty raw texts."""
    count = F.size(F.filter(F.split("raw", r"\s+"), lambda w: w != ""))
    return dictations.agg(F.count("*").alias("dictations"), F.avg(F.when(F.col("raw") != "", count)).alias("mean_words"))


def cross_modal(events: DataFrame, since: float, after: float = 30.0, around: float = 5.0, min_confidence: float = 0.75) -> DataFrame:
    """(transcription, correction, original, corrected, confidence, source): corrections soon after a dictation that the screen then confirms.

    0.95 if the corrected word is a compound name on the screen around the dictation, 0.8 if it is part of
    one in any case, else nothing. All bounds are out; a correction may belong to several dictations.
    """
    p = F.col("payload")
    recent = events.where(F.col("timestamp") > since)
    said = recent.where("modality = 'voice' and event_type = 'transcription'").select("event_id", "timestamp")
    fixed = events.where("modality = 'keys' and event_type = 'correction_detected'").select("event_id", "timestamp", F.lower(F.trim(original_word(p))).alias("original"), F.trim(corrected_word(p)).alias("corrected"))
    fixes = range_join(said, fixed.where("original <> '' and corrected <> ''"), 0, after)
    # names meet dictations one by one: no list of all names on the screens around one is built
    seen = _screen(events, min_confidence).select("timestamp", F.explode(T.camel_words(F.col("text"))).alias("name"))
    names = range_join(said, seen, -around, around).select("l_event_id", F.col("r_name").alias("name")).distinct()
    fixed_by = fixes.select("l_event_id", F.col("r_event_id").alias("correction"), F.col("r_original").alias("original"), F.col("r_corrected").alias("corrected"))
    part = F.contains(F.lower("name"), F.lower("corrected"))
    scored = fixed_by.join(names, "l_event_id").withColumn("confidence", F.when(F.col("name") == F.col("corrected"), 0.95).when(part, 0.80)).where("confidence is not null")
    best = scored.groupBy(F.col("l_event_id").alias("transcription"), "correction", "original", "corrected").agg(F.max("confidence").alias("confidence"))
    return best.withColumn("source", F.when(F.col("confidence") == 0.95, "cross_modal_screen_verified").otherwise("cross_modal_app_context"))


def harvest_for(dictations: DataFrame, screens: DataFrame, before: float = 60.0) -> DataFrame:
    """(event_id, phrase, term): compound names on screens (event_id, timestamp, text) around a dictation (event_id, timestamp, raw) whose spaced form was said."""
    pairs = range_join(dictations, screens, -before, before).select("l_event_id", "l_raw", F.explode(T.camel_words(F.col("r_text"), 6)).alias("term"))
    phrased = pairs.withColumn("phrase", T.camel_phrase(F.col("term"))).where("phrase is not null and contains(lower(l_raw), phrase)")
    return phrased.select(F.col("l_event_id").alias("event_id"), "phrase", "term").distinct()


def layered(vocabulary: DataFrame, priority: tuple[str, ...] = ("user", "learned", "context")) -> DataFrame:
    """(key, value, layer): each key from the first layer that has it; keys lower-cased and trimmed, unknown layers and empty keys left out."""
    rank = F.array_position(F.array(*(F.lit(x) for x in priority)), F.col("layer"))
    rows = vocabulary.withColumn("key", F.lower(F.trim("key"))).where("key <> '' and value is not null").withColumn("rank", rank).where("rank > 0")
    best = Window.partitionBy("key").orderBy("rank", "value")
    return rows.withColumn("nth", F.row_number().over(best)).where("nth = 1").select("key", "value", "layer")


def redundant_context(vocabulary: DataFrame) -> DataFrame:
    """Entries of the context layer whose key a higher layer holds too."""
    higher = vocabulary.where("layer in ('user', 'learned')").select("key")
    return vocabulary.where("layer = 'context'").join(higher, "key", "left_semi")


def new_entries(candidates: DataFrame, vocabulary: DataFrame, min_chars: int = 1) -> DataFrame:
    """Candidates (key, value) to write: changed by more than blanks and case of the key, long enough, and in neither the user nor the learned layer."""
    known = vocabulary.where("layer in ('user', 'learned')").select("key")
    good = candidates.where(F.trim("key") != F.trim("value")).where(F.length(F.trim("key")) >= min_chars)
    return good.join(known, "key", "left_anti")


def extract_correction(original: Column, typed: Column, backspaces: Column, selected: Column, min_confidence: float = 0.7) -> Column:
    """What a user's edit after a paste corrected: struct(original_word, corrected_word, correction_type, confidence), or null.

    A selection replaced by up to three words: the first word of the text that shares more than 0.3 of its
    letters with them. Else backspaces followed by one word: the one word that was deleted, 0.8.
    """
    strip = lambda c: F.regexp_replace(c, r"^[.,!? ]+|[.,!? ]+$", "")
    new = strip(F.lower(F.trim(typed)))
    words = F.filter(F.transform(F.split(F.lower(original), r"\s+"), strip), lambda w: (F.length(w) > 1) & (w != new) & (T.letter_overlap(w, new) > 0.3))
    word = F.get(words, F.lit(0))
    kind = "struct<original_word:string,corrected_word:string,correction_type:string,confidence:double>"
    chosen = F.struct(word.alias("original_word"), new.alias("corrected_word"), F.lit("select_replace").alias("correction_type"), F.least(F.lit(0.9), 0.5 + T.letter_overlap(word, new)).alias("confidence")).cast(kind)
    gone = F.lower(F.trim(F.substring(original, F.length(original) - backspaces + 1, backspaces)))
    one = lambda c: (c != "") & ~F.contains(c, F.lit(" "))
    retyped = F.struct(gone.alias("original_word"), new.alias("corrected_word"), F.lit("backspace_retype").alias("correction_type"), F.lit(0.8).alias("confidence")).cast(kind)
    found = F.when(selected & (F.size(F.split(new, " ")) <= 3) & word.isNotNull() & (new != ""), chosen).when(~selected & (backspaces > 0) & (backspaces <= F.length(original)) & one(gone) & one(new) & (gone != new), retyped)
    return F.when(found["confidence"] >= min_confidence, found)
