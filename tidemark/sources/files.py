"""Files as tables: projects, frames, vocabularies, metrics, journals."""

from __future__ import annotations

import subprocess
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.ingest import stored_events

# Fixed value: seconds a journal program may take.
JOURNAL_TIMEOUT = 10.0
# Phrases that are no vocabulary.
SKIPPED_PHRASES = ("personal finance", "stock market", "tax prep", "death planning", "island model", "screen context")
# Folders that are no projects.
SKIPPED = ("_PROJECT_TEMPLATE", ".git", "__pycache__", "node_modules", ".venv")
CONTEXT_FILE = "PROJECT_CONTEXT.md"
METRICS = T.StructType(
    [
        T.StructField("date", T.StringType()),
        T.StructField("correction_rate", T.DoubleType()),
        *(T.StructField(f"vocab_{layer}_size", T.LongType()) for layer in ("user", "learned", "context")),
        T.StructField("top_corrected_words", T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("count", T.LongType())]))),
    ]
)


def project_files(spark: SparkSession, root: str, name: str = CONTEXT_FILE) -> DataFrame:
    """(name, value): each project folder's Markdown file as one row; template and hidden folders are skipped. An empty root gives no rows."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", name).text(root, wholetext=True)
    folder = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    named = files.select(F.url_decode(folder).alias("name"), "value")
    return named.where(~F.col("name").isin(*SKIPPED) & ~F.startswith("name", F.lit(".")))


def frame_name(path: Column) -> Column:
    """struct(timestamp, monitor_index, kind) of a frame's file name '{ms}_m{monitor}.jpg|.txt', or of the older '{ms}.jpg' (monitor 0); null for other names."""
    name = F.element_at(F.split(path, "/"), -1)
    ms = F.nullif(F.regexp_extract(name, r"^(\d{1,18})(?:_m\d+)?\.(?:jpg|txt)$", 1), F.lit("")).cast("double")
    monitor = F.coalesce(F.nullif(F.regexp_extract(name, r"^\d+_m(\d{1,6})\.", 1), F.lit("")).cast("int"), F.lit(0))
    kind = F.regexp_extract(name, r"\.(jpg|txt)$", 1)
    return F.when(ms.isNotNull(), F.struct((ms / 1000).alias("timestamp"), monitor.alias("monitor_index"), kind.alias("kind")))


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """(frame_path, timestamp, monitor_index, kind, bytes): frames of a folder, without the text files that only accompany an image of the same name. Contents are not read."""
    files = spark.read.format("binaryFile").load(folder).select(F.col("path").alias("frame_path"), F.col("length").alias("bytes"))
    named = files.withColumn("f", frame_name(F.col("frame_path"))).where("f is not null").select("frame_path", "f.*", "bytes", F.regexp_replace("frame_path", r"\.[^.]+$", "").alias("stem"))
    images = named.where("kind = 'jpg'").select("stem")
    return named.where("kind = 'jpg'").unionByName(named.where("kind = 'txt'").join(images, "stem", "left_anti")).drop("stem")


def vocabulary_file(spark: SparkSession, path: str, layer: str) -> DataFrame:
    """(layer, key, value) of a JSON file with one object of phrases; a broken file or other JSON gives no entries."""
    text = spark.read.text(path, wholetext=True)
    entries = F.from_json("value", "map<string,string>", {"mode": "PERMISSIVE"})
    return text.select(F.explode(entries)).where("value is not null").select(F.lit(layer).alias("layer"), "key", "value")


def metrics_history(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a metrics history in JSON lines; broken lines are skipped."""
    return spark.read.schema(METRICS).option("mode", "DROPMALFORMED").json(path)


def append_metrics(entry: DataFrame, path: str) -> None:
    """Add entries to a metrics history."""
    entry.write.mode("append").json(path)


def append_journal(insights: DataFrame, path: str) -> None:
    """Add insights (project, ...) to a journal, a folder for each project."""
    insights.write.mode("append").partitionBy("project").parquet(path)


def run_journal(insights: Iterable[tuple[str, str]], command: Sequence[str], timeout: float = JOURNAL_TIMEOUT) -> list[tuple[str, bool, str]]:
    """Hand each insight (project, text) to a journal program on its standard input: (project, done, message) for each.

    A program that is missing, fails or takes longer than the timeout gives a failure with its reason; the others go on.
    """
    out = []
    for project, text in insights:
        try:
            done = subprocess.run([*command, project], input=text, text=True, capture_output=True, timeout=timeout, check=False)
            out.append((project, done.returncode == 0, (done.stdout if done.returncode == 0 else done.stderr).strip()))
        except subprocess.TimeoutExpired:
            out.append((project, False, f"no answer within {timeout:g} s"))
        except OSError as error:
            out.append((project, False, str(error)))
    return out


def _by_day(rows: DataFrame) -> DataFrame:
    return rows.where("timestamp is not null and not isnan(timestamp)").withColumn("day", F.to_date(F.timestamp_seconds("timestamp")))


def append_events(events: DataFrame, path: str) -> None:
    """Add events to the log, by day and modality, sorted by time inside a file so that time filters skip row groups. Rows without a usable time belong into the quarantine."""
    _by_day(events).repartition("day", "modality").sortWithinPartitions("timestamp").write.mode("append").partitionBy("day", "modality").parquet(path)


def append_log(rows: DataFrame, path: str) -> None:
    """Add clipboard rows or tool calls to their log, by day, sorted by time. Rows without a usable time are left out."""
    _by_day(rows).repartition("day").sortWithinPartitions("timestamp").write.mode("append").partitionBy("day").parquet(path)


class EventStore:
    """The event log on disk: valid events, each id once, by day and modality.

    Redelivered events keep their day and modality, so new deliveries are only compared with the stored days they touch.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def append(self, deliveries: DataFrame, as_of: float) -> None:
        """Validate deliveries and add the first of each id that is not stored yet."""
        fresh = stored_events(deliveries, as_of)
        try:
            there = self.spark.read.parquet(self.path)
        except AnalysisException:  # nothing stored yet
            append_events(fresh, self.path)
            return
        days = _by_day(fresh).agg(F.min("day").alias("low"), F.max("day").alias("high")).first()
        if days["low"] is not None:
            append_events(fresh.join(there.where(F.col("day").between(days["low"], days["high"])).select("event_id"), "event_id", "left_anti"), self.path)

    def read(self, since: float | None = None, until: float | None = None, modality: str | None = None) -> DataFrame:
        """Stored events between two times (both in) and of a modality: only the days and modalities asked for are read."""
        rows = self.spark.read.parquet(self.path)
        day = lambda t: F.to_date(F.timestamp_seconds(F.lit(t)))
        rows = rows if since is None else rows.where((F.col("day") >= day(since)) & (F.col("timestamp") >= since))
        rows = rows if until is None else rows.where((F.col("day") <= day(until)) & (F.col("timestamp") <= until))
        return (rows if modality is None else rows.where(F.col("modality") == modality)).drop("day")


def backed_up(df: DataFrame, path: str, version: str) -> str:
    """Write a copy under a version's own folder and give its path; an existing version is left as it is."""
    target = f"{path}/version={version}"
    df.write.mode("ignore").parquet(target)
    return target


def synthetic_events(spark: SparkSession, hours: float, start: float, seed: int = 0) -> DataFrame:
    """A day's worth of made-up events at fixed hourly rates: (event_id, timestamp, modality, event_type, correlation_id, payload).

    Screens every 7 s give or take 30 %, 10 dictations, 60 bursts, 200 clicks and 15 clips an hour,
    and 5 workflows of four correlated events. All from ``spark.range`` and seeded hashes, so every run and every retry gives the same rows.
    """
    unit = lambda salt: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(1_000_000)) / 1e6
    span = hours * 3600

    def kind(n: int, modality: str, event: str, at: Column, workflow: Column | None = None) -> DataFrame:
        rows = spark.range(max(n, 0)).select("*", at.alias("timestamp"))
        name = F.substring(F.sha2(F.concat_ws("-", F.lit(event), F.col("id"), F.lit(seed)), 256), 1, 16)
        return rows.select(name.alias("event_id"), "timestamp", F.lit(modality).alias("modality"), F.lit(event).alias("event_type"), (workflow if workflow is not None else F.lit(None)).cast("string").alias("correlation_id"), F.to_json(F.struct(F.lit(1).alias("_soak_test"))).alias("payload"))

    anywhere = lambda salt: start + unit(salt) * span
    parts = [kind(int(span / 7), "sight", "screen_capture", start + (F.col("id") + (unit(1) - 0.5) * 0.6) * 7)]
    parts += [kind(int(rate * hours), m, e, anywhere(n)) for n, (rate, m, e) in enumerate([(10, "voice", "transcription"), (60, "keys", "typing_burst"), (200, "flow", "click"), (15, "clipboard", "clipboard_change")], 2)]
    flow = F.concat(F.lit("wf"), F.lpad(F.col("id").cast("string"), 9, "0"))
    parts += [kind(int(5 * hours), m, e, anywhere(9) + n, flow) for n, (m, e) in enumerate([("sight", "ocr_result"), ("voice", "speech_end"), ("clipboard", "paste_detected"), ("keys", "correction_detected")])]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def best_contexts(spark: SparkSession, folder: str) -> DataFrame:
    """(frame_path, timestamp, monitor_index, type, content): each frame as the text of its JSON companion when that can be read, else as an image (content null)."""
    shown = frames(spark, folder).withColumn("stem", F.regexp_replace("frame_path", r"\.[^.]+$", ""))
    texts = spark.read.option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
    meta = texts.select(F.regexp_replace(F.url_decode("_metadata.file_path"), r"\.[^.]+$", "").alias("stem"), F.try_variant_get(F.try_parse_json("value"), "$.text", "string").alias("content"))
    same = lambda c: F.regexp_replace(c, r"^file:/+", "/")
    joined = shown.withColumn("stem", same("stem")).join(meta.withColumn("stem", same("stem")), "stem", "left")
    return joined.select("frame_path", "timestamp", "monitor_index", F.when(F.col("content").isNotNull(), "text").otherwise("image").alias("type"), "content")


def kept_frames(frames: DataFrame, as_of: float, max_age_seconds: float = 1800.0) -> DataFrame:
    """Frames not older than the buffer's age."""
    return frames.where(F.col("timestamp") >= as_of - max_age_seconds)


def context_vocabulary(projects: DataFrame, skip: tuple[str, ...] = SKIPPED_PHRASES) -> DataFrame:
    """(layer, key, value) of project files (name, value): folder names and names in their beginnings, keyed by their spaced form; the first project by name wins."""
    from tidemark.functions.text import camel_phrase, context_names

    named = projects.select("name", F.posexplode(F.concat(F.array("name"), F.array_sort(context_names(F.col("value"))))).alias("at", "word"))
    phrased = named.withColumn("key", camel_phrase(F.col("word"))).where(F.col("key").isNotNull() & ~F.col("key").isin(*skip))
    return phrased.groupBy("key").agg(F.min_by("word", F.struct("name", "at")).alias("value")).select(F.lit("context").alias("layer"), "key", "value")
