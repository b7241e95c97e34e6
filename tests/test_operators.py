import math
import random

import pytest

from tests.conftest import rows
from pyspark.sql import functions as F

from tidemark.functions import text as T
from tidemark.operators import changes, ingest, mining, recent, routing, search, summaries, timejoin

EVENT = "event_id string, timestamp double, modality string, event_type string, app_name string, window_title string, monitor_index int, payload string, created_at double"
NOW = 1_700_000_000.0


def events(spark, data):
    full = [(i, t, m, e, "App", "Title", 0, p, c) for i, t, m, e, p, c in data]
    return spark.createDataFrame(full, EVENT)


def test_validation_reasons(spark):
    df = events(spark, [("a", NOW, "sight", "click", None, 1.0), ("", NOW, "sight", "click", None, 1.0), (None, NOW, "sight", "click", None, 1.0), ("b", NOW + 60, "sight", "click", None, 1.0), ("c", NOW + 61, "sight", "click", None, 1.0), ("d", float("nan"), "sight", "click", None, 1.0), ("e", 0.0, "sight", "click", None, 1.0), ("f", NOW, "Sight", "click", None, 1.0), ("g", NOW, "sight", None, None, 1.0)])
    good, bad = ingest.validated(df, NOW)
    assert {r["event_id"] for r in good.collect()} == {"a", "b"}
    assert sorted(r["reason"] for r in bad.collect()) == ["event type", "future", "modality", "no id", "no id", "no time", "no time"]


def test_first_delivery_wins_and_insert_is_idempotent(spark):
    df = events(spark, [("a", NOW, "sight", "click", '{"n": 2}', 2.0), ("a", NOW, "sight", "click", '{"n": 1}', 1.0), ("b", NOW, "sight", "click", None, None)])
    once = ingest.first_per_key(df, "event_id", "created_at")
    assert rows(once.select("event_id", "payload")) == [("a", '{"n": 1}'), ("b", None)]
    assert ingest.insert_new(once, df, "event_id", "created_at").count() == 0
    assert ingest.first_per_key(df.limit(0), "event_id").count() == 0


def test_upsert_quota_ttl_forget(spark):
    schema = "key string, id bigint, value string, tags array<string>, created_at double, updated_at double"
    df = spark.createDataFrame([("k", 1, "old", ["b", "a"], 1.0, 1.0), ("k", 2, "new", ["c", "a", "a"], 5.0, 6.0), ("n", 3, None, None, None, None)], schema)
    merged = {r["key"]: r for r in ingest.upsert_memories(df).collect()}
    assert (merged["k"]["value"], merged["k"]["created_at"], merged["k"]["tags"]) == ("new", 1.0, ["a", "a", "c"])
    incoming = spark.createDataFrame([("k", 9.0), ("x", 3.0), ("y", 2.0), ("z", 4.0)], "key string, created_at double")
    existing = spark.createDataFrame([("k", 1.0), ("m", 1.0)], "key string, created_at double")
    assert rows(ingest.within_quota(existing, incoming, 3).select("key")) == [("k",), ("y",)]
    assert rows(ingest.within_quota(existing, incoming, 1).select("key")) == [("k",)]
    ttl = spark.createDataFrame([(0.0,), (None,), (1.0,), (1e9,), (-1.0,)], "h double")
    assert [r[0] for r in ttl.select(ingest.expiry(100.0, F.col("h"))).collect()] == [None, None, 3700.0, 100 + 8760 * 3600.0, None]
    kept, asked = ingest.forget(existing, spark.createDataFrame([("k",), ("k",), ("q",)], "key string"))
    assert rows(kept.select("key")) == [("m",)]
    assert rows(asked) == [("k", True), ("q", False)]


def test_late_update_keeps_rows_without_update(spark):
    base = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id bigint, t string")
    late = spark.createDataFrame([(2, "B"), (3, None), (9, "z")], "id bigint, t string")
    assert rows(ingest.late_update(base, late, "id", ["t"])) == [(1, "a"), (2, "B"), (3, "c")]


def test_bounds_of_time_filters(spark):
    df = events(spark, [("a", NOW - 300, "sight", "click", None, 1.0), ("b", NOW - 299, "sight", "click", None, 1.0), ("c", NOW, "voice", "click", None, 1.0)])
    assert [r["event_id"] for r in recent.recent_events(df, NOW).collect()] == ["c", "b"]
    assert rows(recent.around(df, NOW - 295, 5).select("event_id")) == [("a",), ("b",)]
    assert recent.clamp("limit", 9999) == 500 and recent.clamp("hours", 0) == 0.1


def test_blocklist_and_literal_search(spark):
    df = spark.createDataFrame([("My BANK page",), ("other",), ("",), (None,), ("100% a_b",)], "t string")
    assert [r[0] for r in df.select(recent.blocked(df.t, ["bank"])).collect()] == [True, False, False, False, False]
    assert [r[0] for r in df.select(recent.blocked(df.t, [])).collect()] == [False] * 5
    assert [r[0] for r in df.select(recent.contains_text(df.t, "%")).collect()] == [False, False, False, False, True]
    assert [r[0] for r in df.select(recent.contains_text(df.t, "a_b")).collect()] == [False, False, False, False, True]


def test_latest_keeps_ties_and_nearest(spark):
    df = spark.createDataFrame([(1, 0, 5.0), (2, 0, 5.0), (3, 0, 4.0), (4, 1, None)], "id bigint, monitor_index int, timestamp double")
    assert rows(recent.latest_per_group(df, "monitor_index").select("id")) == [(1,), (2,), (4,)]
    assert recent.nearest_row(df, 4.5).collect()[0]["id"] == 1


def test_recall_and_live(spark):
    warm = spark.createDataFrame([("a", "wa"), ("b", "wb")], "key string, value string")
    hot = spark.createDataFrame([("a", "ha", 10.0), ("b", "hb", 9.0)], "key string, value string, expires_at double")
    assert rows(recent.recall(hot, warm, warm.select("key"), 10.0)) == [("a", "ha", "hot"), ("b", "wb", "warm")]
    df = spark.createDataFrame([(10.0,), (10.1,), (None,)], "e double")
    assert [r[0] for r in df.select(recent.live(df.e, 10.0)).collect()] == [False, True, True]


def test_words_for_age_and_change(spark):
    df = spark.createDataFrame([(None,), (9.9,), (10.0,), (59.0,), (60.0,), (3600.0,)], "a double")
    assert [r[0] for r in df.select(recent.freshness(df.a)).collect()] == ["no data", "just now", "10s ago", "59s ago", "1m ago", "1.0h ago"]
    df = spark.createDataFrame([(50.0,), (10.0,), (1.0,), (0.9,), (None,)], "d double")
    assert [r[0] for r in df.select(recent.change_level(df.d)).collect()] == ["major change", "some change", "minor change", "static", "static"]


def test_range_join_bounds_are_out(spark):
    left = spark.createDataFrame([("l", 100.0), ("n", None)], "event_id string, timestamp double")
    right = spark.createDataFrame([("at", 100.0), ("in", 100.1), ("last", 129.9), ("end", 130.0), ("x", float("nan"))], "event_id string, timestamp double")
    assert rows(timejoin.range_join(left, right, 0, 30).select("r_event_id")) == [("in",), ("last",)]
    assert timejoin.range_join(left.limit(0), right, 0, 30).count() == 0


def test_nearest_join_over_empty_buckets(spark):
    probes = spark.createDataFrame([("p", 0.0), ("q", 50_000.0), ("r", 100_000.0), ("z", None)], "pid string, timestamp double")
    data = spark.createDataFrame([("a", 40_000.0), ("b", 60_000.0), ("c", 60_000.0), ("d", 61_000.0)], "rid string, timestamp double")
    assert rows(timejoin.nearest_join(probes, data, "pid", "rid")) == [("p", "a", 40_000.0), ("q", "a", 10_000.0), ("r", "d", 39_000.0)]
    assert timejoin.nearest_join(probes, data.limit(0), "pid", "rid").count() == 0


def test_hash_join_looks_at_the_newest_five(spark):
    said = spark.createDataFrame([(f"v{n}", 100.0 + n, "h" if n == 0 else "x") for n in range(6)] + [("w", 104.5, "k")], "event_id string, timestamp double, hash string")
    pastes = spark.createDataFrame([("p", 106.0, "h"), ("q", 106.0, "k")], "event_id string, timestamp double, hash string")
    assert rows(timejoin.voice_source(pastes, said)) == [("q", "w")]


def test_debounce_is_greedy(spark):
    df = spark.createDataFrame([(n, "m", t) for n, t in enumerate([0.0, 0.06, 0.12, 0.18, 0.22, 5.0])] + [(9, None, 1.0), (10, "m", None)], "id bigint, g string, timestamp double")
    assert rows(changes.debounced(df, "g", 0.1).select("id")) == [(0,), (2,), (4,), (5,)]
    assert changes.debounced(df.limit(0), "g", 0.1).count() == 0


def test_clipboard_rules(spark):
    data = [(1, 0.0, " hello "), (2, 0.5, "too early"), (3, 2.0, "hello"), (4, 4.0, "abc"), (5, 6.0, "x" * 10_001), (6, 8.0, ""), (7, 10.0, None), (8, 12.0, "hello")]
    got = changes.stored_clips(spark.createDataFrame(data, "id bigint, timestamp double, text string")).collect()
    assert sorted(r["id"] for r in got) == [1, 5, 8]
    assert len(next(r["text"] for r in got if r["id"] == 5)) == 10_000 + len(changes.CLIP_SUFFIX)


def test_frames_compare_with_the_last_stored(spark):
    data = [(1, 0, 1.0, [0, 0]), (2, 0, 2.0, [1, 1]), (3, 0, 3.0, [2, 2]), (4, 1, 1.0, [9]), (5, 0, 4.0, [2, 2, 2]), (6, 0, 5.0, None)]
    got = rows(changes.changed_frames(spark.createDataFrame(data, "id bigint, monitor_index int, timestamp double, pixels array<int>")))
    assert [i for i, _ in got] == [1, 3, 4, 5] and got[1][1] > 0.5


def test_typing_bursts(spark):
    keys = [(0.0, "h"), (0.5, "e"), (1.0, "l"), (2.5, "l"), (2.6, None), (10.0, "a")]  # a pause of exactly 1.5 s stays inside
    df = spark.createDataFrame([(t, k, k is None, False) for t, k in keys], "t double, key_char string, is_backspace boolean, is_selection boolean").select(F.timestamp_seconds("t").alias("ts"), "key_char", "is_backspace", "is_selection", F.lit("u").alias("user"))
    got = changes.typing_bursts(df, "user").collect()
    assert len(got) == 1 and (got[0]["char_count"], got[0]["backspace_count"], got[0]["word_count"], got[0]["duration_ms"]) == (4, 1, 1, 4100)


def test_watch_windows_and_replay(spark):
    pastes = spark.createDataFrame([("a", 0.0), ("b", 14.0), ("c", 100.0)], "event_id string, timestamp double")
    focus = spark.createDataFrame([("f", 110.0), ("g", 200.0)], "event_id string, timestamp double")
    assert rows(changes.watch_windows(pastes, focus)) == [("a", 0.0, 14.0), ("b", 14.0, 29.0), ("c", 100.0, 110.0)]
    keys = spark.createDataFrame([("u", 1, "a", False), ("u", 2, "b", False), ("u", 3, None, True), ("u", 4, "c", False), ("v", 1, None, True)], "user string, nth int, key_char string, is_backspace boolean")
    assert rows(changes.replayed(keys, "user")) == [("u", "ac"), ("v", "")]


def test_drags_idle_and_focus(spark):
    df = spark.createDataFrame([(1, "press", 0, 0, 1.0, "l"), (2, "release", 30, 0, 1.5, "l"), (3, "press", 0, 0, 2.0, "l"), (4, "release", 20, 0, 2.5, "l")], "id bigint, kind string, x int, y int, timestamp double, button string")
    assert rows(changes.drags(df)) == [(1, 30.0, 500)]
    titles = spark.createDataFrame([(1, 0, 0.0, "a"), (2, 0, 30.0, ""), (3, 0, 31.0, "a"), (4, 0, 32.0, "b"), (5, 0, 33.0, None)], "id bigint, monitor_index int, timestamp double, window_title string")
    assert rows(changes.focus_changes(titles).select("id")) == [(4,)]
    assert rows(changes.idle_wakes(titles, "monitor_index").select("id", "gap")) == [(2, 30.0)]


def test_summaries_of_nothing(spark):
    none = events(spark, [])
    assert summaries.voice_stats(none, 0.0).first()["dictations"] == 0
    assert summaries.touch_stats(none, 0.0).first()["bursts"] == 0
    assert summaries.scorecard(none, 0.0).first()["rate"] == 0.0
    assert summaries.corrected_words(none).count() == 0


def test_stats_tolerate_broken_payloads(spark):
    df = events(spark, [("a", 10.0, "voice", "transcription", '{"raw_transcript": "x", "transcript": "y", "duration_seconds": 2.5, "cleanup_applied": true}', 1.0), ("b", 11.0, "voice", "transcription", "{broken", 1.0), ("c", 12.0, "keys", "typing_burst", '{"char_count": 5, "wpm": 0}', 1.0), ("d", 13.0, "keys", "correction_detected", '{"original_text": "Foo", "corrected_text": "Bar"}', 1.0)])
    voice = summaries.voice_stats(df, 0.0).first()
    assert (voice["dictations"], voice["seconds"], voice["corrected"], voice["cleanups"]) == (2, 2.5, 1, 1)
    touch = summaries.touch_stats(df, 0.0).first()
    assert (touch["bursts"], touch["chars"], touch["mean_wpm"], touch["corrections"]) == (1, 5, None, 1)
    assert rows(summaries.escalations(df, 0.0, 1)) == [("foo", "Bar", 1)]


def test_weekly_report(spark):
    schema = "date string, correction_rate double, vocab_user_size bigint, vocab_learned_size bigint, vocab_context_size bigint, top_corrected_words array<struct<word:string,count:bigint>>"
    df = spark.createDataFrame([("2024-01-01", 0.5, 1, 2, 3, [("a", 2)]), ("2024-01-02", 0.4, 4, 2, 9, [("a", 1), ("b", 5), ("", 9)])], schema)
    report = summaries.weekly_report(df)
    assert rows(report["growth"].select("user", "learned", "context")) == [(3, 0, 6)]
    assert rows(report["words"]) == [("a", 3), ("b", 5)]
    assert summaries.weekly_report(df.limit(1))["trend"].count() == 0


def test_cold_windows_and_replacement(spark):
    df = spark.createDataFrame([(1, "k1", "v1", 10.0, "voice"), (2, "k2", "", 899.0, None), (3, "k3", None, 900.0, "sight"), (4, "k4", "v", None, "sight")], "id bigint, key string, value string, updated_at double, modality string")
    got = rows(summaries.cold_windows(df).select("window_start", "text_content", "entry_count", "modalities"))
    assert got == [(0.0, "k1\nv1\nk2", 2, ["voice"]), (900.0, "k3", 1, ["sight"])]
    old = spark.createDataFrame([(0.0, "x"), (5.0, "y")], "window_start double, t string")
    assert rows(summaries.replace_windows(old, old.limit(1).select("window_start", F.lit("new").alias("t")))) == [(0.0, "new"), (5.0, "y")]


def test_text_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(T.camel_words(F.lit("The QueueMaster and FooBar, Foo"))) == ["QueueMaster", "FooBar"]
    assert value(T.camel_words(F.lit(None).cast("string"))) == []
    assert value(T.acronyms(F.lit("OK the API is UP, ABCDEFG"))) == ["API"]
    assert value(T.camel_phrase(F.lit("TaskRunner"))) == "task runner"
    assert value(T.camel_phrase(F.lit("AWS"))) is None
    assert value(T.camel_parts(F.lit("MyTaskOk"))) == ["mytaskok", "task"]
    assert value(T.cleaned(F.lit("um so i think the the plan is gonna work , right"))) == "So I think the plan is going to work, right."
    assert value(T.cleaned(F.lit("hello there. what now"))) == "Hello there. What now."
    assert value(T.untitled(F.lit("We Should Really Fix This NOW. Then Go"))) == "We should really fix this NOW. Then go"
    assert value(T.punctuated(F.lit("hello comma world period new line next"))) == "hello, world.\nnext"
    assert value(T.with_vocabulary(F.lit("cube control and Cube"), {"cube control": "kubectl", "cube": "C$"})) == "kubectl and C$"
    assert value(T.redacted(F.lit("password = hunter22 and 4111 1111 1111 1111 and 000-11-2222"))) == "[REDACTED:CREDENTIAL] and [REDACTED:CC] and [REDACTED:SSN]"
    assert value(T.is_chatty(F.lit("i can help with that"))) is True
    assert value(T.guarded_clean(F.lit("hi there"), F.lit("I'm ready to help"))) == "Hi there."
    assert value(T.prompt_of(F.array(F.lit("Foo"), F.lit("foo"), F.lit("Bar")))) == "Foo, Bar"
    assert value(T.prompt_of(F.array(F.lit("Foo"), F.lit("Barista")), 8)) == "Foo"
    assert value(T.is_style_change(F.lit("gonna"), F.lit("going"))) is True
    assert value(T.letter_overlap(F.lit("abc"), F.lit("abd"))) == 2 / 3
    assert value(T.section(F.lit("# X\n## Goals\n- one thing\n- b\n## Next\nz"), "Goals")) == "- one thing\n- b"
    assert value(T.bullets(F.lit("- one thing\n* two things\nno\n- b"))) == ["one thing", "two things"]


def test_mining(spark):
    pairs = spark.createDataFrame([(f"we use cube today {n}", f"we use kube today {n}") for n in range(3)] + [("a b c d", "a b"), ("same", "same"), ("it was nah", "it was good"), (None, "x"), ("x", None)], "raw string, clean string")
    assert rows(mining.learned_corrections(mining.word_changes(pairs))) == [("cube", "kube", 3, 1.0)]
    said = spark.createDataFrame([("open task runner", "open TaskRunner"), ("the task runner", "the TaskRunner"), ("new water", "NewWater")] * 2, "raw string, clean string")
    assert [(r["original"], r["n"]) for r in mining.learned_phrases(said).collect()] == [("task runner", 4)]
    vocabulary = spark.createDataFrame([("context", "A ", "3"), ("user", "a", "1"), ("learned", "a", "2"), ("other", "z", "9"), ("context", "", "9")], "layer string, key string, value string")
    assert rows(mining.layered(vocabulary)) == [("a", "1", "user")]


def test_cross_modal(spark):
    t = 1000.0
    word = '{"original_word": "queue master", "corrected_word": "%s"}'
    data = [("t", t, "voice", "transcription", "{}", 1.0), ("o", t + 1, "sight", "ocr_result", '{"ocr_text": "class QueueMaster:", "ocr_confidence": 0.9}', 1.0), ("c", t + 10, "keys", "correction_detected", word % "QueueMaster", 1.0), ("d", t + 11, "keys", "correction_detected", word % "queuemaster", 1.0), ("late", t + 30, "keys", "correction_detected", word % "QueueMaster", 1.0), ("low", t, "sight", "ocr_result", '{"ocr_text": "OtherThing", "ocr_confidence": 0.5}', 1.0)]
    got = rows(mining.cross_modal(events(spark, data), 0.0).select("correction", "confidence"))
    assert got == [("c", 0.95), ("d", 0.8)]


def test_extract_correction(spark):
    df = spark.createDataFrame([("meet at get hub", "github", 0, True), ("send to jonh", "John", 4, False), ("send to jonh", "jonh", 4, False), ("x", "", 1, False), (None, "a", 1, True)], "o string, t string, b int, s boolean")
    got = [r[0] for r in df.select(mining.extract_correction(df.o, df.t, df.b, df.s)).collect()]
    assert (got[0]["original_word"], got[0]["correction_type"]) == ("get", "select_replace") or got[0]["original_word"] == "hub"
    assert (got[1]["original_word"], got[1]["corrected_word"]) == ("jonh", "john")
    assert got[2] is None and got[3] is None and got[4] is None


def test_full_text_queries(spark):
    docs = spark.createDataFrame([(1, "the quick brown fox", "a"), (2, "quick quick fox", "b"), (3, "lazy dog", "fox"), (4, None, None), (5, "", "Éclair"), (6, "brown quickly", "c")], "id bigint, body string, title string")
    hits = lambda q, **k: [r["id"] for r in search.best(search.full_text(docs, ["body", "title"], q, **k), 10, "id").collect()]
    assert hits("quick fox") == [2, 1]
    assert hits('"brown fox"') == [1]
    assert sorted(hits("quick*")) == [1, 2, 6]
    assert sorted(hits("title:fox OR lazy")) == [3]
    assert sorted(hits("fox NOT quick")) == [3]
    assert hits("eclair") == [5]
    assert sorted(hits("foxes", stemming=True)) == [1, 2, 3]
    assert sorted(hits("NEAR(quick fox, 1)")) == [1, 2] and hits("NEAR(fox quick, 0)") == [2]
    assert hits("NEAR(the fox)") == [1] and hits("NEAR(the fox, 1)") == []
    assert hits("quick AND") == [] and hits("") == []
    assert hits('"lazy') == []
    assert search.full_text(docs.limit(0), ["body"], "fox").count() == 0


def test_bm25_score(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c c"), (3, "d")], "id bigint, body string")
    got = {r["id"]: r["score"] for r in search.full_text(docs, ["body"], "a OR c").collect()}
    idf = math.log((3 - 1 + 0.5) / 1.5)
    assert abs(got[1] - idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 2 / 2))) < 1e-9
    assert abs(got[2] - idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 3 / 2))) < 1e-9


def test_vectors_and_fusion(spark):
    df = spark.createDataFrame([("a", [1.0, 0.0], None), ("b", [0.0, 1.0], None), ("c", [1.0, 1.0], 5.0), ("d", None, None), ("e", [1.0], None), ("f", [0.0, 0.0], None)], "key string, embedding array<float>, expires_at double")
    assert [(r["key"], r["similarity"]) for r in search.semantic(df, [1.0, 0.0], 10.0).collect()][:2] == [("a", 1.0), ("b", 0.0)]
    lists = [spark.createDataFrame(x, "key string, rank int") for x in ([("a", 1), ("b", 2)], [("b", 1), ("c", 2)])]
    assert [r["key"] for r in search.fused(lists, "key", 2).collect()] == ["b", "a"]
    pooled = spark.range(1).select(search.mean_pooled(F.array(F.array(F.lit(3.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(4.0)), F.array(F.lit(9.0), F.lit(9.0))), F.array(F.lit(1), F.lit(1), F.lit(0)))).first()[0]
    assert [round(x, 6) for x in pooled] == [0.6, 0.8]


def test_routing(spark):
    projects = spark.createDataFrame([("TaskRunner", ["task", "runner", "queue"], ["oldname"]), ("Weather", ["rain", "queue"], []), ("None", [], [])], "name string, keywords array<string>, aliases array<string>")
    texts = spark.createDataFrame([(1, "the queue of taskrunner"), (2, "rain and queue"), (3, "nothing"), (4, None), (5, "OLDNAME")], "id bigint, text string")
    got = {(r["id"], r["project"]): r["score"] for r in routing.routed(texts, projects, "id").collect()}
    assert got[(1, "TaskRunner")] == 1.0 and got[(1, "Weather")] < 0.3
    assert got[(2, "Weather")] == 1.0 and (3, "Weather") not in got
    assert got[(5, "TaskRunner")] == 1.0
    where = spark.createDataFrame([("/p/TaskRunner/src", None), ("/q/x", "my weather map"), ("/q", "none of it"), (None, None)], "cwd string, title string")
    found = [r[0] for r in where.select(routing.active_project(where.cwd, where.title, "/p", [("TaskRunner", []), ("Weather", [])])).collect()]
    assert [(x["project"], x["source"]) for x in found] == [("TaskRunner", "cwd"), ("Weather", "title"), (None, None), (None, None)]


def test_text_queries_take_every_feed(spark, tmp_path):
    import __spark_entry__ as entry

    spark.createDataFrame([(1, "voice_raw", "the budget"), (2, "voice_clean", "the budget"), (3, "mail", "the budget"), (4, None, "the budget")], "doc_id bigint, source string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    cleaned = {r["doc_id"]: r["clean"] for r in entry.queries()["i20_cleaned"](spark, str(tmp_path)).collect()}
    assert set(cleaned) == {1, 2, 3, 4} and len(set(cleaned.values())) == 1
    assert {r["doc_id"]: r["text"] for r in entry.queries()["i27_vocabulary"](spark, str(tmp_path)).collect()} == dict.fromkeys((1, 2, 3, 4), "THE Budget$")


def test_debounce_spreads_one_group_over_all_cores(spark):
    rng = random.Random(8)
    for step in (0.4, 3.0):  # without any pause, and with some
        times = sorted(round(rng.uniform(0, step * 3000), 3) for _ in range(3000))
        data = [(n, "one", t) for n, t in enumerate(times)] + [(9000 + n, "two", t) for n, t in enumerate(times[:50])]
        df = spark.createDataFrame(data, "id bigint, g string, timestamp double").repartition(5)
        want, last = set(), {}
        for n, g, t in sorted(data, key=lambda r: (r[1], r[2], r[0])):
            if t >= last.get(g, float("-inf")) + 5.0:
                last[g] = t
                want.add(n)
        got = changes.debounced(df, "g", 5.0)
        assert {r["id"] for r in got.collect()} == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        tasks = df.where("g = 'one'").repartitionByRange("g", "timestamp", "id").select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks == 4  # all of one group
        assert {r["id"] for r in changes.debounced(df, "g", 5.0).collect()} == want
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert changes.debounced(df.limit(0), "g", 5.0).count() == 0


def test_bounded_queue_and_tails(spark):
    from tidemark.operators import queues

    rng = random.Random(5)
    data = [(n, g, round(rng.uniform(0, 400), 2)) for n in range(300) for g in ("a", "b") if g == "a" or n % 9 == 0]
    want = {}
    for g in "ab":
        busy = float("-inf")
        for n, _, t in sorted((r for r in data if r[1] == g), key=lambda r: (r[2], r[0])):
            want[g, n] = busy - t <= 10 * 3.0
            if want[g, n]:
                busy = max(busy, t) + 3.0
    df = spark.createDataFrame([*data, (999, None, 1.0), (998, "a", None)], "id bigint, g string, timestamp double")
    got = {(r["g"], r["id"]): r["accepted"] for r in queues.bounded_queue(df, "g", 3.0).collect()}
    assert got == want and not all(want.values())
    frames = [("x", 0.0, 9.0), ("x", 1.0, 0.1), ("x", 2.0, 9.0), ("x", 3.0, 0.1), ("x", 4.0, None), ("x", 5.0, 0.1), ("x", 7.0, 0.1), ("y", 0.0, 9.0), (None, 0.0, 0.0)]
    ends = {r["s"]: (r["ended_at"], r["silent"]) for r in queues.tail_ends(spark.createDataFrame(frames, "s string, timestamp double, rms double"), "s", 1.0, 2.0, 30.0).collect()}
    assert ends == {"x": (7.0, True), "y": (30.0, False)}
    assert queues.bounded_queue(df.limit(0), "g", 3.0).count() == 0


def test_stored_index_scores_as_a_scan(spark, tmp_path):
    rng = random.Random(2)
    words = "meeting meet schedule budget label the plan plans scheduling é".split()
    text = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 14)))
    docs = spark.createDataFrame([(str(n), text(), text() if n % 5 else None, float(n)) for n in range(120)], "key string, title string, body string, timestamp double")
    for stemming in (False, True):
        index = search.TextIndex(spark, str(tmp_path / f"index-{stemming}"), "key", ["title", "body"], ("timestamp",), stemming)
        index.append(docs.where("timestamp < 70"))
        index.append(docs.where("timestamp >= 70"))
        for query in ("schedule", "meet* NOT label", '"the plan"', '"the pl"*', "NEAR(budget schedule, 2)", "title: budget AND (plan OR label)", "e", "nowhere", "schedule meeting"):
            want = {r["key"]: round(r["score"], 9) for r in search.full_text(docs, ["title", "body"], query, stemming).collect()}
            assert {r["key"]: round(r["score"], 9) for r in index.search(query).collect()} == want
    with pytest.raises(ValueError):
        index.search("NOT label")
    plan = index.search("schedule")._jdf.queryExecution().optimizedPlan().toString()
    assert "__word" in plan


def test_previous_rows_across_ranges(spark):
    from tidemark.operators.ordered import with_previous

    rng = random.Random(4)
    data = [(n, rng.choice(["a", "a", "a", "b", None]), float(rng.randrange(200)), rng.choice(["x", "y", None])) for n in range(400)]
    df = spark.createDataFrame(data, "id bigint, g string, timestamp double, v string")
    want, last = {}, {}
    for n, g, t, v in sorted(data, key=lambda r: (r[1] or "", r[2], r[0])):
        want[n] = (g in last, last.get(g))
        last[g] = v
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        got = {r["id"]: (r["has_previous"], r["previous_v"]) for r in with_previous(df, "g", "timestamp", "id", ["v"]).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == want
    assert with_previous(df.limit(0), "g", "timestamp", "id", ["v"]).count() == 0
