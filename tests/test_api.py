from tests.conftest import rows
from tests.test_operators import EVENT, events

from tidemark import api
from tidemark.operators import changes
from tidemark.plans.consolidation import consolidated
from tidemark.sources import files

NOW = 10_000.0


def test_event_tools(spark):
    df = events(spark, [("a", NOW - 10, "sight", "ocr_result", '{"ocr_text": "the FooBar page", "ocr_confidence": 0.9}', 1.0), ("b", NOW - 5, "keys", "typing_burst", '{"wpm": 40, "word_count": 3}', 1.0), ("c", NOW - 90_000, "voice", "transcription", None, 1.0)])
    assert [r["event_id"] for r in api.search_all_events(df, "foobar", NOW).collect()] == ["a"]
    assert api.search_all_events(df, "foobar", NOW, blocklist=["title"]).count() == 0
    assert [(r["event_id"], r["extras"]) for r in api.get_event_timeline(df, NOW).collect()] == [("a", "ocr_conf=90%"), ("b", "wpm=40  words=3")]
    assert api.get_recent_transcriptions(df, NOW).count() == 0
    assert api.get_touch_stats(df, NOW).first()["bursts"] == 1
    assert api.check_corrections(df, NOW).count() == 0
    assert api.get_event_timeline(spark.createDataFrame([], EVENT), NOW).count() == 0


def test_memory_tools(spark):
    schema = "key string, id bigint, value string, tags array<string>, created_at double, updated_at double, expires_at double, embedding array<float>, tags_text string"
    have = spark.createDataFrame([("a", 1, "red fox", ["x"], 1.0, 1.0, None, [1.0, 0.0], "x")], schema)
    new = spark.createDataFrame([("b", 2, "blue fox", ["y"], 2.0, 2.0, 5.0, [0.0, 1.0], "y"), ("a", 3, "green fox", ["z"], 3.0, 3.0, None, [1.0, 1.0], "z")], schema)
    full = api.memory_store(have, new, 2)
    assert rows(full.select("key", "value")) == [("a", "green fox"), ("b", "blue fox")]
    assert rows(api.memory_store(have, new, 1).select("key", "value")) == [("a", "green fox")]
    assert [r["key"] for r in api.memory_list(full, 10.0).collect()] == ["a"]
    assert [r["key"] for r in api.memory_search(full, "fox blue", None, 1.0, "keyword").collect()] == ["b"]
    assert [r["key"] for r in api.memory_search(full, "fox", [0.0, 1.0], 1.0, "semantic").collect()] == ["b", "a"]
    assert {r["key"] for r in api.memory_search(full, "fox", [0.0, 1.0], 1.0).collect()} == {"a", "b"}


def test_consolidation(spark):
    pair = '{"raw_transcript": "open task runner now", "transcript": "open TaskRunner now"}'
    df = events(spark, [(f"t{n}", NOW - n, "voice", "transcription", pair, 1.0) for n in range(2)] + [(f"o{n}", NOW - n, "sight", "ocr_result", '{"ocr_text": "see QueueMaster", "ocr_confidence": 0.9}', 1.0) for n in range(3)])
    clips = spark.createDataFrame([(1, "CopyCat here")], "id bigint, text string")
    have = spark.createDataFrame([("user", "foo", "Foo1"), ("context", "foo", "Foo2")], "layer string, key string, value string")
    kept, audit = consolidated(df, clips, have, NOW)
    assert rows(kept) == [("context", "queue master", "QueueMaster"), ("learned", "task runner", "TaskRunner"), ("user", "foo", "Foo1")]
    assert dict(rows(audit)) == {"session_learned": 1, "cross_modal": 0, "ocr_harvested": 1, "clipboard_harvested": 1, "escalated": 0, "deduplicated": 1}


def test_crossings_and_repeats(spark):
    moves = spark.createDataFrame([(1, "u", 1.0, 0, 0, 0), (2, "u", 2.0, 300, 0, 1), (3, "u", 3.0, 310, 0, 0), (4, "u", 4.0, 600, 0, 1), (5, "u", 5.0, 0, 0, 0)], "id bigint, user string, timestamp double, x int, y int, monitor_index int")
    assert rows(changes.monitor_crossings(moves, "user").select("id", "from_monitor", "to_monitor")) == [(2, 0, 1), (5, 1, 0)]
    clips = spark.createDataFrame([(1, 0.0, "a"), (2, 5.0, "a"), (3, 6.0, "b"), (4, 12.0, "a"), (5, 1.0, None)], "id bigint, timestamp double, text string")
    assert rows(changes.without_repeated_content(clips, "text", 10.0).select("id")) == [(1,), (3,), (4,), (5,)]


def test_file_contexts(spark, tmp_path):
    (tmp_path / "1000_m1.jpg").write_text("x")
    (tmp_path / "1000_m1.txt").write_text('{"text": "hello"}')
    (tmp_path / "2000_m0.jpg").write_text("x")
    (tmp_path / "2000_m0.txt").write_text("broken")
    got = files.best_contexts(spark, str(tmp_path))
    assert rows(got.select("timestamp", "type", "content")) == [(1.0, "text", "hello"), (2.0, "image", None)]
    assert files.kept_frames(got, 1801.5).count() == 1
    projects = spark.createDataFrame([("TaskRunner", "uses 'Kubernetes' and QueueMaster"), ("Zed", "QueueMaster IslandModel")], "name string, value string")
    assert rows(files.context_vocabulary(projects)) == [("context", "queue master", "QueueMaster"), ("context", "task runner", "TaskRunner")]
