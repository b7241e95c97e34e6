import json

from tests.conftest import rows

from tidemark.operators.routing import parsed_projects
from tidemark.sources import files
from tidemark.streaming import events as S


def test_projects(spark, tmp_path):
    for name, body in (("TaskRunner", "# T\n## Overview\nRuns nightly batches. Formerly OldName.\n\nmore\n## Goals\n- Schedule nightly batches. Later more\n## Tech Stack\n- Python, spark\nSee run.example.io\n"), (".hidden", "x"), ("_PROJECT_TEMPLATE", "y")):
        (tmp_path / name).mkdir()
        (tmp_path / name / files.CONTEXT_FILE).write_text(body)
    got = parsed_projects(files.project_files(spark, str(tmp_path))).collect()
    assert [r["name"] for r in got] == ["TaskRunner"]
    assert got[0]["aliases"] == ["OldName"] and got[0]["goals"] == ["Schedule nightly batches. Later more"]
    assert {"taskrunner", "python", "spark", "schedule", "oldname"} <= set(got[0]["keywords"])


def test_frames(spark, tmp_path):
    for name in ("1000_m1.jpg", "1000_m1.txt", "2000_m0.txt", "3000.jpg", "other.jpg"):
        (tmp_path / name).write_text("x")
    got = rows(files.frames(spark, str(tmp_path)).select("timestamp", "monitor_index", "kind"))
    assert got == [(1.0, 1, "jpg"), (2.0, 0, "txt"), (3.0, 0, "jpg")]


def test_vocabulary_and_metrics(spark, tmp_path):
    (tmp_path / "v.json").write_text(json.dumps({"cube control": "kubectl"}))
    (tmp_path / "bad.json").write_text("[1, 2")
    assert rows(files.vocabulary_file(spark, str(tmp_path / "v.json"), "user")) == [("user", "cube control", "kubectl")]
    assert files.vocabulary_file(spark, str(tmp_path / "bad.json"), "user").count() == 0
    (tmp_path / "m.jsonl").write_text('{"date": "2024-01-01", "correction_rate": 0.5}\nbroken\n')
    assert files.metrics_history(spark, str(tmp_path / "m.jsonl")).count() == 1
    df = spark.createDataFrame([("p", "note")], "project string, text string")
    files.append_journal(df, str(tmp_path / "j"))
    files.append_journal(df, str(tmp_path / "j"))
    assert spark.read.parquet(str(tmp_path / "j")).count() == 2
    path = files.backed_up(df, str(tmp_path / "b"), "1")
    assert spark.read.parquet(path).count() == 1


def test_synthetic_events_are_the_same_every_time(spark):
    one, two = (files.synthetic_events(spark, 2, 1.7e9, 3) for _ in range(2))
    assert rows(one) == rows(two)
    counts = {r["event_type"]: r["count"] for r in one.groupBy("event_type").count().collect()}
    assert counts["click"] == 400 and counts["ocr_result"] == 10


SCHEMA = "event_id string, timestamp double, modality string, event_type string, app_name string"


def stream(spark, folder, data):
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(SCHEMA).parquet(str(folder))


def drained(spark, df, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


T0 = 1_700_000_000.0
NOW = "2023-11-15 00:00:00"


def test_ingest_dedup_and_isolated_sinks(spark, tmp_path):
    data = [("a", T0, "sight", "click", "x"), ("a", T0, "sight", "click", "x"), ("b", T0 + 1, "bad", "click", "x"), ("c", T0 * 1e3, "sight", "click", "x"), (None, T0, "sight", "click", "x")]
    source = stream(spark, tmp_path / "in", data)
    seen = []

    def broken(batch, number):
        raise RuntimeError("sink down")

    query = S.fan_out(S.deduplicated(S.valid_stream(source, NOW)), {"broken": broken, "good": lambda b, n: seen.extend(r["event_id"] for r in b.collect())}, str(tmp_path / "cp"))
    query.awaitTermination()
    assert seen == ["a"]


def test_fan_out_reads_tables_of_one_file_and_of_parts(spark, tmp_path):
    from tidemark.queries.more import a4_fan_out

    source = spark.read.parquet("/root/testdata/sf0.001/spine_events.parquet")
    want = rows(a4_fan_out(spark, "/root/testdata/sf0.001"))
    source.repartition(3).write.parquet(str(tmp_path / "spine_events.parquet"))
    assert want and rows(a4_fan_out(spark, str(tmp_path))) == want
    (tmp_path / "none").mkdir()
    source.where("false").write.parquet(str(tmp_path / "none" / "spine_events.parquet"))
    assert rows(a4_fan_out(spark, str(tmp_path / "none"))) == []


def test_stream_sessions_rollup_and_debounce(spark, tmp_path):
    data = [(f"e{n}", T0 + t, "sight", "click", "App") for n, t in enumerate([0, 100, 500, 501, 50_000])]
    source = S.with_time(stream(spark, tmp_path / "in", data))
    got = drained(spark, S.stream_sessions(source), "sessions_out").select("n_events").collect()
    assert sorted(r[0] for r in got) == [2, 2]
    got = drained(spark, S.stream_rollup(source), "rollup_out").select("n").collect()
    assert sum(r[0] for r in got) == 4
    got = drained(spark, S.stream_debounced(source, "modality", 200.0), "debounce_out").select("event_id").collect()
    assert sorted(r[0] for r in got) == ["e0", "e2", "e4"]


def test_journal_program(tmp_path):
    from tidemark.sources.files import run_journal

    done = run_journal([("p", "note")], ["sh", "-c", "cat; echo $0"])
    assert done == [("p", True, "notep")]
    failed = run_journal([("p", "note"), ("q", "note")], ["sh", "-c", "echo no >&2; exit 3"])
    assert [r[1] for r in failed] == [False, False] and failed[0][2] == "no"
    assert run_journal([("p", "x")], ["sh", "-c", "sleep 5"], timeout=0.2)[0][1:] == (False, "no answer within 0.2 s")
    assert run_journal([("p", "x")], ["/no/such/program"])[0][1] is False


def test_event_store_keeps_the_first_delivery_and_reads_few_days(spark, tmp_path, capsys):
    from tidemark.sources.files import EventStore

    schema = "event_id string, timestamp double, modality string, event_type string, app_name string, window_title string, monitor_index int, payload string, created_at double"
    row = lambda i, t, p, c: (i, t, "sight", "click", "A", "T", 0, p, c)
    day = 86_400.0
    store = EventStore(spark, str(tmp_path / "events"))
    store.append(spark.createDataFrame([row("a", 5 * day, "1", 2.0), row("a", 5 * day, "0", 1.0), row("b", 7 * day, "1", 1.0), row("", 7 * day, "1", 1.0)], schema), 9 * day)
    store.append(spark.createDataFrame([row("a", 5 * day, "2", 3.0), row("c", 6 * day, "1", 1.0), row("d", 99 * day, "1", 1.0)], schema), 9 * day)
    assert sorted((r["event_id"], r["payload"]) for r in store.read().collect()) == [("a", "0"), ("b", "1"), ("c", "1")]
    some = store.read(since=6 * day, modality="sight")
    assert sorted(r["event_id"] for r in some.collect()) == ["b", "c"]
    some.explain("formatted")
    filters = next(line for line in capsys.readouterr().out.splitlines() if line.startswith("PartitionFilters"))
    assert "day" in filters and "modality" in filters
