import random

from tests.conftest import rows
from tidemark.functions.clean import app_key, epoch_micros
from tidemark.operators.sessions import sessions

SCHEMA = "event_id string, timestamp double, modality string, app_name string, stream string"


def found(spark, data):
    df = spark.createDataFrame([(*r, "clash") for r in data], SCHEMA)
    return rows(sessions(df).select("first_event_id", "last_event_id", "n_events"))


def test_gap_units_spellings_and_repeats(spark):
    t = 1_700_000_000.0
    data = [
        ("a", t, "sight", "App.exe"),
        ("b", t + 300, " SIGHT", "app "),  # exactly the gap
        ("b", t + 300, "Sight", "APP.EXE"),  # delivered again
        ("c", (t + 600.001) * 1e3, "sight", "app"),  # milliseconds, just over the gap
        ("d", (t + 700) * 1e6, "sight", "app"),
        ("e", t, "sight", None),
        ("f", t + 1, "sight", " "),
        ("g", t, None, "app"),
        ("h", None, "sight", "app"),
        ("i", float("nan"), "sight", "app"),
        ("j", -5.0, "sight", "app"),
        (None, t, "sight", "app"),
    ]
    assert found(spark, data) == [("a", "b", 2), ("c", "d", 2), ("e", "f", 2)]


def test_ties_by_id_and_empty(spark):
    t = 1_700_000_000.0
    assert found(spark, [("z", t, "keys", "x"), ("a", t, "keys", "x")]) == [("a", "z", 2)]
    assert found(spark, []) == []


def test_against_brute_force_over_many_ranges(spark):
    rng = random.Random(3)
    data = [(f"e{n:05}", 1_700_000_000 + rng.randrange(0, 400_000), rng.choice(["sight"] * 6 + ["keys"]), rng.choice(["a", "a", "b"])) for n in range(4000)]
    data = [(i, float(t), m, a) for i, t, m, a in data]
    want, last = [], {}
    for i, t, m, a in sorted(data, key=lambda r: (r[2], r[3], r[1], r[0])):
        key = (m, a)
        if key in last and t - last[key][0] <= 300:
            last[key][1][1:] = [i, last[key][1][2] + 1]
        else:
            entry = [i, i, 1]
            want.append(entry)
            last[key] = [t, entry]
        last[key][0] = t
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert found(spark, data) == sorted((tuple(w) for w in want), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_clean_functions(spark):
    df = spark.createDataFrame([(" Foo.EXE ",), (None,), ("",), (".exe",)], "a string")
    assert [r[0] for r in df.select(app_key(df.a)).collect()] == ["foo", "", "", ""]
    df = spark.createDataFrame([(1.5,), (1.7e12,), (1.7e15,), (1.7e18,), (0.0,), (None,), (float("inf"),)], "t double")
    assert [r[0] for r in df.select(epoch_micros(df.t)).collect()] == [1_500_000, 1_700_000_000_000_000, 1_700_000_000_000_000, 1_700_000_000_000_000, None, None, None]
