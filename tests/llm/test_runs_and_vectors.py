import random

import numpy as np

from tests.conftest import rows
from tidemark.llm.neighbours import similar_vectors
from tidemark.llm.runs import boundary_lookup, title_subject, window_runs

ACTIVITY = "id bigint, timestamp double, monitor_index int, app_name string, window_title string, stream string, subject string"
T0 = 1_700_000_000.0


def runs(spark, data):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in data], ACTIVITY)
    return rows(window_runs(df).select("monitor_index", "first_id", "last_id", "n_captures"))


def test_runs(spark):
    data = [
        (1, T0, 0, "App.exe", "File 1 - App"),
        (2, T0 + 600, 0, "app", "(3) file 1 - app [12 %]"),  # exactly the pause
        (3, T0 + 1200.5, 0, "APP", "File 1 - App"),  # over it
        (4, T0 + 1201, 0, "App", "File 2 - App"),
        (4, T0 + 1201, 0, "App", "File 2 - App"),  # delivered again
        (6, T0 + 1202, 0, None, None),
        (5, T0 + 1202, 0, " ", ""),  # equal times: smaller id first
        (7, None, 0, "App", "File 2 - App"),
        (None, T0, 0, "App", "File 2 - App"),
        (8, T0, None, "App", "x"),
        (9, T0, 1, "App", "File 1 - App"),
    ]
    assert runs(spark, data) == sorted([(0, 1, 2, 2), (0, 3, 3, 1), (0, 4, 4, 1), (0, 5, 6, 2), (None, 8, 8, 1), (1, 9, 9, 1)], key=str)
    assert runs(spark, []) == []


def test_subjects(spark):
    same = ["Report.md - Pad", "* report.md - pad", "● Report.md - Pad", "Report.md* - Pad", "Report.md [modified] - Pad", "Report.md — Edited - Pad", "(12) Report.md - Pad", "Loading… Report.md - Pad", "48% - Report.md - Pad", "Report.md - Pad (Not Responding)", "0:01:22 Report.md - Pad", "⠸ Report.md - Pad", "Report.md - Pad [7 new]", " Report.md -  Pad "]
    other = ["Report2.md - Pad", "Chapter 4 - Pad", "Chapter 5 - Pad", "Report (4).md - Pad", "#12 - Pad", "#13 - Pad", "100 Ways - Pad", "~/a - Pad"]
    df = spark.createDataFrame([(t,) for t in same + other], "t string")
    out = [r[0] for r in df.select(title_subject(df.t)).collect()]
    assert len(set(out[: len(same)])) == 1
    assert len(set(out)) == 1 + len(other)


def test_boundary_lookup():
    assert boundary_lookup(np.array([0, 3, 4]), 9).tolist() == [3, 1, 5]


VECTORS = "id bigint, embedding array<float>, updated_at double, q string, cosine string"


def near(spark, data, k=5, dims=4, block=3):
    df = spark.createDataFrame([(i, v, u, "x", "y") for i, v, u in data], VECTORS)
    return {(r["id"], r["neighbour_id"]) for r in similar_vectors(df, dimensions=dims, k=k, block_rows=block).collect()}


def brute(data, k):
    last = {}
    for i, v, u in data:
        if i is not None and v is not None and len(v) == 4 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            last[i] = max(last.get(i, (-1, None)), (u or -1, v), key=lambda x: x[0])
    out = set()
    unit = {i: np.array(v, np.float32).astype(float) / np.linalg.norm(np.array(v, np.float32).astype(float)) for i, (_, v) in last.items()}
    for i in unit:
        order = sorted((-round(float(unit[i] @ unit[j]), 12), j) for j in unit if j != i)
        out |= {(i, j) for _, j in order[:k]}
    return out


def test_neighbours_equal_brute_force(spark):
    rng = random.Random(2)
    data = [(i, [rng.gauss(0, 1) for _ in range(4)], 1.0) for i in range(40)]
    data += [(100 + i, data[0][1], 1.0) for i in range(12)]  # copies
    data += [(200, [x * 2 for x in data[1][1]], 1.0), (3, data[3][1], 2.0)]  # another norm; delivered again
    data += [(300, None, 1.0), (301, [], 1.0), (302, [0.0] * 4, 1.0), (303, [float("nan")] * 4, 1.0), (304, [1.0] * 3, 1.0), (305, [None, 1.0, 1.0, 1.0], 1.0), (None, [1.0] * 4, 1.0), (306, [float("inf"), 1.0, 1.0, 1.0], 1.0)]
    assert near(spark, data) == brute(data, 5)


def test_few_or_no_vectors(spark):
    assert near(spark, []) == set()
    assert near(spark, [(1, [1.0, 0.0, 0.0, 0.0], 1.0)]) == set()
    assert near(spark, [(1, [1.0, 0.0, 0.0, 0.0], None), (2, [0.5, 1.0, 0.0, 0.0], None)]) == {(1, 2), (2, 1)}
