"""Filling prompts of fixed capacity with whole texts."""

from __future__ import annotations

import bisect
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.encode import VOCABULARY, encode_corpus
from tidemark.plans.durable import durable

#: Length buckets of one capacity.
MAX_BUCKETS = 512
#: Lengths of all windows together, one row of the histogram each, that the driver may hold.
MAX_LENGTHS = 5_000_000
#: Items of one length that are numbered by one task.
ITEMS_PER_SALT = 200_000


def bucket_bounds(histogram: dict[int, int], max_buckets: int) -> list[int]:
    """Upper bounds of at most ``max_buckets`` length buckets with the least padding in all.

    Dynamic programming over the histogram: each bucket costs its padding and a fixed price, lines
    in the bucket's bound are kept as a lower hull, and the price is raised until few enough
    buckets are left. With no more lengths than buckets every length is a bucket and nothing is padded.
    """
    lengths = sorted(histogram)
    if len(lengths) <= max_buckets:
        return lengths

    def best(price: float) -> list[int]:
        # cost of a bucket (i, j]: length[j] * (items[j] - items[i]) - (total[j] - total[i]) + price
        hull: list[tuple[int, float, int]] = [(0, 0.0, 0)]  # slope -items, intercept cost + total, position
        back, items, total = [0] * (len(lengths) + 1), 0, 0
        for j, length in enumerate(lengths, 1):
            items += histogram[length]
            total += length * histogram[length]
            low, high = 0, len(hull) - 1
            while low < high:
                mid = (low + high) // 2
                if hull[mid][0] * length + hull[mid][1] > hull[mid + 1][0] * length + hull[mid + 1][1]:
                    low = mid + 1
                else:
                    high = mid
            slope, intercept, back[j] = hull[low]
            cost = slope * length + intercept + length * items - total + price
            line = (-items, cost + total, j)
            while len(hull) > 1 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                hull.pop()
            hull.append(line)
        bounds, j = [], len(lengths)
        while j:
            bounds.append(lengths[j - 1])
            j = back[j]
        return bounds[::-1]

    low, high = 0.0, float(lengths[-1]) * sum(histogram.values())
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if len(best(mid)) > max_buckets else (low, mid)
    return best(high)


@dataclass
class Segment:
    """``count`` items of a bucket from rank ``rank`` on fill containers from ``container`` on, ``each`` to one."""

    rank: int
    count: int
    container: int
    each: int


def fill(sizes: dict[int, int], capacity: int) -> tuple[dict[int, list[Segment]], int]:
    """Best fit, largest first, over the counts of equal sizes: the segments of each size, and the number of containers.

    Containers with the same room are kept as intervals, so the work grows with the number of
    sizes, not of items.
    """
    rooms: list[int] = []  # sorted, each with its intervals of containers
    of_room: dict[int, list[tuple[int, int]]] = {}
    plan: dict[int, list[Segment]] = {}
    used = 0

    def add(room: int, begin: int, count: int) -> None:
        if count and room:
            if room not in of_room:
                bisect.insort(rooms, room)
            of_room.setdefault(room, []).append((begin, count))

    for size in sorted(sizes, reverse=True):
        rank, left, plan[size] = 0, sizes[size], []
        while left:
            at = bisect.bisect_left(rooms, size)
            if at == len(rooms):  # new containers
                each = capacity // size
                add(capacity, used, -(-left // each))
                used += -(-left // each)
                continue
            room = rooms[at]
            begin, count = of_room[room].pop()
            if not of_room[room]:
                del of_room[room], rooms[at]
            each = min(room // size, left)
            whole = min(count, left // each)
            plan[size].append(Segment(rank, whole * each, begin, each))
            add(room - each * size, begin, whole)
            add(room, begin + whole, count - whole)
            rank, left = rank + whole * each, left - whole * each
    return plan, used


def _ranked(items: DataFrame) -> DataFrame:
    """Items (window_id, bucket, ...) with their rank inside their bucket, from 0; a hot bucket is numbered in salted parts."""
    keys = ["window_id", "bucket", "salt"]
    counts = items.groupBy("window_id", "bucket").agg(F.count("*").alias("in_bucket"))
    salted = items.join(counts, ["window_id", "bucket"]).withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.ceil(F.col("in_bucket") / ITEMS_PER_SALT))).drop("in_bucket")
    parts = salted.groupBy(*keys).agg(F.count("*").alias("n"))
    order = Window.partitionBy("window_id", "bucket").orderBy("salt")
    before = parts.select(*keys, (F.sum("n").over(order) - F.col("n")).alias("before"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("doc_id", "part")) - 1
    return salted.withColumn("inside", inside).join(before, keys).withColumn("rank", F.col("inside") + F.col("before")).drop("inside", "before", "salt")


def pack_sizes(sizes: DataFrame, windows: DataFrame, max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """Put every item of (doc_id, n_tokens) into a container of each capacity of ``windows`` (window_id, capacity_tokens).

    The global histogram of lengths, at most one count for each length up to the capacity, is the
    only thing the driver sees; capacities of more than ``MAX_LENGTHS`` together are refused with an error. Dynamic programming cuts it into buckets with the least padding;
    containers are then filled with items of a bucket's bound, best fit first, so that what one
    bucket leaves over is used by another. An item above the capacity alone is split: full
    containers, and the rest as an item of its own. Items of no tokens go to container 0, which
    then exists in any case. No window, or one without a positive capacity, gives no row. Columns:
    window_id, capacity_tokens, doc_id, part, n_tokens, prompt_id.
    """
    spark = sizes.sparkSession
    within = windows.where("window_id is not null and capacity_tokens > 0").select("window_id", "capacity_tokens").distinct()
    if (within.agg(F.sum(F.col("capacity_tokens").cast("bigint"))).first()[0] or 0) > MAX_LENGTHS:
        raise ValueError(f"the capacities of all windows together exceed {MAX_LENGTHS} tokens")
    wanted = [(w["window_id"], w["capacity_tokens"]) for w in within.collect()]
    schema = "window_id int, capacity_tokens int, doc_id bigint, part int, n_tokens bigint, prompt_id bigint"
    if not wanted:
        return spark.createDataFrame([], schema)
    capacity = F.create_map(*(F.lit(x) for pair in wanted for x in pair))
    each = sizes.select("doc_id", F.col("n_tokens").cast("bigint").alias("n_tokens"), F.explode(F.array(*(F.lit(w) for w, _ in wanted))).alias("window_id")).withColumn("capacity_tokens", capacity[F.col("window_id")])
    # parts 0 .. n-1: full containers; the last one: what is left of an item, or all of it
    parts = F.sequence(F.lit(0), F.greatest(F.ceil(F.col("n_tokens") / F.col("capacity_tokens")).cast("int") - 1, F.lit(0)))
    items = each.withColumn("part", F.explode(parts)).withColumn("n_tokens", F.least("capacity_tokens", F.col("n_tokens") - F.col("part").cast("bigint") * F.col("capacity_tokens")))
    plans, bounds = [], {}
    counted = items.where("n_tokens > 0").groupBy("window_id", "n_tokens").agg(F.count("*").alias("n")).collect()
    histograms: dict[int, dict[int, int]] = {window: {} for window, _ in wanted}
    for r in counted:
        histograms[r["window_id"]][r["n_tokens"]] = r["n"]
    for window, size in wanted:
        histogram = histograms[window]
        bounds[window] = bucket_bounds(histogram, max_buckets)
        filled: dict[int, int] = {}
        for length, n in histogram.items():
            bound = bounds[window][bisect.bisect_left(bounds[window], length)]
            filled[bound] = filled.get(bound, 0) + n
        plan, _ = fill(filled, size)
        plans += [(window, bucket, [(s.rank, s.container, s.each) for s in segments]) for bucket, segments in plan.items()]
    # both tables have at most one row for each token of a capacity
    planned = spark.createDataFrame(plans, "window_id int, bucket bigint, segments array<struct<rank:bigint,container:bigint,each:bigint>>")
    lengths = spark.createDataFrame([(w, length, b[bisect.bisect_left(b, length)]) for w, b in bounds.items() for length in histograms[w]], "window_id int, n_tokens bigint, bucket bigint")
    ranked = _ranked(items.where("n_tokens > 0").join(F.broadcast(lengths), ["window_id", "n_tokens"]))
    last = F.element_at(F.filter("segments", lambda s: s["rank"] <= F.col("rank")), -1)
    placed = ranked.join(F.broadcast(planned), ["window_id", "bucket"]).withColumn("s", last)
    prompts = placed.withColumn("prompt_id", F.expr("s.container + (rank - s.rank) div s.each"))
    empty = items.where("n_tokens = 0").withColumn("prompt_id", F.lit(0).cast("bigint"))
    columns = ["window_id", "capacity_tokens", "doc_id", "part", "n_tokens", "prompt_id"]
    return prompts.select(*columns).unionByName(empty.select(*columns))


def pack_documents(documents: DataFrame, windows: DataFrame, vocabulary: str = VOCABULARY, max_buckets: int = MAX_BUCKETS) -> DataFrame:
    """Prompts of each window's capacity for all texts, sized in tokens of the public tokenizer; null and empty texts have size 0.

    Rows without doc_id are left out; doc_id is taken to be unique.
    """
    sizes = durable(encode_corpus(documents.where("doc_id is not null"), vocabulary=vocabulary).select("doc_id", "n_tokens"))
    return pack_sizes(sizes, windows, max_buckets)
