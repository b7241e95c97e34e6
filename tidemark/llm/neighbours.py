"""The k most similar vectors of every vector, by a block matrix join over int8 codes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.durable import durable

#: Vectors in a block, and in a leaf of it, whose centre and radius are known.
BLOCK_ROWS = 8192
LEAF_ROWS = 256
#: Vectors of a side of a tile, at most; a tile holds two sides, 150 bytes a vector.
SIDE_ROWS = 262_144
#: Vectors, those with the smallest marks, by which the others are put in order: neighbours come to lie in the same block.
#: They only decide about the layout, never about a result.
PIVOTS = 256
#: Slack for rounding in float32 products, added to every error bound.
ROUNDING = 2e-6
#: Marks that a scan remembers to pass on copies only once.
REMEMBERED = 100_000


def _good(v: Column, dimensions: int) -> Column:
    return (F.size(v) == dimensions) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)


def usable_vectors(df: DataFrame, key: str, vector: str, dimensions: int, newest: str | None) -> DataFrame:
    """(id, at, h1, h2, v): rows with an id and a usable vector; h1 and h2 are marks of the vector.

    Left out: null ids, and vectors that are null, of another length, all zero or holding a null, NaN or infinite value.
    """
    rows = df.select(F.col(key).alias("id"), (F.col(newest) if newest else F.lit(0)).alias("at"), F.col(vector).cast("array<float>").alias("v"))
    good = rows.where(F.col("id").isNotNull() & _good(F.col("v"), dimensions))
    return good.select("id", "at", F.xxhash64("v").alias("h1"), F.xxhash64(F.reverse("v"), F.lit(1)).alias("h2"), "v")


def unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors in doubles, scaled to norm 1 without overflow or underflow."""
    exact = vectors.astype(np.float64)
    exact /= np.abs(exact).max(1, initial=0)[:, None]
    return exact / np.linalg.norm(exact, axis=1)[:, None]


def _matrix(column: pa.Array, dimensions: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, dimensions)


def _placed(pivots: np.ndarray, dimensions: int):
    """(h1, h2, v) with the nearest pivot; copies that come soon after another are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            marks = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            if len(seen) > REMEMBERED:
                seen.clear()
            fresh = []
            for n, mark in enumerate(marks):
                if mark not in seen:
                    seen.add(mark)
                    fresh.append(n)
            kept = batch.take(pa.array(fresh, pa.int64()))
            near = (unit(_matrix(kept.column(2), dimensions)).astype(np.float32) @ pivots.T).argmax(1) if len(fresh) else np.array([], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(near.astype(np.int32)), *kept.columns], ["pivot", "h1", "h2", "v"])

    return run


def quantised(exact: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes, scale, left out): int8 codes of unit vectors, what one step of them is worth, and the norm of what they miss."""
    scale = (np.abs(exact).max(1, initial=0) / 127).astype(np.float32)
    codes = np.rint(exact / scale[:, None]).astype(np.int8)
    missed = np.linalg.norm(exact - codes * scale[:, None].astype(np.float64), axis=1)
    return codes, scale, np.nextafter(missed.astype(np.float32), np.float32(1))


_PACKED = "block bigint, h1 binary, h2 binary, codes binary, scale binary, missed binary"


def _pack(block_rows: int, dimensions: int):
    """Rows of a partition, in order, into blocks of int8 codes; neighbours with equal marks are one vector."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        block, held, size, last = TaskContext.get().partitionId() << 24, [], 0, None

        def full(parts: list[tuple]) -> pa.RecordBatch:
            h1, h2, v = (np.concatenate([p[n] for p in parts]) for n in range(3))
            values = (h1, h2, *quantised(unit(v)))
            return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int64())} | {n: pa.array([x.tobytes()], pa.binary()) for n, x in zip(("h1", "h2", "codes", "scale", "missed"), values)})

        for batch in batches:
            h1, h2, v = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2), dimensions)
            if not len(h1):
                continue
            new = np.ones(len(h1), bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            new[0] = last != (h1[0], h2[0])
            last = (h1[-1], h2[-1])
            h1, h2, v = h1[new], h2[new], v[new]
            at = 0
            while at < len(h1):
                take = min(block_rows - size, len(h1) - at)
                held.append((h1[at : at + take], h2[at : at + take], v[at : at + take]))
                size, at = size + take, at + take
                if size == block_rows:
                    yield full(held)
                    block, held, size = block + 1, [], 0
        if held:
            yield full(held)

    return pack


class _Block:
    """A block of codes: ids, thresholds, leaves, and the codes as float32, whose products of whole numbers are exact."""

    def __init__(self, row: dict, dimensions: int):
        self.ids = np.frombuffer(row["ids"], np.int64)
        self.number = row["block"]
        self.codes = np.frombuffer(row["codes"], np.int8).reshape(-1, dimensions)
        self.scale, self.missed = (np.frombuffer(row[n], np.float32) for n in ("scale", "missed"))
        self.least = np.frombuffer(row["least"], np.float32).copy() if row.get("least") is not None else np.full(len(self.ids), -2, np.float32)
        begins = np.arange(0, len(self.ids), LEAF_ROWS)
        self.leaves = [slice(b, min(b + LEAF_ROWS, len(self.ids))) for b in begins]
        if row.get("centres") is not None:
            self.centres = np.frombuffer(row["centres"], np.float32).reshape(-1, dimensions)
            self.radius = np.frombuffer(row["radius"], np.float32)

    def wide(self) -> np.ndarray:
        return self.codes.astype(np.float32)

    def leaf_shapes(self) -> tuple[np.ndarray, np.ndarray]:
        """Centre of each leaf and the largest angle of its vectors with it, what the codes miss included."""
        values = self.codes * self.scale[:, None]
        centres, radius = [], []
        for leaf in self.leaves:
            mean = values[leaf].mean(0)
            norm = np.linalg.norm(mean)
            mean = mean / norm if norm > 0 else np.eye(1, len(mean), dtype=np.float32)[0]
            cosine = values[leaf] @ mean - self.missed[leaf] - ROUNDING
            centres.append(mean)
            radius.append(np.arccos(np.clip(cosine.min(), -1, 1)) + 1e-5)
        return np.array(centres, np.float32), np.array(radius, np.float32)


def _products(a: _Block, rows: slice, b: np.ndarray, columns: np.ndarray | slice, block: _Block) -> tuple[np.ndarray, np.ndarray]:
    """(products, error of each row): cosines by the codes, which miss the exact ones by at most |a - a8| + |a8| |b - b8|."""
    product = a.codes[rows].astype(np.float32) @ b[columns].T
    product *= block.scale[columns]
    product *= a.scale[rows, None]
    worst = float(block.missed[columns].max(initial=0))
    return product, a.missed[rows] + (1 + a.missed[rows]) * worst + np.float32(ROUNDING)


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    """A lower bound of the k-th best value of each row: the k-th best of the best values of groups."""
    columns = values.shape[1]
    group = max(1, columns // 256)
    best = values[:, : columns // group * group].reshape(len(values), -1, group).max(2)
    return np.partition(best, best.shape[1] - k, axis=1)[:, best.shape[1] - k] if best.shape[1] >= k else np.full(len(values), -2, np.float32)


def _thresholds(k: int, dimensions: int):
    """Blocks with the least k-th best cosine that each vector finds in its own block, and the shapes of their leaves."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = _Block(_masked(row, dimensions), dimensions)
                if not len(block.ids):
                    continue
                wide, least = block.wide(), []
                for leaf in block.leaves:
                    product, error = _products(block, leaf, wide, slice(None), block)
                    own = np.arange(leaf.start, leaf.stop)
                    product[own - leaf.start, own] = -2
                    least.append(_kth(product, k) - error)
                centres, radius = block.leaf_shapes()
                values = {"ids": block.ids, "codes": block.codes, "scale": block.scale, "missed": block.missed, "least": np.concatenate(least).astype(np.float32), "centres": centres, "radius": radius}
                yield pa.RecordBatch.from_pydict({"block": pa.array([block.number], pa.int64())} | {n: pa.array([x.tobytes()], pa.binary()) for n, x in values.items()})

    return run


def _masked(row: dict, dimensions: int) -> dict:
    """A packed block without the vectors that stand for no id (rows that a later delivery has replaced)."""
    kept = np.array([m["at"] for m in row["members"]], np.int64)
    order = np.argsort(kept)
    kept = kept[order]
    codes = np.frombuffer(row["codes"], np.int8).reshape(-1, dimensions)[kept]
    ids = np.array([m["q"] for m in row["members"]], np.int64)[order]
    return {"block": row["block"], "ids": ids.tobytes(), "codes": codes.tobytes()} | {n: np.frombuffer(row[n], np.float32)[kept].tobytes() for n in ("scale", "missed")}


class _Found:
    """The running k best lower bounds of a block's vectors inside a tile, and the pairs that may still matter."""

    def __init__(self, block: _Block, k: int):
        self.block, self.k = block, k
        self.heap = np.full((len(block.ids), k), -2, np.float32)
        self.pairs: list[tuple[np.ndarray, ...]] = []

    def add(self, rows: np.ndarray, ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        if not len(rows):
            return
        self.pairs.append((rows, ids, low, high))
        order = np.lexsort((-low, rows))
        r, values = rows[order], low[order]
        nth = np.arange(len(r)) - np.searchsorted(r, r)
        top = nth < self.k
        r, nth, values = r[top], nth[top], values[top]
        touched = np.unique(r)
        new = np.full((len(touched), self.k), -2, np.float32)
        new[np.searchsorted(touched, r), nth] = values
        both = np.concatenate([self.heap[touched], new], axis=1)
        self.heap[touched] = np.partition(both, self.k, axis=1)[:, self.k :]
        self.block.least[touched] = np.maximum(self.block.least[touched], self.heap[touched].min(1))

    def result(self) -> tuple[np.ndarray, ...]:
        rows, ids, low, high = (np.concatenate([p[n] for p in self.pairs]) for n in range(4)) if self.pairs else (np.array([], t) for t in (np.int64, np.int64, np.float32, np.float32))
        keep = high >= self.block.least[rows]
        return np.full(keep.sum(), self.block.number), self.block.ids[rows[keep]], ids[keep], low[keep], high[keep]


def meet(a: _Block, b: _Block, found_a: _Found, found_b: _Found) -> tuple[int, int]:
    """Compare two blocks (or one with itself); gives how many pairs of leaves there are and how many were multiplied.

    The cosine of two vectors is at most that of the angle between their leaves' centres less both
    radii; leaves that lie below all thresholds of both are passed over.
    """
    same = a is b
    angles = np.arccos(np.clip(a.centres.astype(np.float64) @ b.centres.T, -1, 1)) - 1e-5
    reach = np.cos(np.maximum(angles - a.radius[:, None] - b.radius, 0))
    least_a, least_b = (np.array([x.least[leaf].min() for leaf in x.leaves]) for x in (a, b))
    wide, done = b.wide(), 0
    for n, rows in enumerate(a.leaves):
        fit = reach[n] >= np.minimum(least_a[n], least_b) - ROUNDING
        done += int(fit.sum())
        chosen = [b.leaves[m] for m in np.flatnonzero(fit)]
        if not chosen:
            continue
        columns = np.concatenate([np.arange(s.start, s.stop) for s in chosen])
        product, error = _products(a, rows, wide, columns, b)
        if same:
            product[columns[None, :] == np.arange(rows.start, rows.stop)[:, None]] = -4
        i, j = np.nonzero(product >= (a.least[rows] - error)[:, None])
        value, slack = product[i, j], error[i]
        found_a.add(i + rows.start, b.ids[columns[j]], value - slack, value + slack)
        if not same:
            i, j = np.nonzero(product + error[:, None] >= b.least[columns])
            value, slack = product[i, j], error[i]
            found_b.add(columns[j], a.ids[i + rows.start], value - slack, value + slack)
    return len(a.leaves) * len(b.leaves), done


def _tile(k: int, dimensions: int):
    """All blocks of two sides (or one): each row keeps its k best so far, which raises its threshold for what follows."""

    def run(group: pa.Table) -> pa.Table:
        low, high = group["low"][0].as_py(), group["high"][0].as_py()
        blocks = [(r["side"], _Block(r, dimensions)) for r in sorted(group.to_pylist(), key=lambda r: r["block"])]
        found = {b.number: _Found(b, k) for _, b in blocks}
        left, right = [b for s, b in blocks if s == low], [b for s, b in blocks if s == high]
        for a in left:
            for b in right:
                if low != high or a.number <= b.number:
                    meet(a, b, found[a.number], found[b.number])
        parts = [f.result() for f in found.values()]
        return pa.table({name: np.concatenate([p[n] for p in parts]) for n, name in enumerate(("block", "q", "id", "low", "high"))})

    return run


def _exact(dimensions: int):
    """Cosines in float64 of a block's pairs from the vectors that were fetched for it."""

    def run(pairs: pa.Table, vectors: pa.Table) -> pa.Table:
        ids, first = np.unique(vectors["id"].to_numpy(), return_index=True)
        exact = unit(_matrix(vectors["v"].combine_chunks(), dimensions)[first])
        q, other = pairs["q"].to_numpy(), pairs["id"].to_numpy()
        i, j = np.searchsorted(ids, q), np.searchsorted(ids, other)
        cosine = np.empty(len(q))
        for at in range(0, len(q), 65536):
            part = slice(at, at + 65536)
            cosine[part] = np.einsum("ij,ij->i", exact[i[part]], exact[j[part]])
        return pa.table({"q": q, "id": other, "cosine": np.round(cosine, 12)})

    return run


def similar_vectors(df: DataFrame, key: str = "id", vector: str = "embedding", newest: str | None = "updated_at", dimensions: int = 128, k: int = 5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, neighbour_id, rank, cosine): the k most similar other rows of every row with a usable vector.

    Exact, by cosine, ties to the smaller id; the vectors' norms do not matter. Equal vectors are
    compared once, as a class of which the k + 1 smallest ids can be anybody's neighbours, so a group of copies of any size
    costs one vector. Rows delivered again under an id count once, as the newest. Rows without usable vector give and
    get no neighbours; a table of one row gives none. Other columns are not read.

    Blocks of int8 codes, laid out by nearest pivot, meet in tiles; each vector begins with the k-th
    best of its own block as threshold. Pairs whose bound reaches the threshold go on; after the merge
    of all tiles the floats of what is left are fetched and compared in float64.
    """
    usable = usable_vectors(df, key, vector, dimensions, newest)
    # who is who, by marks alone
    rows = durable(usable.groupBy("id").agg(F.max(F.struct("at", "h1", "h2")).alias("m")).select("id", "m.h1", "m.h2"))
    nth = F.row_number().over(Window.partitionBy("h1", "h2").orderBy("id"))
    first = rows.withColumn("nth", nth).where(F.col("nth") <= k + 1)
    classes = durable(first.groupBy("h1", "h2").agg(F.min("id").alias("q"), F.array_sort(F.collect_list("id")).alias("ids")))
    near = _nearest(usable, classes, k, dimensions, block_rows)
    ids = classes.select(F.col("q").alias("id"), "ids")
    own = ids.select(F.col("id").alias("q"), F.lit(1.0).alias("cosine"), "ids")
    lists = near.join(ids, "id").select("q", "cosine", "ids").unionByName(own).select("q", F.explode(F.transform("ids", lambda i: F.struct((-F.col("cosine")).alias("far"), i.alias("id")))).alias("n"))
    candidates = lists.groupBy("q").agg(F.array_sort(F.collect_list("n")).alias("candidates"))
    members = rows.join(classes.select("h1", "h2", "q"), ["h1", "h2"]).join(candidates, "q")
    best = F.slice(F.filter("candidates", lambda c: c["id"] != F.col("id")), 1, k)
    return members.select("id", F.posexplode(best).alias("at", "n")).select("id", F.col("n.id").alias("neighbour_id"), (F.col("at") + 1).alias("rank"), (-F.col("n.far")).alias("cosine"))


def _nearest(usable: DataFrame, classes: DataFrame, k: int, dimensions: int, block_rows: int) -> DataFrame:
    """(q, id, cosine): the k nearest other classes of every class, each named by its smallest id."""
    vectors = usable.select("h1", "h2", "v")
    pivots = unit(np.array([r["v"] for r in vectors.orderBy("h1", "h2").limit(PIVOTS).collect()], np.float32).reshape(-1, dimensions)).astype(np.float32)
    if not len(pivots):
        pivots = np.zeros((1, dimensions), np.float32)
    placed = vectors.mapInArrow(_placed(pivots, dimensions), "pivot int, h1 bigint, h2 bigint, v array<float>")
    layout = ["pivot", "h1", "h2"]
    packed = durable(placed.repartitionByRange(*layout).sortWithinPartitions(*layout).select("h1", "h2", "v").mapInArrow(_pack(block_rows, dimensions), _PACKED))
    marks = packed.select("block", "h1", "h2").mapInArrow(_members, "block bigint, at int, h1 bigint, h2 bigint")
    # copies that lie in two partitions are one vector: the first place is its own
    owned = marks.groupBy("h1", "h2").agg(F.min(F.struct("block", "at")).alias("p")).join(classes.select("h1", "h2", "q"), ["h1", "h2"])
    named = owned.groupBy("p.block").agg(F.collect_list(F.struct("p.at", "q")).alias("members"))
    kinds = "block bigint, ids binary, codes binary, scale binary, missed binary, least binary, centres binary, radius binary"
    blocks = durable(packed.drop("h1", "h2").join(named, "block").mapInArrow(_thresholds(k, dimensions), kinds))
    # a few bytes for each 8192 vectors: dense numbers for the blocks, and sides of as many blocks as memory or cores allow
    count = blocks.count()
    cores = blocks.sparkSession.sparkContext.defaultParallelism
    sides = min(max(count, 1), max(math.ceil(math.sqrt(2 * cores)), math.ceil(count * block_rows / SIDE_ROWS)))
    numbered = blocks.select("block").withColumn("side", F.floor((F.row_number().over(Window.orderBy("block")) - 1) * sides / max(count, 1)).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.lit(sides - 1)))
    sided = blocks.join(numbered, "block").withColumn("other", other).withColumn("low", F.least("side", "other")).withColumn("high", F.greatest("side", "other")).drop("other")
    found = sided.groupBy("low", "high").applyInArrow(_tile(k, dimensions), "block bigint, q bigint, id bigint, low float, high float")
    by_low = Window.partitionBy("q").orderBy(F.desc("low")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    left = durable(found.withColumn("kth", F.nth_value("low", k).over(by_low)).where("kth is null or high >= kth").select("block", "q", "id"))
    needed = left.select("block", "id").union(left.select("block", "q")).distinct()
    addressed = needed.join(classes.select(F.col("q").alias("id"), "h1", "h2"), "id")
    floats = usable.select("id", "h1", "h2", "v").dropDuplicates(["id", "h1", "h2"]).join(addressed, ["id", "h1", "h2"]).select(F.col("block").alias("place"), "id", "v")
    exact = left.groupBy("block").cogroup(floats.groupBy("place")).applyInArrow(_exact(dimensions), "q bigint, id bigint, cosine double")
    best = Window.partitionBy("q").orderBy(F.desc("cosine"), "id")
    return exact.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= k).drop("nth")


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            h1, h2 = np.frombuffer(row["h1"], np.int64), np.frombuffer(row["h2"], np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(h1), row["block"])), pa.array(np.arange(len(h1), dtype=np.int32)), pa.array(h1), pa.array(h2)], ["block", "at", "h1", "h2"])
