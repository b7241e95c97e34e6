"""Linear scans over rows in order, spread over the cluster by ranges instead of by key.

A key that holds a third of all rows is cut into as many ranges as its size asks for; only the runs
that touch the edge of a range (at most two a range) meet again, to be joined where the cut fell
inside a run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.plans.durable import durable

#: A fragment: a run, or the part of it inside one range. ``head`` and ``tail`` mark a range's first and last fragment.
FRAGMENT = "stream string, subject string, first_id {id}, last_id {id}, start_us bigint, end_us bigint, n bigint, head boolean, tail boolean"

#: Positions of the rows that begin a run: (stream, subject, micros) with the row before them in front.
Starts = Callable[[pa.Array, pa.Array, np.ndarray], np.ndarray]


def changed(values: pa.Array) -> np.ndarray:
    """For each value but the first: does it differ from the one before it?"""
    return pc.not_equal(values.slice(1), values.slice(0, len(values) - 1)).to_numpy(zero_copy_only=False)


def _plain(column: pa.ChunkedArray) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def fragment_scan(gap_us: int, aggregate: Callable[[np.ndarray, int], np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """A scan of sorted batches (stream, subject, us, id) that keeps one open run and nothing else.

    ``aggregate(starts, rows)`` gives the number of rows of each run that begins inside the batch.
    Neighbours equal in stream, time and id are one record delivered again and count once.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_run: dict | None = None
        last_row: pa.Table | None = None
        head = True

        def emit(runs: dict[str, list], tail: bool) -> pa.RecordBatch:
            nonlocal head
            count = len(runs["n"])
            flags = np.zeros(count, bool)
            flags[:1] = head
            head = False
            ends = np.zeros(count, bool)
            ends[-1:] = tail
            kind = last_row.schema.field("id").type
            types = {"stream": pa.string(), "subject": pa.string(), "first_id": kind, "last_id": kind}
            return pa.RecordBatch.from_pydict({k: pa.array(v, types.get(k, pa.int64())) for k, v in runs.items()} | {"head": pa.array(flags), "tail": pa.array(ends)})

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            rows = rows.set_column(2, "us", rows["us"].cast(pa.int64()))
            joined = rows if last_row is None else pa.concat_tables([last_row, rows])
            columns = {k: _plain(joined[k]) for k in ("stream", "subject", "us", "id")}
            micros = columns["us"].to_numpy(zero_copy_only=False)
            if len(joined) > 1:
                again = ~(changed(columns["stream"]) | (np.diff(micros) != 0) | changed(columns["id"]))
                if again.any():
                    joined = joined.filter(pa.array(np.concatenate([[True], ~again])))
                    columns = {k: _plain(joined[k]) for k in columns}
                    micros = columns["us"].to_numpy(zero_copy_only=False)
            begins = np.zeros(len(joined), bool)
            begins[1:] = changed(columns["stream"]) | changed(columns["subject"]) | (np.diff(micros) > gap_us) if len(joined) > 1 else False
            offset = 0 if last_row is None else 1  # the row carried over was counted with its own batch
            if last_row is None:
                begins[0] = True
            starts = np.flatnonzero(begins)
            last_row = joined.slice(len(joined) - 1)
            until = starts[0] if len(starts) else len(joined)
            if open_run is not None and until > offset:
                open_run["last_id"], open_run["end_us"] = columns["id"][until - 1].as_py(), int(micros[until - 1])
                open_run["n"] += int(until - offset)
            if not len(starts):
                continue
            stops = np.append(starts[1:], len(joined))
            sizes = aggregate(starts, len(joined))
            runs = {
                "stream": columns["stream"].take(pa.array(starts)).to_pylist(),
                "subject": columns["subject"].take(pa.array(starts)).to_pylist(),
                "first_id": columns["id"].take(pa.array(starts)).to_pylist(),
                "last_id": columns["id"].take(pa.array(stops - 1)).to_pylist(),
                "start_us": micros[starts].tolist(),
                "end_us": micros[stops - 1].tolist(),
                "n": sizes.tolist(),
            }
            if open_run is not None:
                for k, v in open_run.items():
                    runs[k].insert(0, v)
            open_run = {k: v.pop() for k, v in runs.items()}
            if runs["n"]:
                yield emit(runs, tail=False)
        if open_run is not None:
            yield emit({k: [v] for k, v in open_run.items()}, tail=True)

    return scan


def run_lengths(starts: np.ndarray, rows: int) -> np.ndarray:
    """Rows of each run, from where the runs begin."""
    return np.diff(np.append(starts, rows))


def runs_in_order(
    df: DataFrame,
    stream: Column,
    subject: Column,
    micros: Column,
    row_id: Column,
    gap_us: int,
    aggregate: Callable[[np.ndarray, int], np.ndarray] = run_lengths,
    carried: Sequence[str] = (),
) -> DataFrame:
    """Maximal runs of rows of one stream and subject whose neighbours are at most ``gap_us`` apart.

    Order is time, then id. Rows without time or id take no part. Result: stream, subject,
    first_id, last_id, start_us, end_us, n. With ``carried``, the columns that ``subject`` is made of,
    it is computed behind the exchange, once; otherwise the sampling of the ranges computes it too.
    """
    usable = "us is not null and id is not null"
    if carried:
        raw = df.select(stream.alias("__stream"), micros.alias("__us"), row_id.alias("__id"), *carried).where("__us is not null and __id is not null")
        keys = ["__stream", "__us", "__id", *carried]
        kind = raw.schema["__id"].dataType.simpleString()
        placed = raw.repartitionByRange(*keys).sortWithinPartitions(*keys).select(F.col("__stream").alias("stream"), subject.alias("subject"), F.col("__us").alias("us"), F.col("__id").alias("id"))
        return _scanned(placed, kind, gap_us, aggregate)
    rows = df.select(stream.alias("stream"), subject.alias("subject"), micros.alias("us"), row_id.alias("id")).where(usable)
    kind = rows.schema["id"].dataType.simpleString()
    order = ["stream", "us", "id", "subject"]
    return _scanned(rows.repartitionByRange(*order).sortWithinPartitions(*order), kind, gap_us, aggregate)


def _scanned(placed: DataFrame, kind: str, gap_us: int, aggregate: Callable[[np.ndarray, int], np.ndarray]) -> DataFrame:
    parts = durable(placed.mapInArrow(fragment_scan(gap_us, aggregate), FRAGMENT.format(id=kind)))
    whole = parts.where("not head and not tail").drop("head", "tail")
    return whole.unionByName(_stitched(parts.where("head or tail"), gap_us))


def _stitched(edges: DataFrame, gap_us: int) -> DataFrame:
    """Join a range's last fragment with the next range's first where they belong to one run."""
    order = Window.partitionBy("stream").orderBy("start_us", "first_id", "end_us")
    before = [F.lag(c).over(order) for c in ("tail", "subject", "end_us")]
    goes_on = F.coalesce(before[0] & F.col("head") & (before[1] == F.col("subject")) & (F.col("start_us") - before[2] <= gap_us), F.lit(False))
    numbered = edges.withColumn("run", F.sum(F.when(goes_on, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("stream", "subject", "run").agg(
        F.min_by("first_id", F.struct("start_us", "first_id")).alias("first_id"),
        F.max_by("last_id", F.struct("end_us", "last_id")).alias("last_id"),
        F.min("start_us").alias("start_us"),
        F.max("end_us").alias("end_us"),
        F.sum("n").alias("n"),
    ).drop("run")


def greedy_in_order(df: DataFrame, group: str, time: str, key: str, gap: float) -> DataFrame:
    """Rows at least ``gap`` after the last accepted row of their group, in order of time, then key; all columns stay.

    The rule looks back to the last accepted row, but a row that comes a whole gap after the row before it is accepted
    whatever was accepted before. Rows are cut into ranges of (group, time, key); a range decides
    about everything from its first such row on by itself, on all cores. What stands before that row waits for the range before it:
    those rows, and the last accepted time of each range, meet in a second pass, in which a chain of
    ranges without any pause is scanned in one task. Rows must have group, time and key.
    """
    order = [group, time, key]
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    columns = df.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        current, before, last, loose, first = None, -np.inf, -np.inf, True, True
        for batch in batches:
            if not batch.num_rows:
                continue
            names, times = batch.column(batch.schema.get_field_index(group)).to_pylist(), batch.column(batch.schema.get_field_index(time)).to_numpy(zero_copy_only=False)
            keep, waits = np.zeros(len(times), bool), np.zeros(len(times), bool)
            for n, (name, at) in enumerate(zip(names, times)):
                if loose and not (first and n == 0) and (name != current or at - before >= gap):
                    loose = False
                    last = -np.inf
                if name != current:
                    last = -np.inf
                current, before = name, at
                if loose:
                    waits[n] = True
                elif at >= last + gap:
                    keep[n], last = True, at
            first = False
            chosen = pa.array(np.flatnonzero(keep | waits))
            part = batch.take(chosen)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(np.full(len(chosen), number)), pa.array(waits[chosen.to_numpy()])], [*batch.schema.names, "__range", "__waits"])

    parts = durable(placed.mapInArrow(first_pass, f"{fields}, __range bigint, __waits boolean"))
    # one row for each range: does it hold a decided row, and its last accepted one
    ends = parts.groupBy("__range").agg(F.count_if(~F.col("__waits")).alias("decided"), F.max(F.when(~F.col("__waits"), F.struct(group, time))).alias("last"))
    before = Window.orderBy("__range")
    chains = ends.select(
        "__range",
        F.coalesce(F.max(F.when(F.col("decided") > 0, F.col("__range"))).over(before.rowsBetween(Window.unboundedPreceding, -1)), F.lit(-1)).alias("__chain"),
        F.last(F.when(F.col("decided") > 0, F.col("last")), True).over(before.rowsBetween(Window.unboundedPreceding, -1)).alias("__last"),
    )
    waiting = parts.where("__waits").join(chains, "__range").withColumn("__from_group", F.col(f"__last.{group}")).withColumn("__from", F.col(f"__last.{time}")).drop("__last", "__waits", "__range")

    def second_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, current, last = None, None, -np.inf
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()  # noqa: B023, E731
            keep = np.zeros(batch.num_rows, bool)
            for n, (own, name, at, from_group, start) in enumerate(zip(*map(column, ("__chain", group, time, "__from_group", "__from")))):
                if own != chain:
                    chain, current, last = own, from_group, -np.inf if start is None else start
                if name != current:
                    current, last = name, -np.inf
                if at >= last + gap:
                    keep[n], last = True, at
            yield batch.filter(pa.array(keep)).select(columns)

    late = waiting.repartition("__chain").sortWithinPartitions("__chain", *order).mapInArrow(second_pass, fields)
    return parts.where("not __waits").select(*columns).unionByName(late)


def with_previous(df: DataFrame, group: str, time: str, key: str, columns: Sequence[str]) -> DataFrame:
    """``df`` with ``has_previous`` and ``previous_<column>``: the row before in the same group, in order of time, then key.

    Rows are cut into ranges, so a group that holds all rows is spread over all cores; only the first row of a range looks at the
    last one of the range before. Nulls are a group and come first.
    """
    order, kept = [group, time, key], df.columns
    types = {f.name: f.dataType.simpleString() for f in df.schema}
    added = [f"previous_{c}" for c in columns]
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in kept), *(f"`previous_{c}` {types[c]}" for c in columns), "has_previous boolean", "__head boolean", "__range bigint"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, last = TaskContext.get().partitionId(), None
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([batch])
            joined = rows if last is None else pa.concat_tables([last, rows])
            at = np.arange(len(rows)) - (last is None)
            before = joined.take(pa.array(at, mask=at < 0))
            own, other = rows[group].combine_chunks(), before[group].combine_chunks()
            same = pc.or_(pc.fill_null(pc.equal(own, other), False), pc.and_(pc.is_null(own), pc.is_null(other)))
            same = pc.and_(same, pa.array(at >= 0))
            head = np.zeros(len(rows), bool)
            head[0] = last is None
            values = [pc.if_else(same, _plain(before[c]), pa.nulls(len(rows), before[c].type)) for c in columns]
            arrays = [*batch.columns, *(_plain(v) for v in values), same, pa.array(head), pa.array(np.full(len(rows), number))]
            yield pa.RecordBatch.from_arrays(arrays, [*batch.schema.names, *added, "has_previous", "__head", "__range"])
            last = rows.slice(len(rows) - 1)

    parts = durable(df.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(scan, schema))
    ends = parts.groupBy("__range").agg(F.max_by(F.struct(F.col(group).alias("__group"), *(F.col(c).alias(f"__{c}") for c in columns)), F.struct(*order)).alias("end"))
    before = ends.select("__range", F.lag("end").over(Window.orderBy("__range")).alias("end"))
    heads = parts.where("__head").drop("has_previous", *added).join(before, "__range")
    same = F.col("end").isNotNull() & F.col(group).eqNullSafe(F.col("end.__group"))
    joined = heads.select(*kept, *(F.when(same, F.col(f"end.__{c}")).alias(f"previous_{c}") for c in columns), same.alias("has_previous"))
    return parts.where("not __head").select(*kept, *added, "has_previous").unionByName(joined)
