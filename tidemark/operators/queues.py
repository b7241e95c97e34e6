"""Rules of recorders and workers: a queue that drops what it can't hold, and where a recording's silent tail ends it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: items that wait for the text recognition at most.
QUEUE_SIZE = 10


def bounded_queue(df: DataFrame, group: str, service_seconds: float, capacity: int = QUEUE_SIZE, time: str = "timestamp", key: str = "id") -> DataFrame:
    """Rows of each group with ``accepted``: a worker takes ``service_seconds`` for an item, ``capacity`` items may wait, others are dropped.

    The state of a queue is the one time until which the worker is busy with what was accepted. Groups are cut where the
    worker must be idle (a pause of all it can have to do), so that a hot group is scanned on many cores.
    Rows without group, key or usable time are left out; equal times: smaller key first.
    """
    rows = df.where(F.col(group).isNotNull() & F.col(key).isNotNull() & F.col(time).isNotNull() & ~F.isnan(time))
    order = Window.partitionBy(group).orderBy(time, key)
    most = (capacity + 1) * service_seconds
    fresh = F.coalesce(F.col(time) - F.lag(time).over(order) >= most, F.lit(True)).cast("int")
    cut = rows.withColumn("__part", fresh).withColumn("__part", F.sum("__part").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    columns = rows.columns
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, busy = None, -np.inf
        for batch in batches:
            column = lambda name: batch.column(batch.schema.get_field_index(name)).to_pylist()  # noqa: B023, E731
            accepted = np.zeros(batch.num_rows, bool)
            for n, (own, part, at) in enumerate(zip(column(group), column("__part"), column(time))):
                if (own, part) != current:
                    current, busy = (own, part), -np.inf
                # one item is in work, the others wait
                if busy - at <= capacity * service_seconds:
                    accepted[n] = True
                    busy = max(busy, at) + service_seconds
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in columns), pa.array(accepted)], [*columns, "accepted"])

    return cut.repartition(group, "__part").sortWithinPartitions(group, "__part", time, key).mapInArrow(scan, f"{fields}, accepted boolean")


def tail_ends(frames: DataFrame, stream: str, threshold: float, silence_seconds: float, max_tail: float, time: str = "timestamp", level: str = "rms") -> DataFrame:
    """(stream, ended_at, silent): where each recording ends after its key was let go.

    It ends as soon as frames below ``threshold`` have gone on for ``silence_seconds``, at the latest ``max_tail``
    after its first frame; ``silent`` tells which. A missing level is no silence. Streams without frames give no row.
    """
    rows = frames.where(F.col(stream).isNotNull() & F.col(time).isNotNull() & ~F.isnan(time))
    order = Window.partitionBy(stream).orderBy(time)
    quiet = F.coalesce(F.col(level) < threshold, F.lit(False))
    # a silent run begins behind the last loud frame
    loud = F.max(F.when(~quiet, F.col(time))).over(order.rangeBetween(Window.unboundedPreceding, 0))
    marked = rows.select(stream, F.col(time).alias("at"), quiet.alias("quiet"), loud.alias("loud"))
    begun = marked.where("quiet").groupBy(stream, "loud").agg(F.min("at").alias("since"), F.max("at").alias("until"))
    silent = begun.where(F.col("until") - F.col("since") >= silence_seconds).groupBy(stream).agg((F.min("since") + silence_seconds).alias("silence"))
    first = rows.groupBy(stream).agg((F.min(time) + max_tail).alias("latest"))
    joined = first.join(silent, stream, "left")
    is_silent = F.coalesce(F.col("silence") <= F.col("latest"), F.lit(False))
    return joined.select(stream, F.when(is_silent, F.col("silence")).otherwise(F.col("latest")).alias("ended_at"), is_silent.alias("silent"))
