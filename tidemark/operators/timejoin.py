"""Joins on time that stay equi-joins: rows meet by time bucket, the exact bound is a residual filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*(F.col(c).alias(f"{prefix}_{c}") for c in df.columns))


def range_join(left: DataFrame, right: DataFrame, low: float, high: float, time: str = "timestamp") -> DataFrame:
    """Pairs with ``left.time + low < right.time < left.time + high``, both bounds out; columns l_* and r_*.

    Each left row goes to the two or so buckets its interval touches, each right row to its one, so
    neither side is compared with all of the other. A crowded bucket is split by the adaptive skew
    join. Rows without a usable time pair with nothing.
    """
    width = max(high - low, 1e-6)
    usable = f"{time} is not null and not isnan({time})"
    bucket = lambda c: F.floor(c / width).cast("bigint")
    lefts = _prefixed(left.where(usable), "l")
    start = F.col(f"l_{time}")
    lefts = lefts.withColumn("__bucket", F.explode(F.sequence(bucket(start + low), bucket(start + high))))
    rights = _prefixed(right.where(usable), "r").withColumn("__bucket", bucket(F.col(f"r_{time}")))
    at = F.col(f"r_{time}")
    return lefts.join(rights, "__bucket").where((at > start + low) & (at < start + high)).drop("__bucket")


#: Rows of a bucket in which a probe looks for its nearest row.
ROWS_IN_BUCKET = 16


def nearest_join(probes: DataFrame, rows: DataFrame, probe_key: str, row_key: str, time: str = "timestamp", width: float | None = None) -> DataFrame:
    """(probe_key, row_key, gap): for each probe the row nearest in time on either side, ties to the smaller row key.

    Buckets are as wide as ``ROWS_IN_BUCKET`` rows need on average (or ``width`` seconds), so a denser log has narrower ones.
    A probe looks at the rows of its own bucket and at the last and first row of the nearest
    filled buckets around it; only the buckets' ends, one row for each, are put in order. Without
    rows no probe has a result; probes and rows without a usable time take no part.
    """
    usable = f"{time} is not null and not isnan({time})"
    if width is None:
        span = rows.where(usable).agg(F.count("*").alias("n"), (F.max(time) - F.min(time)).alias("span")).first()
        width = max(ROWS_IN_BUCKET * (span["span"] or 0.0) / max(span["n"], 1), 1e-3)
    at = F.floor(F.col(time) / width).cast("bigint")
    p = probes.where(usable).select(F.col(probe_key).alias("__probe"), F.col(time).alias("__at"), at.alias("__bucket"))
    r = rows.where(usable).select(F.col(row_key).alias("__row"), F.col(time).alias("__time"), at.alias("__bucket"))
    point = F.struct(F.col("__time"), F.col("__row"))
    # equal times: the smaller key stands for all of them
    ends = r.groupBy("__bucket").agg(F.min(point).alias("first"), F.max("__time").alias("last_time"), F.min_by("__row", F.struct(-F.col("__time"), "__row")).alias("last_row"))
    ends = ends.withColumn("last", F.struct(F.col("last_time").alias("__time"), F.col("last_row").alias("__row")))
    wanted = p.select("__bucket").distinct().join(ends, "__bucket", "full_outer")
    order = Window.orderBy("__bucket")
    reach = wanted.select(
        "__bucket",
        F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("before"),
        F.first("first", True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("after"),
    )
    outside = p.join(reach, "__bucket").select("__probe", "__at", F.explode(F.array("before", "after")).alias("p")).where("p is not null").select("__probe", "__at", "p.__row", "p.__time")
    inside = p.join(r, "__bucket").select("__probe", "__at", "__row", "__time")
    gaps = outside.unionByName(inside).withColumn("gap", F.abs(F.col("__time") - F.col("__at")))
    best = gaps.groupBy("__probe").agg(F.min(F.struct("gap", "__row")).alias("b"))
    return best.select(F.col("__probe").alias(probe_key), F.col("b.__row").alias(row_key), F.col("b.gap").alias("gap"))


def content_hash(text: Column) -> Column:
    """The first 16 hex digits of a text's SHA-256."""
    return F.substring(F.sha2(text, 256), 1, 16)


def voice_source(pastes: DataFrame, transcriptions: DataFrame, window_seconds: float = 30.0, newest: int = 5) -> DataFrame:
    """(event_id, voice_id): for each paste (event_id, timestamp, hash) the newest transcription of the same hash in the window before it.

    Only the ``newest`` transcriptions of the window are looked at, whatever their hash. Pastes without a match give no row.
    """
    pairs = range_join(pastes, transcriptions, -window_seconds, 1e-9)
    order = Window.partitionBy("l_event_id").orderBy(F.desc("r_timestamp"), F.desc("r_event_id"))
    looked = pairs.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= newest).where("l_hash = r_hash")
    return looked.groupBy("l_event_id").agg(F.min_by("r_event_id", "nth").alias("voice_id")).withColumnRenamed("l_event_id", "event_id")
