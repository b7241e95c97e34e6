"""Lineage cuts that survive the loss of an executor."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: what the session names, else (only on a local master) a new one."""
    scala_context = spark.sparkContext._jsc.sc()
    if scala_context.getCheckpointDir().isDefined():
        return scala_context.getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="tidemark-checkpoint-")
    spark.sparkContext.setCheckpointDir(named)
    return named


def durable(df: DataFrame) -> DataFrame:
    """Compute ``df`` once into the shared checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder; no schema inference beyond the Parquet footer."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stream_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder as a stream of files, whether it is one file or a folder of parts."""
    stream = spark.readStream.schema(table(spark, folder, name).schema)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}.parquet")
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory():
        return stream.parquet(f"{folder}/{name}.parquet")
    # a stream begins at a folder; its files are chosen by name
    return stream.option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many parts as there are cores, if it is read in fewer: for scans bound by Python's CPU over few or small files.

    A table read in enough parts stays where it is, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(2 * cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df
