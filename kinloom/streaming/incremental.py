"""Incremental batches with exactly-once output: arriving Parquet files, a checkpoint, one run over what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def run_available(spark: SparkSession, path: str, state: str | None = None) -> DataFrame:
    """Read the files at path that no earlier run with the same state has read, append them, and return all rows.

    state holds the checkpoint and the rows; it must be a folder that the driver and all executors share. Without
    one, a fresh folder below spark.checkpoint.dir is used.
    """
    state = state or f"{spark.conf.get('spark.checkpoint.dir').rstrip('/')}/incremental-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema)
    if not is_folder(spark, path):  # a stream reads folders: of this one, the one file
        path, name = path.rsplit("/", 1)
        reader = reader.option("pathGlobFilter", name)
    stream = reader.parquet(path)
    run = (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", f"{state}/checkpoint")
        .option("path", f"{state}/rows")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(schema).parquet(f"{state}/rows")


def is_folder(spark: SparkSession, path: str) -> bool:
    """Whether Spark's file system has a folder there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(where).isDirectory()
