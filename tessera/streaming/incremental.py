"""Incremental scans as streams: each file once, whatever its partition's date."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from tessera.sources.sinks import upsert_parquet


def process_new_files(
    spark: SparkSession, path: str, schema: T.StructType, checkpoint: str, each: Callable[[DataFrame, int], None], fmt: str = "parquet",
    max_files: int = 1000,
) -> None:
    """Runs each(batch, number) over the files that the checkpoint has not seen, in bounded batches, then stops."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(path)
    query = stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    query.awaitTermination()


def append_new_files(spark: SparkSession, path: str, schema: T.StructType, checkpoint: str, out: str, transform: Callable[[DataFrame], DataFrame] = lambda d: d, fmt: str = "parquet") -> None:
    """transform over new files, appended exactly once by the streaming file sink."""
    stream = transform(spark.readStream.schema(schema).format(fmt).load(path))
    stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").outputMode("append").start(out).awaitTermination()


def upsert_new_files(spark: SparkSession, path: str, schema: T.StructType, checkpoint: str, out: str, keys: Sequence[str], order: Sequence[Column], max_files: int = 1000, buckets: int = 64) -> None:
    """The latest row of each key over all batches so far; a batch that is run again writes the same version again."""
    process_new_files(spark, path, schema, checkpoint, lambda batch, n: upsert_parquet(batch, out, keys, order, f"{n:012d}", buckets), max_files=max_files)
