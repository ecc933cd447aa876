"""Scans: whole, by partition, by time window, and incremental against a ledger."""

from __future__ import annotations

import zlib
from datetime import date, datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: seen: what partition_folders() told of the partition when the stage read it.
LEDGER = "stage string, input string, partition string, run_ts timestamp, seen bigint"


def path_exists(spark: SparkSession, path: str) -> bool:
    """By the Hadoop file system of the path, so that any store works."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def missing_inputs(spark: SparkSession, *paths: str) -> list[str]:
    return [p for p in paths if not path_exists(spark, p)]


def scan(spark: SparkSession, path: str, fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    reader = spark.read.option("basePath", path)
    return (reader.schema(schema) if schema else reader).format(fmt).load(path)


def scan_partitions(df: DataFrame, column: str, values: list) -> DataFrame:
    """Rows of the given partitions; on a partition column this prunes folders, on any other it reaches the scan's statistics."""
    return df.where(F.col(column).isin(values)) if values else df.where(F.lit(False))


def list_partitions(df: DataFrame, column: str) -> DataFrame:
    return df.select(F.col(column).cast("date").alias(column)).where(F.col(column).isNotNull()).distinct().orderBy(column)


def scan_window(df: DataFrame, column: str | None, end: datetime | Column, days: int) -> DataFrame:
    """end - days <= column < end; all rows if there is no such column. Null times go."""
    if column is None:
        return df
    if isinstance(end, datetime):
        kind = df.schema[column].dataType.simpleString()
        lit = lambda t: F.lit(t.strftime("%Y-%m-%d %H:%M:%S.%f")).cast(kind)
        return df.where((F.col(column) >= lit(end - timedelta(days=days))) & (F.col(column) < lit(end)))
    return df.where((F.col(column) >= end - F.make_dt_interval(F.lit(days))) & (F.col(column) < end))


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)


def mark_processed(batch: DataFrame, column: str, ledger: str, stage: str, source: str, run_ts: Column) -> None:
    """The partitions of batch join the ledger, under this stage and this input only."""
    new = batch.select(F.col(column).cast("string").alias("partition")).distinct()
    new.select(F.lit(stage).alias("stage"), F.lit(source).alias("input"), "partition", run_ts.cast("timestamp").alias("run_ts"), F.lit(None).cast("bigint").alias("seen")).coalesce(
        1
    ).write.mode("append").parquet(ledger)


def partition_folders(spark: SparkSession, path: str, column: str) -> dict[str, int]:
    """The values of the outermost partition column, by the names of its folders, each with a checksum of the folders and sizes of its files:
    late files change it, and a run that is repeated under its own id does not. No file is read."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs, found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), {}
    for folder in fs.listStatus(p):
        name = str(folder.getPath().getName())
        if folder.isDirectory() and name.startswith(f"{column}="):
            files, some = fs.listFiles(folder.getPath(), True), found.setdefault(name.split("=", 1)[1], [])
            while files.hasNext():
                f = files.next()
                some.append(f"{f.getPath().getParent()} {f.getLen()}")
    return {v: zlib.crc32("\n".join(sorted(some)).encode()) for v, some in found.items() if some}


def new_partitions(spark: SparkSession, path: str, column: str, ledger: DataFrame, stage: str, source: str) -> dict[str, int]:
    """The partitions of path that the ledger lacks for (stage, input), or that have got files since. A row a run and partition comes to the
    driver."""
    done = ledger.where((F.col("stage") == stage) & (F.col("input") == source)).groupBy("partition").agg(F.collect_set("seen").alias("seen"))
    known = {r["partition"]: r["seen"] for r in done.collect()}
    return {v: t for v, t in partition_folders(spark, path, column).items() if v not in known or known[v] and t not in known[v]}


def mark_partitions(spark: SparkSession, partitions: dict[str, int], ledger: str, stage: str, source: str, run_ts: Column) -> None:
    """Partitions, with what was told of them when they were listed, join the ledger."""
    if partitions:
        rows = spark.createDataFrame([(stage, source, v, t) for v, t in partitions.items()], "stage string, input string, partition string, seen bigint")
        rows.select("stage", "input", "partition", run_ts.cast("timestamp").alias("run_ts"), "seen").coalesce(1).write.mode("append").parquet(ledger)


def scan_dates(df: DataFrame, column: str, partitions: dict[str, int]) -> DataFrame:
    """Rows of some date partitions; the scan opens no other folder."""
    return scan_partitions(df, column, [date.fromisoformat(v) for v in sorted(partitions)])


def unprocessed(df: DataFrame, column: str, ledger: DataFrame, stage: str, source: str) -> DataFrame:
    """Rows whose partition the ledger lacks for (stage, input)."""
    done = ledger.where((F.col("stage") == stage) & (F.col("input") == source)).select(F.col("partition").alias("_done")).distinct()
    return df.join(done, df[column].cast("string") == F.col("_done"), "left_anti")
