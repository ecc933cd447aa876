"""Sinks: Parquet, JSON lines, run metadata, upsert."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tessera.operators.clean import latest_per_key
from tessera.sources.scans import path_exists


def write_parquet(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """With partitions and overwrite, only those of df are replaced, so a stage that runs twice leaves what one run leaves."""
    df.write.mode(mode).option("partitionOverwriteMode", "dynamic" if partition_by else "static").partitionBy(*partition_by).parquet(path)


def write_jsonl(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> int:
    """Plain JSON lines; returns the rows written, counted while writing."""
    seen = Observation()
    df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode(mode).option("compression", "none").option(
        "partitionOverwriteMode", "dynamic" if partition_by else "static"
    ).partitionBy(*partition_by).json(path)
    return seen.get["rows"]


def write_run(spark: SparkSession, path: str, run_id: str, source: str, rows: int, started_at: str, file: str = "") -> None:
    """A row for the run in its table of runs."""
    spark.createDataFrame([(run_id, source, rows, started_at, file)], "run_id string, source string, row_count bigint, started_at string, file string").write.mode("append").parquet(path)


def _bucket(keys: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def upsert_parquet(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[Column], version: str, buckets: int = 64) -> str:
    """The latest row of each key of what is stored and df, as a new version; returns its folder. Keys are dealt over buckets, and only those
    that df has keys of are read and written again; a version that is run again is replaced. Choose buckets that suit a task each, once for
    a table: another number is an error."""
    spark, root = df.sparkSession, f"{path.rstrip('/')}/buckets={buckets}"
    if other := [n for n in _names(spark, path) if n.startswith("buckets=") and n != f"buckets={buckets}"]:
        raise ValueError(f"{path} has {other[0]}, not {buckets}")
    touched = {r[0] for r in df.select(_bucket(keys, buckets)).distinct().collect()}  # as many numbers as there are buckets at most
    old = [p for b, p in _stored(spark, root, version).items() if b in touched]
    both = spark.read.parquet(*old).unionByName(df, allowMissingColumns=True) if old else df
    dealt = both.withColumn("bucket", _bucket(keys, buckets)).repartition("bucket")  # the window needs no other exchange
    latest = latest_per_key(dealt, ["bucket", *keys], order)
    latest.write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("bucket").parquet(f"{root}/version={version}")
    return f"{root}/version={version}"


def read_upserted(spark: SparkSession, path: str) -> DataFrame:
    """What upsert_parquet stored: each bucket in its last finished version."""
    found = [p for n in _names(spark, path) if n.startswith("buckets=") for p in _stored(spark, f"{path.rstrip('/')}/{n}").values()]
    if not found:
        raise FileNotFoundError(path)
    return spark.read.parquet(*found)


def _stored(spark: SparkSession, root: str, before: str | None = None) -> dict[int, str]:
    """The folder of each bucket's last version; versions without a mark of success do not count."""
    out = {}
    for v in sorted(n for n in _names(spark, root) if n.startswith("version=") and (before is None or n < f"version={before}")):
        names = _names(spark, f"{root}/{v}")
        if "_SUCCESS" in names:
            out |= {int(n.split("=")[1]): f"{root}/{v}/{n}" for n in names if n.startswith("bucket=")}
    return out


def _names(spark: SparkSession, path: str) -> list[str]:
    if not path_exists(spark, path):
        return []
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return [str(f.getPath().getName()) for f in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)]


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
