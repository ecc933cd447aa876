"""Flattening, cleaning and deduplication of postings."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as X


def flatten_envelope(df: DataFrame) -> DataFrame:
    """payload.* beside the time at which the ingestion began."""
    keep = [c for c in df.columns if c not in ("payload", "ingestion_metadata", "raw_payload")]
    return df.select("payload.*", F.col("ingestion_metadata.started_at").alias("ingested_at"), *keep)


def drop_broken(df: DataFrame, *columns: str) -> DataFrame:
    """Rows whose columns are neither null nor blank."""
    return df.where(reduce(lambda a, b: a & b, (X.not_blank(F.col(c)) for c in columns)))


def clean_jobs(df: DataFrame) -> DataFrame:
    """Canonical postings to silver ones: one projection after one filter."""
    return drop_broken(df, "job_title_raw", "description_raw").select(
        F.col("source"),
        F.col("source_job_id").cast("string").alias("job_id"),
        X.trim_lower(F.col("job_title_raw")).alias("job_title"),
        F.trim("company_raw").alias("company"),
        F.trim("location_raw").alias("location"),
        X.squeeze_lower(F.col("description_raw")).alias("description"),
        F.col("url"),
        X.parse_timestamp(F.col("ingested_at")).alias("ingested_at"),
        F.col("ingestion_date").cast("date").alias("ingestion_date"),
        X.parse_timestamp(F.col("posted_at_raw")).alias("posted_at"),
    )


def latest_per_key(df: DataFrame, keys: Sequence[str | Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each key by order; give a total order, since ties are else broken at will."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def _newest(df: DataFrame, time: str) -> list[Column]:
    """Newest first, null last, then by all that can be ordered."""
    rest = [c for c, kind in df.dtypes if c != time and not kind.startswith("map")]
    return [F.desc_nulls_last(time), *(F.asc_nulls_last(c) for c in sorted(rest))]


def deduplicate_jobs(df: DataFrame, keys: Sequence[str] = ("source", "job_id"), time: str = "ingested_at") -> DataFrame:
    """The newest posting of each (source, job_id); rows without job_id go."""
    return latest_per_key(df.where(F.col(keys[-1]).isNotNull()), keys, _newest(df, time))


def robust_deduplicate_jobs(df: DataFrame, time: str = "ingested_at") -> DataFrame:
    """As deduplicate_jobs, but rows without job_id are known by their source, title, company, location and url."""
    key = X.fallback_key(*(F.col(c) for c in ("source", "job_id", "job_title", "company", "location", "url")))
    return latest_per_key(df.withColumn("_key", key), ["_key"], _newest(df, time)).drop("_key")


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames by column name; columns that a frame lacks are null there."""
    if not frames:
        raise ValueError("no frames to unite")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
