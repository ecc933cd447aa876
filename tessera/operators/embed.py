"""Skill and job embeddings."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import vectors as V


def skill_embeddings(
    dim: DataFrame, encode: Callable | None = None, model_name: str = "hashed-ngrams", model_version: str = "v1",
    model_provider: str = "local", generated_at: Column | None = None,
) -> DataFrame:
    """A vector for each distinct skill, encoded in Arrow batches on the executors."""
    return (
        dim.select("skill_id", "skills")
        .distinct()
        .withColumn("embedding", V.encoder_udf(encode or V.hashed_ngrams())(F.col("skills")))
        .select(
            "skill_id", "skills", "embedding", F.size("embedding").alias("embedding_dim"), F.lit(model_name).alias("model_name"),
            F.lit(model_version).alias("model_version"), F.lit(model_provider).alias("model_provider"),
            (generated_at if generated_at is not None else F.current_timestamp()).alias("generated_at"), F.lit(True).alias("is_active"),
        )
    )


def weighted_mean_vectors(df: DataFrame, key: str, vector: str, weight: str) -> DataFrame:
    """sum(w v) / sum(w) for each key, in long form: the vectors are exploded, summed by key and place with partial
    aggregates, and put together again, so no task ever holds the vectors of a hot key. Keys whose weights sum to 0 get nulls."""
    long = df.select(key, F.col(weight).cast("double").alias("_w"), F.posexplode(V.doubles(F.col(vector))).alias("_pos", "_x"))
    sums = long.groupBy(key, "_pos").agg(F.sum(F.col("_w") * F.col("_x")).alias("_s"), F.sum("_w").alias("_w"), F.count("*").alias("_n"))
    parts = F.array_sort(F.collect_list(F.struct("_pos", F.try_divide("_s", "_w").alias("_m"))))  # as many as the vector has places
    out = sums.groupBy(key).agg(parts.alias("_parts"), F.max("_n").alias("skill_count"))
    return out.select(key, F.transform("_parts", lambda p: p["_m"]).alias("embedding"), "skill_count")


def job_embeddings(
    fact: DataFrame, embeddings: DataFrame, model_version: str, aggregation_method: str = "weighted_mean", generated_at: Column | None = None
) -> DataFrame:
    """The confidence-weighted mean of the active vectors of a job's skills, and its normalised form."""
    active = embeddings.where(F.col("is_active") & (F.col("model_version") == model_version)).select("skill_id", "embedding")
    joined = fact.select("job_id", "skill_id", "skill_confidence").join(active, "skill_id")
    return weighted_mean_vectors(joined, "job_id", "embedding", "skill_confidence").select(
        "job_id",
        F.lit(model_version).alias("model_version"),
        F.lit(aggregation_method).alias("aggregation_method"),
        "embedding",
        V.normalize(F.col("embedding")).alias("embedding_normalized"),
        F.size("embedding").alias("embedding_dim"),
        "skill_count",
        (generated_at if generated_at is not None else F.current_timestamp()).alias("generated_at"),
    )
