"""Skill tagging and the star schema."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import skills as S
from tessera.functions import text as X

METHOD = "dictionary_v1"


def job_skills(
    jobs: DataFrame, processed_at: Column | None = None, dictionary: Sequence[str] = S.SKILLS,
    synonyms: Mapping[str, str] = S.SYNONYMS, ngrams: int = 1,
) -> DataFrame:
    """One row for each posting and skill; postings without any vanish. ngrams > 1 lets synonyms of several words match."""
    words = X.tokens(F.col("description"))
    words = S.ngram_tokens(words, ngrams) if ngrams > 1 else words
    found = [*dictionary, *(synonyms if ngrams > 1 else ())]
    keep = [c for c in ("source", "job_id", "ingestion_date", "posted_at") if c in jobs.columns]
    told = sorted({*found, *dictionary, *synonyms.values()})  # only these are looked for or counted, so only these go along with each skill
    raw = jobs.select(*keep, F.filter(words, lambda t: t.isin(told)).alias("_tokens"))
    raw = raw.withColumn("_skills", S.normalize_skills(S.extract_skills(F.col("_tokens"), found), synonyms))
    return raw.select(*keep, "_tokens", F.explode("_skills").alias("skills")).select(
        *keep,
        "skills",
        S.confidence(S.occurrences(F.col("_tokens"), F.col("skills"))).alias("skill_confidence"),
        F.lit(METHOD).alias("extraction_method"),
        (processed_at if processed_at is not None else F.current_timestamp()).alias("processed_at"),
    )


def dim_jobs(jobs: DataFrame, keys: Sequence[str] = ("source", "job_id"), order: Sequence[str] = ("ingestion_date",)) -> DataFrame:
    """One row for each posting: the first by order, then by all its fields. A plain aggregate, so it combines before the shuffle."""
    fields = [c for c in ("source", "job_id", "job_title", "company", "location", "ingestion_date", "posted_at") if c in jobs.columns]
    row = F.struct(*order, *(c for c in fields if c not in order), F.length("description").alias("description_length"))
    out = jobs.groupBy(*keys).agg(F.min(row).alias("_row"))
    return out.select(*keys, *(F.col(f"_row.{c}").alias(c) for c in [*fields, "description_length"] if c not in keys))


def dim_skills(tagged: DataFrame) -> DataFrame:
    """Each skill with the first date on which it was seen and its key."""
    out = tagged.groupBy("skills").agg(F.min("ingestion_date").alias("ingestion_date"))
    return out.withColumn("skill_id", X.surrogate_key(F.col("skills")))


def latest_tags(tagged: DataFrame, jobs: DataFrame) -> DataFrame:
    """Of a posting that was met on several dates, the tags of the last one, so its facts do not stand twice."""
    last = jobs.groupBy("source", "job_id").agg(F.max("ingestion_date").alias("ingestion_date"))
    same = [tagged[c].eqNullSafe(last[c]) for c in ("source", "job_id", "ingestion_date")]
    return tagged.join(last, same, "left_semi")


def fact_job_skills(tagged: DataFrame, dim: DataFrame) -> DataFrame:
    """Natural to surrogate key. How the dimension travels is left to adaptive execution, which knows its size."""
    keep = [c for c in ("source", "job_id") if c in tagged.columns]
    tail = [c for c in ("skill_confidence", "processed_at", "ingestion_date", "posted_at") if c in tagged.columns]
    return tagged.join(dim.select("skills", "skill_id"), "skills").select(*keep, "skill_id", *tail)
