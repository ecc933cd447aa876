"""Checks and metrics: each is one aggregate over its input."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def null_metrics(df: DataFrame, *columns: str) -> DataFrame:
    """total and null_<column> counts; 0, never null, for an empty input."""
    return df.agg(F.count("*").alias("total"), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns))


def row_count(df: DataFrame, min_rows: int = 1) -> DataFrame:
    return df.agg(F.count("*").alias("rows")).withColumn("passed", F.col("rows") >= min_rows)


def required_fields(df: DataFrame, *fields: str) -> DataFrame:
    """A row for each field: its nulls and whether it passed."""
    counts = df.agg(*(F.count_if(F.col(c).isNull()).alias(c) for c in fields))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).alias("nulls")) for c in fields)))
    return counts.select(rows.alias("x")).select("x.field", "x.nulls", (F.col("x.nulls") == 0).alias("passed"))


def uniqueness(df: DataFrame, *fields: str) -> DataFrame:
    """Rows against distinct values, of which null is one."""
    by = df.groupBy(*fields).agg(F.count("*").alias("n"))
    out = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct_rows"))
    return out.withColumn("passed", F.col("rows") == F.col("distinct_rows"))


def freshness(df: DataFrame, column: str, now: Column, max_hours: float) -> DataFrame:
    """Rows older than max_hours at now."""
    age = F.unix_timestamp(now.cast("timestamp")) - F.unix_timestamp(F.col(column).cast("timestamp"))
    return df.agg(F.count("*").alias("rows"), F.count_if(age > max_hours * 3600).alias("stale")).withColumn("passed", F.col("stale") == 0)


def orphans(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    return fact.join(dim.select(key), key, "left_anti")


def gold_metrics(facts: DataFrame, jobs: DataFrame, key: str = "job_id", max_ratio: float = 20.0) -> DataFrame:
    """Jobs, facts, orphans and facts a job (0 without jobs), with the alarms."""
    f = facts.agg(F.count("*").alias("facts"))
    j = jobs.agg(F.count("*").alias("jobs"))
    o = orphans(facts.select(key), jobs, key).agg(F.count("*").alias("orphans"))
    ratio = F.coalesce(F.round(F.try_divide("facts", "jobs"), 2), F.lit(0.0))
    return f.join(j).join(o).withColumn("fact_per_job", ratio).withColumns(  # three one-row sides
        {"has_orphans": F.col("orphans") > 0, "ratio_high": F.col("fact_per_job") > max_ratio, "no_jobs": F.col("jobs") == 0}
    )


def feature_metrics(embeddings: DataFrame) -> DataFrame:
    return embeddings.agg(F.count("*").alias("jobs_embedded")).withColumn("none_embedded", F.col("jobs_embedded") == 0)


def ml_metrics(members: DataFrame, metadata: DataFrame, min_clusters: int = 3, min_silhouette: float = 0.2) -> DataFrame:
    m = members.agg(F.count_distinct("cluster_id").alias("clusters"), F.avg("distance_to_centroid").alias("avg_distance"))
    s = metadata.agg(F.max("silhouette_score").alias("silhouette"))
    return m.join(s).withColumns({"few_clusters": F.col("clusters") < min_clusters, "poor_silhouette": F.col("silhouette") < min_silhouette})


#: For each source, the fields that its records may hold beside the common ones.
COMMON = ("source", "job_id", "job_title_raw", "company_raw", "location_raw", "description_raw", "url", "scraped_at")
SOURCES = {"indeed": (), "linkedin": ("employment_type", "seniority_level", "industry")}


def validate_records(df: DataFrame, json: str = "json", sources: dict[str, tuple[str, ...]] = SOURCES) -> DataFrame:
    """JSON records with errors array<string>: unknown source, empty id, bad url, bad time, unknown fields. Empty: valid."""
    record = F.from_json(F.col(json), T.MapType(T.StringType(), T.StringType()))
    allowed = F.create_map(*(x for s, more in sources.items() for x in (F.lit(s), F.array(*(F.lit(c) for c in (*COMMON, *more))))))
    r = lambda c: F.try_element_at(F.col("_r"), F.lit(c))
    known = F.try_element_at(allowed, r("source"))
    rules = {
        "not_json": F.col("_r").isNull(),
        "unknown_source": F.col("_r").isNotNull() & known.isNull(),
        "empty_id": F.col("_r").isNotNull() & (F.coalesce(F.length(r("job_id")), F.lit(0)) == 0),
        "bad_url": r("url").isNotNull() & ~F.coalesce(r("url").rlike(r"^https?://[^\s/$.?#][^\s]*$"), F.lit(False)),
        "bad_time": F.col("_r").isNotNull() & F.try_to_timestamp(r("scraped_at")).isNull(),
        "unknown_field": known.isNotNull() & (F.size(F.array_except(F.map_keys("_r"), known)) > 0),
    }
    errors = F.filter(F.array(*(F.when(rule, F.lit(name)) for name, rule in rules.items())), lambda x: x.isNotNull())
    return df.withColumn("_r", record).withColumn("errors", errors).drop("_r")


def split_valid(df: DataFrame, json: str = "json") -> tuple[DataFrame, DataFrame]:
    checked = validate_records(df, json)
    return checked.where(F.size("errors") == 0).drop("errors"), checked.where(F.size("errors") > 0)


def check_contract(df: DataFrame, schema: T.StructType) -> list[str]:
    """What df lacks of schema: missing columns and other types."""
    have = {f.name: f.dataType for f in df.schema}
    return [f"{f.name}: missing" for f in schema if f.name not in have] + [
        f"{f.name}: {have[f.name].simpleString()}, not {f.dataType.simpleString()}" for f in schema if f.name in have and have[f.name] != f.dataType
    ]
