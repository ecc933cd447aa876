"""Declared schemas and the dataset registry."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "double": T.DoubleType(), "int": T.IntegerType(), "bigint": T.LongType(), "boolean": T.BooleanType(),
    "date": T.DateType(), "timestamp": T.TimestampType(), "array<double>": T.ArrayType(T.DoubleType()),
}


def _struct(text: str) -> T.StructType:
    """Flat "name type, ..." without a session."""
    return T.StructType([T.StructField(n, _TYPES[t]) for n, t in (c.split() for c in text.split(", "))])


#: The canonical posting record that every source is normalised to.
CANONICAL = _struct(
    "source string, source_job_id string, job_title_raw string, company_raw string, location_raw string, description_raw string, "
    "url string, employment_type_raw string, contract_type_raw string, salary_min_raw double, salary_max_raw double, "
    "currency_raw string, posted_at_raw string"
)
INGESTION = _struct("run_id string, source string, query string, location string, started_at string, canonical_schema_version string")
ENVELOPE = T.StructType(
    [T.StructField("ingestion_metadata", INGESTION), T.StructField("raw_payload", T.StringType()), T.StructField("payload", CANONICAL)]
)
SILVER_JOBS = _struct(
    "source string, job_id string, job_title string, company string, location string, description string, url string, "
    "ingested_at timestamp, ingestion_date date, posted_at timestamp"
)
SILVER_JOB_SKILLS = _struct(
    "source string, job_id string, ingestion_date date, posted_at timestamp, skills string, skill_confidence double, "
    "extraction_method string, processed_at timestamp"
)
DIM_JOBS = _struct(
    "job_id string, source string, job_title string, company string, location string, ingestion_date date, posted_at timestamp, "
    "description_length int"
)
DIM_SKILLS = _struct("skills string, ingestion_date date, skill_id string")
FACT = _struct(
    "source string, job_id string, skill_id string, skill_confidence double, processed_at timestamp, ingestion_date date, posted_at timestamp"
)
SKILL_EMBEDDINGS = _struct(
    "skill_id string, skills string, embedding array<double>, embedding_dim int, model_name string, model_version string, "
    "model_provider string, generated_at timestamp, is_active boolean"
)
JOB_EMBEDDINGS = _struct(
    "job_id string, model_version string, aggregation_method string, embedding array<double>, embedding_normalized array<double>, "
    "embedding_dim int, skill_count bigint, generated_at timestamp"
)
CLUSTERS = _struct(
    "cluster_id int, cluster_size bigint, avg_distance_to_centroid double, model_id string, model_version string, created_at timestamp"
)
MEMBERSHIP = _struct(
    "job_id string, cluster_id int, distance_to_centroid double, model_id string, model_version string, assigned_at timestamp"
)
CENTROIDS = _struct(
    "cluster_id int, model_id string, model_version string, centroid_vector array<double>, embedding_dim int, created_at timestamp"
)
CLUSTER_METADATA = _struct(
    "model_id string, model_name string, model_version string, algorithm string, hyperparameters string, training_size bigint, "
    "silhouette_score double, created_at timestamp"
)


@dataclass(frozen=True)
class DatasetDef:
    """Where a table lives below a root, how it is partitioned and read."""

    name: str
    schema: T.StructType
    layer: str
    partition_by: tuple[str, ...] = ()
    window_column: str | None = None
    keys: tuple[str, ...] = ()
    fmt: str = "parquet"

    def path(self, root: str) -> str:
        return f"{root.rstrip('/')}/{self.layer}/{self.name}"


REGISTRY = {
    d.name: d
    for d in (
        DatasetDef("bronze_jobs", ENVELOPE, "bronze", ("ingestion_date", "source", "run_id"), fmt="json"),
        DatasetDef("silver_jobs", SILVER_JOBS, "silver", ("ingestion_date",), keys=("source", "job_id")),
        DatasetDef("silver_job_skills", SILVER_JOB_SKILLS, "silver", ("ingestion_date",), keys=("source", "job_id", "skills")),
        DatasetDef("gold_dim_jobs", DIM_JOBS, "gold", window_column="posted_at", keys=("source", "job_id")),
        DatasetDef("gold_dim_skills", DIM_SKILLS, "gold", keys=("skill_id",)),
        DatasetDef("gold_fact_job_skills", FACT, "gold", ("ingestion_date",), "posted_at", ("source", "job_id", "skill_id")),
        DatasetDef("feature_skill_embeddings", SKILL_EMBEDDINGS, "feature", keys=("skill_id", "model_version")),
        DatasetDef("feature_job_embeddings", JOB_EMBEDDINGS, "feature", keys=("job_id", "model_version")),
        DatasetDef("ml_job_clusters", CLUSTERS, "ml", keys=("cluster_id", "model_id")),
        DatasetDef("ml_job_membership", MEMBERSHIP, "ml", keys=("job_id", "model_id")),
        DatasetDef("ml_job_centroids", CENTROIDS, "ml", keys=("cluster_id", "model_id")),
        DatasetDef("ml_job_cluster_metadata", CLUSTER_METADATA, "ml", keys=("model_id",)),
    )
}
