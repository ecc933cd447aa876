"""K-means over job vectors with a searched number of groups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera import tables
from tessera.functions import vectors as V

K_VALUES = (10, 15, 20, 25, 30)
SEED = 42


@dataclass(frozen=True)
class Fit:
    model: object
    k: int
    silhouette: float


def find_optimal_fit(df: DataFrame, k_values: Sequence[int] = K_VALUES, seed: int = SEED) -> Fit:
    """Fits each k on features; the first best cosine silhouette over -1 wins."""
    judge = ClusteringEvaluator(featuresCol="features", predictionCol="cluster_id", distanceMeasure="cosine")
    best: Fit | None = None
    for k in k_values:
        model = KMeans(k=k, seed=seed, featuresCol="features", predictionCol="cluster_id").fit(df)
        if len(model.clusterCenters()) < 2:
            continue
        score = judge.evaluate(model.transform(df))
        if score > (best.silhouette if best else -1.0):
            best = Fit(model, k, score)
    if best is None:
        raise ValueError("no number of clusters gave a usable silhouette")
    return best


def distance_to_centroid(assigned: DataFrame, centroids: DataFrame, vector: str, cosine: bool = False) -> DataFrame:
    """1 - v.c beside each row (c as it is), or the true cosine distance."""
    c = centroids.select("cluster_id", F.col("centroid_vector").alias("_c"))
    v = V.doubles(F.col(vector))
    near = V.cosine(v, F.col("_c")) if cosine else V.dot(v, F.col("_c"))
    return assigned.join(c, "cluster_id").withColumn("distance_to_centroid", 1 - near).drop("_c")


def cluster_stats(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster_id").agg(F.count("*").alias("cluster_size"), F.avg("distance_to_centroid").alias("avg_distance_to_centroid"))


def build_job_clusters(
    spark: SparkSession, embeddings: DataFrame, model_version: str, k_values: Sequence[int] = K_VALUES, model_id: str = "kmeans",
    created_at: Column | None = None, key: str = "job_id", vector: str = "embedding_normalized",
) -> dict[str, DataFrame]:
    """The four cluster tables. Rows without a valid vector are left out; none at all is an error."""
    at = created_at if created_at is not None else F.current_timestamp()
    usable = embeddings.where(V.valid(F.col(vector))).select(key, V.doubles(F.col(vector)).alias("_v"))
    usable = usable.repartition(F.col(key)).sortWithinPartitions(key).withColumn("features", array_to_vector("_v")).persist()
    try:
        size = usable.count()
        if not size:
            raise ValueError("no valid vector to cluster")
        fit = find_optimal_fit(usable, k_values)
        centers = [[float(x) for x in c] for c in fit.model.clusterCenters()]
        centroids = spark.createDataFrame([(i, c) for i, c in enumerate(centers)], "cluster_id int, centroid_vector array<double>")
        assigned = fit.model.transform(usable).select(key, "cluster_id", "_v")
        ids = (F.lit(model_id).alias("model_id"), F.lit(model_version).alias("model_version"))
        members = distance_to_centroid(assigned, centroids, "_v").select(key, "cluster_id", "distance_to_centroid", *ids, at.alias("assigned_at"))
        meta = [(model_id, "kmeans_jobs", model_version, "kmeans", fit.k, len(centers), SEED, size, fit.silhouette)]
        metadata = spark.createDataFrame(
            meta, "model_id string, model_name string, model_version string, algorithm string, k int, centers int, seed int, training_size bigint, silhouette_score double"
        ).select(
            "model_id", "model_name", "model_version", "algorithm", F.to_json(F.struct("k", "centers", "seed")).alias("hyperparameters"),
            "training_size", "silhouette_score", at.alias("created_at"),
        )
        return {
            "ml_job_membership": members,
            "ml_job_clusters": cluster_stats(members).select("cluster_id", "cluster_size", "avg_distance_to_centroid", *ids, at.alias("created_at")),
            "ml_job_centroids": centroids.select(
                "cluster_id", *ids, "centroid_vector", F.size("centroid_vector").alias("embedding_dim"), at.alias("created_at")
            ),
            "ml_job_cluster_metadata": metadata.select(*tables.CLUSTER_METADATA.fieldNames()),
        }
    finally:
        usable.unpersist()
