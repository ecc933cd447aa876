"""Stages, the data and ML pipelines made of them, and a command line."""

from __future__ import annotations

import argparse
import logging
import os
import time
from collections.abc import Callable
from dataclasses import dataclass, replace
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera import tables
from tessera.operators import clean, cluster, embed, quality, star
from tessera.plans import logs
from tessera.plans.settings import Config, load_config
from tessera.session import create_session
from tessera.sources import http, scans, sinks

log = logging.getLogger("tessera")


class StageSkip(Exception):
    """Nothing to do: counts as success."""


@dataclass(frozen=True)
class Stage:
    """read -> transform -> check -> write -> ledger. Outputs are computed once: written to a folder beside the tables, checked and copied from
    there, so no executor holds them and a lost one costs nothing."""

    name: str
    inputs: tuple[str, ...]
    transform: Callable[[SparkSession, Config, dict[str, DataFrame]], dict[str, DataFrame]]
    incremental: bool = False
    windowed: bool = False
    may_be_empty: tuple[str, ...] = ()
    metrics: Callable[[Config, dict[str, DataFrame]], DataFrame] | None = None

    def read(self, spark: SparkSession, cfg: Config, new: dict[str, dict[str, int]] | None = None) -> dict[str, DataFrame]:
        """The inputs; an incremental stage's are pruned to the dates that are new or have late files, which new gets by input. Such dates are read
        whole and replace what an earlier run wrote for them."""
        new = {} if new is None else new
        if missing := scans.missing_inputs(spark, *(cfg.path(n) for n in self.inputs)):
            raise FileNotFoundError(f"missing inputs: {', '.join(missing)}")
        out = {}
        for name in self.inputs:
            d = tables.REGISTRY[name]
            df = scans.scan(spark, cfg.path(name), d.fmt, None if d.fmt == "parquet" else T.StructType([*d.schema, T.StructField("ingestion_date", T.DateType())]))
            if self.incremental and d.partition_by:
                new[name] = scans.new_partitions(spark, cfg.path(name), d.partition_by[0], scans.read_ledger(spark, f"{cfg.root}/_ledger"), self.name, name)
                df = scans.scan_dates(df, d.partition_by[0], new[name])
            if self.windowed:
                df = scans.scan_window(df, d.window_column, cfg.run_ts.astimezone(UTC).replace(tzinfo=None), cfg.window_days)
            out[name] = df
        if self.incremental and all(df.isEmpty() for df in out.values()):
            raise StageSkip(f"{self.name}: nothing new")
        return out

    def run(self, spark: SparkSession, cfg: Config) -> dict:
        with logs.bound(run_id=cfg.run_id, stage=self.name):
            return self._run(spark, cfg)

    def _run(self, spark: SparkSession, cfg: Config) -> dict:
        began, new, staged = time.time(), {}, f"{cfg.root}/_staging/{self.name}-{cfg.run_id}"
        try:
            inputs, outputs = self.read(spark, cfg, new), {}
            for name, df in self.transform(spark, cfg, inputs).items():
                if wrong := quality.check_contract(df, tables.REGISTRY[name].schema):
                    raise ValueError(f"{name}: {'; '.join(wrong)}")
                sinks.write_parquet(df, f"{staged}/{name}")
                outputs[name] = spark.read.schema(df.schema).parquet(f"{staged}/{name}")
                if outputs[name].isEmpty():
                    if name not in self.may_be_empty:
                        raise ValueError(f"{name} is empty")
                    log.warning("%s is empty", name)
            said = self.metrics(cfg, outputs).first().asDict() if self.metrics else {}
            for k, v in said.items():
                if v is True or k.startswith("null_") and v:
                    log.warning("%s: %s is %s", self.name, k, v)
            for name, df in outputs.items():
                d = tables.REGISTRY[name]
                sinks.write_parquet(df.select(*d.schema.fieldNames()), cfg.path(name), d.partition_by)
            if self.incremental:
                for name, partitions in new.items():
                    scans.mark_partitions(spark, partitions, f"{cfg.root}/_ledger", self.name, name, cfg.at())
            result = {"stage": self.name, "status": "done", "metrics": said}
        except StageSkip as e:
            result = {"stage": self.name, "status": "skipped", "metrics": {}, "why": str(e)}
        finally:
            sinks.remove(spark, staged)
        result["seconds"] = round(time.time() - began, 3)
        log.info(result)
        return result


#: The services' options that hold keys, with the variables of the environment that they come from.
KEYS = {"adzuna": {"app_id": "ADZUNA_APP_ID", "app_key": "ADZUNA_API_KEY"}, "usajobs": {"app_key": "USAJOBS_API_KEY"}}


def bronze(spark: SparkSession, cfg: Config, options: dict | None = None) -> int:
    """Pages of the service as JSON lines under their date, source and run, and a row in the table of runs."""
    if cfg.service == "adzuna" and not (cfg.country or "").strip():
        raise ValueError("country must not be empty")
    spark.dataSource.register(http.PostingsSource)
    asked = {
        "service": cfg.service, "query": cfg.query, "country": cfg.country, "location": cfg.location, "max_pages": cfg.max_pages,
        "min_interval_seconds": cfg.min_interval_seconds, **{k: os.environ.get(v) for k, v in KEYS.get(cfg.service, {}).items()},
    } | (options or {})
    raw = spark.read.format("postings").options(**{k: str(v) for k, v in asked.items() if v is not None}).load()
    started = cfg.run_ts.astimezone(UTC).strftime("%Y-%m-%dT%H:%M:%S.%f")
    df = http.envelope(raw, cfg.run_id, cfg.query, cfg.location, started)
    parts = {"ingestion_date": F.lit(cfg.run_ts.astimezone(UTC).date()), "source": F.lit(cfg.service), "run_id": F.lit(cfg.run_id)}
    rows = sinks.write_jsonl(df.withColumns(parts), cfg.path("bronze_jobs"), tuple(parts))
    sinks.write_run(spark, f"{cfg.root}/_runs", cfg.run_id, cfg.service, rows, started)
    return rows


def _silver(spark: SparkSession, cfg: Config, x: dict[str, DataFrame]) -> dict[str, DataFrame]:
    flat = clean.flatten_envelope(x["bronze_jobs"].drop("source", "run_id"))
    jobs = clean.deduplicate_jobs(clean.clean_jobs(flat)).select(*tables.SILVER_JOBS.fieldNames())
    more = {"dictionary": cfg.dictionary} if cfg.dictionary else {}
    return {"silver_jobs": jobs, "silver_job_skills": star.job_skills(jobs, cfg.at(), **more).select(*tables.SILVER_JOB_SKILLS.fieldNames())}


def _gold(spark: SparkSession, cfg: Config, x: dict[str, DataFrame]) -> dict[str, DataFrame]:
    dim = star.dim_skills(x["silver_job_skills"])
    tags = star.latest_tags(x["silver_job_skills"], x["silver_jobs"]) if cfg.latest_postings else x["silver_job_skills"]
    return {
        "gold_dim_jobs": star.dim_jobs(x["silver_jobs"]).select(*tables.DIM_JOBS.fieldNames()),
        "gold_dim_skills": dim.select(*tables.DIM_SKILLS.fieldNames()),
        "gold_fact_job_skills": star.fact_job_skills(tags, dim).select(*tables.FACT.fieldNames()),
    }


def _feature(spark: SparkSession, cfg: Config, x: dict[str, DataFrame]) -> dict[str, DataFrame]:
    skills = embed.skill_embeddings(x["gold_dim_skills"], model_version=cfg.model_version, generated_at=cfg.at())
    fact = x["gold_fact_job_skills"].withColumn("job_id", F.concat_ws(":", "source", "job_id"))
    return {"feature_skill_embeddings": skills, "feature_job_embeddings": embed.job_embeddings(fact, skills, cfg.model_version, generated_at=cfg.at())}


def _ml(spark: SparkSession, cfg: Config, x: dict[str, DataFrame]) -> dict[str, DataFrame]:
    return cluster.build_job_clusters(spark, x["feature_job_embeddings"], cfg.model_version, cfg.k_values, cfg.run_id, cfg.at())


#: Gold reads silver whole: its dimensions are rebuilt, so no key is met twice.
STAGES = {
    "silver": Stage(
        "silver", ("bronze_jobs",), _silver, incremental=True, may_be_empty=("silver_job_skills",),
        metrics=lambda c, o: quality.null_metrics(o["silver_jobs"], "company", "location", "posted_at"),
    ),
    "gold": Stage(
        "gold", ("silver_jobs", "silver_job_skills"), _gold,
        metrics=lambda c, o: quality.gold_metrics(o["gold_fact_job_skills"], o["gold_dim_jobs"], max_ratio=c.max_fact_ratio),
    ),
    "feature": Stage(
        "feature", ("gold_dim_skills", "gold_fact_job_skills"), _feature, windowed=True,
        metrics=lambda c, o: quality.feature_metrics(o["feature_job_embeddings"]),
    ),
    "ml": Stage(
        "ml", ("feature_job_embeddings",), _ml,
        metrics=lambda c, o: quality.ml_metrics(o["ml_job_membership"], o["ml_job_cluster_metadata"], c.min_clusters, c.min_silhouette),
    ),
}


def run_data_pipeline(spark: SparkSession, cfg: Config, services: tuple[str, ...] = ("adzuna",), options: dict | None = None) -> list[dict]:
    """bronze for each service, then silver, then gold."""
    for s in services:
        bronze(spark, replace(cfg, service=s), options)
    return [STAGES[n].run(spark, cfg) for n in ("silver", "gold")]


def run_ml_pipeline(spark: SparkSession, cfg: Config) -> list[dict]:
    return [STAGES[n].run(spark, cfg) for n in ("feature", "ml")]


def main(argv: list[str] | None = None) -> None:
    """bronze silver gold data-pipeline feature ml ml-pipeline"""
    p = argparse.ArgumentParser(prog="tessera")
    p.add_argument("command", choices=["bronze", "silver", "gold", "data-pipeline", "feature", "ml", "ml-pipeline"])
    p.add_argument("--config", help="a TOML file: common keys, and a table env.<name> for each environment")
    p.add_argument("--env")
    p.add_argument("--root")
    p.add_argument("--execution-date")
    p.add_argument("--query")
    p.add_argument("--country")
    p.add_argument("--location")
    p.add_argument("--master")
    p.add_argument("--log-file")
    a = p.parse_args(argv)
    cfg = load_config(a.config, a.env, root=a.root, run_ts=a.execution_date, query=a.query, country=a.country, location=a.location)
    logs.configure(a.log_file)
    spark = create_session("tessera", a.master)
    if a.command == "bronze":
        bronze(spark, cfg)
    elif a.command == "data-pipeline":
        run_data_pipeline(spark, cfg)
    elif a.command == "ml-pipeline":
        run_ml_pipeline(spark, cfg)
    else:
        STAGES[a.command].run(spark, cfg)


if __name__ == "__main__":
    main()
