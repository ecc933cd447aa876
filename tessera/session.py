"""Session factory: UTC, ANSI and adaptive execution on; everything else is the caller's."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import SparkSession

DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.ui.enabled": "false",
}


def create_session(app_name: str = "tessera", master: str | None = None, conf: Mapping[str, str] | None = None) -> SparkSession:
    """A session with DEFAULTS, overridden by conf; master only where none is set by the launcher."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in (DEFAULTS | dict(conf or {})).items():
        builder = builder.config(key, str(value))
    return builder.getOrCreate()


def scratch_dir(spark: SparkSession) -> str:
    """A folder that driver and executors share: spark.checkpoint.dir, or a local one in local mode only."""
    import tempfile

    sc = spark.sparkContext
    shared = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if shared:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(shared)
        return shared.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    local = "file://" + tempfile.mkdtemp(prefix="tessera-")
    sc.setCheckpointDir(local)
    return sc.getCheckpointDir()
