"""The configuration of a run, put together in layers."""

from __future__ import annotations

import os
import tomllib
import uuid
from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from datetime import UTC, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera import tables
from tessera.operators import cluster


@dataclass(frozen=True)
class Config:
    """One environment. The run's time is the same in all its stages, so back-fills work."""

    root: str
    run_ts: datetime = field(default_factory=lambda: datetime.now(UTC))
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    service: str = "adzuna"
    query: str = "data engineer"
    country: str | None = None
    location: str | None = None
    max_pages: int = 5
    min_interval_seconds: float = 2.5
    max_fact_ratio: float = 20.0
    window_days: int = 30
    min_clusters: int = 3
    min_silhouette: float = 0.2
    k_values: tuple[int, ...] = cluster.K_VALUES
    dictionary: tuple[str, ...] | None = None
    model_version: str = "v1"
    latest_postings: bool = True

    def path(self, name: str) -> str:
        return tables.REGISTRY[name].path(self.root)

    def at(self) -> Column:
        return F.lit(self.run_ts.astimezone(UTC).strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def _typed(name: str, kind: str, value: object) -> object:
    """value as the field's type; text, as variables of the environment hold it, is read as that type."""
    try:
        if kind.startswith("tuple"):
            items = [x.strip() for x in value.split(",") if x.strip()] if isinstance(value, str) else list(value)
            return tuple((int if "int" in kind else str)(x) for x in items)
        if kind == "datetime":
            at = value if isinstance(value, datetime) else datetime.fromisoformat(value)
            return at if at.tzinfo else at.replace(tzinfo=UTC)
        if kind == "bool":
            return value if isinstance(value, bool) else {"true": True, "false": False}[str(value).lower()]
        return {"int": int, "float": float}.get(kind, str)(value)
    except (KeyError, TypeError, ValueError) as e:
        raise ValueError(f"{name}: {value!r} is no {kind}") from e


def load_config(file: str | None = None, env: str | None = None, variables: Mapping[str, str] | None = None, **given: object) -> Config:
    """Defaults, then the TOML file's common keys, then its table env.<env>, then variables TESSERA_<FIELD>, then what is given.
    None counts as not given; a key that is no field, or an environment that the file lacks, is an error."""
    said: dict = {}
    if file:
        with open(file, "rb") as f:
            said = tomllib.load(f)
    environments = said.pop("env", {})
    if env and env not in environments:
        raise ValueError(f"no environment {env} in {file}")
    variables = os.environ if variables is None else variables
    kinds = {f.name: f.type for f in fields(Config)}
    from_variables = {k: v for k in kinds if (v := variables.get(f"TESSERA_{k.upper()}"))}
    merged = said | environments.get(env, {}) | from_variables | {k: v for k, v in given.items() if v is not None}
    if unknown := sorted(set(merged) - set(kinds)):
        raise ValueError(f"unknown keys: {', '.join(unknown)}")
    if not merged.get("root"):
        raise ValueError("root must be given")
    return Config(**{k: _typed(k, kinds[k], v) for k, v in merged.items()})
