"""Run configuration: typed values over documented defaults."""

from __future__ import annotations

import os
from dataclasses import asdict, dataclass, fields
from typing import Any

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Names and values of the settings (fixed values).
@dataclass(frozen=True)
class RunConfig:
    T_max: float = 1000.0
    step: float = 0.1
    tol: float = 1e-12
    precision: int = 50
    max_iter: int = 150
    expected_zeros: int = 0
    save_csv: bool = True
    save_plots: bool = True
    htop_enabled: bool = True
    lmfdb_check: bool = True
    monitoring_interval: int = 30
    log_resources_interval: int = 30


def overlay(given: dict[str, Any]) -> RunConfig:
    """Defaults under given values; numbers written without a dot (1e-12) arrive as text and are converted."""
    own = asdict(RunConfig())
    for f in fields(RunConfig):
        if given.get(f.name) is not None:
            kind = type(own[f.name])
            own[f.name] = given[f.name] if kind is bool else kind(given[f.name])
    return RunConfig(**own)


def load(path: str, *, create: bool = False) -> RunConfig:
    """The file's values over the defaults; a missing file gives the defaults, and with create is written."""
    if not os.path.exists(path):
        if create:
            with open(path, "w", encoding="utf-8") as f:
                yaml.safe_dump(asdict(RunConfig()), f)
        return RunConfig()
    with open(path, encoding="utf-8") as f:
        return overlay(yaml.safe_load(f) or {})


def created(path: str) -> dict[str, Any]:
    """The file's values alone, without defaults under them; a missing file is written with the defaults first."""
    if not os.path.exists(path):
        load(path, create=True)
    with open(path, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}


def defaults() -> dict[str, Any]:
    return asdict(RunConfig())


def overlaid(spark: SparkSession, given: dict[str, Any]) -> DataFrame:
    """(k, v, number) of every setting as a table: given values over the defaults, other keys ignored."""
    rows = lambda d: F.create_map(*[F.lit(x) for k, v in d.items() for x in (k, str(v))])
    known = {k: v for k, v in given.items() if k in defaults() and v is not None}
    own = spark.range(1).select(rows(defaults()).alias("own"))
    both = F.map_zip_with(own.own, rows(known), lambda k, a, b: F.coalesce(b, a)) if known else own.own
    return own.select(F.explode(both).alias("k", "v")).withColumn("number", F.col("v").try_cast("double"))
