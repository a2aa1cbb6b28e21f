"""Tables that cut lineage, in the folder the cluster shares, and the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from serion.sources.storage import Scratch, shared_dir

__all__ = ["Scratch", "free_name", "shared_dir", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """The name, with as many underscores behind it as make it none of df's columns."""
    while name.lower() in map(str.lower, df.columns):
        name += "_"
    return name
