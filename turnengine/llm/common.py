"""Shared plumbing of the training-data operators: inputs and shared storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnengine.shipping import ship
from turnengine.storage import drop_materialized, materialize, scratch, shared_dir

__all__ = ["drop_materialized", "free_name", "materialize", "scratch", "shared_dir", "ship", "shuffle_partitions", "table"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(columns: list[str], wanted: str) -> str:
    """wanted, with underscores put before it until no column has that name (Spark ignores case)."""
    taken = {c.lower() for c in columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
