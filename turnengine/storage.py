"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import Column, DataFrame, Observation, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as named by spark.checkpoint.dir; where that is unset, a local session gets one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = Path(tempfile.gettempdir(), "checkpoints").absolute().as_uri()
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_MADE: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Collects the tables that materialize() writes meanwhile and deletes those that are still listed at the end."""
    made: list[DataFrame] = []
    token = _MADE.set(made)
    try:
        yield made
    finally:
        _MADE.reset(token)
        for table_ in made:
            drop_materialized(table_)


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage in a way that survives lost executors, and gives the planner the true size of the
    table, so a later join is broadcast only if that size is under spark.sql.autoBroadcastJoinThreshold.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._turnengine_path = path
    if (made := _MADE.get()) is not None:
        made.append(back)
    return back


def measured(df: DataFrame, tag: str, **aggregates: Column) -> tuple[DataFrame, dict]:
    """materialize(), and aggregates of df taken in the pass that writes it."""
    seen = Observation(f"{tag}-{uuid.uuid4().hex}")
    return materialize(df.observe(seen, *[c.alias(n) for n, c in aggregates.items()]), tag), seen.get


def drop_materialized(df: DataFrame) -> None:
    """Delete a table of materialize() that nothing reads any more."""
    path = getattr(df, "_turnengine_path", None)
    if path:
        jvm, hadoop = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(hadoop).delete(target, True)
