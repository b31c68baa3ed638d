"""Numbering rows in a global order without gathering them in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnengine.storage import materialize


def _dealt(rows: DataFrame, order: list[str]) -> DataFrame:
    """rows in a table, dealt by range and sorted, with their partition and place in it; rows that tie are ordered by a hash."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tie = F.xxhash64(*[F.col(f"`{c}`") for c in rows.columns])
    dealt = rows.withColumn("_tie", tie).repartitionByRange(n, *order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    return materialize(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_place")), "numbered")


def starts(dealt: DataFrame, amount: Column) -> DataFrame:
    """(_part, _before): the amounts of the partitions before each; a row per partition."""
    sizes = dealt.groupBy("_part").agg(amount.alias("n"))
    sizes = sizes.agg(F.map_from_entries(F.collect_list(F.struct("_part", "n"))).alias("sizes"))  # an entry per partition
    before = F.aggregate(F.map_entries("sizes"), F.lit(0).cast("bigint"), lambda acc, e: acc + F.when(e["key"] < F.col("_part"), e["value"]).otherwise(F.lit(0)))
    return dealt.select("_part").distinct().join(F.broadcast(sizes)).select("_part", before.alias("_before"))


def with_ordinal(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """rows with name: their place, from 1, in the order of the columns; rows that tie are ordered by a hash.

    Rows are dealt by range, sorted within partitions and written with their partition and place: range bounds come from
    a sample, so two runs of one exchange may differ, and only what is written has bounds that every later step
    shares. A row's number is its place plus the rows of the partitions before, which are counted from that table: one
    number per partition meets in one task.
    """
    dealt = _dealt(rows, order)
    return dealt.join(F.broadcast(starts(dealt, F.count("*"))), "_part").select(*rows.columns, (F.col("_before") + F.col("_place") + 1).alias(name))


def running_sum(rows: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """rows with name: the sum of a column of whole numbers over this row and those before, in the order of the columns."""
    dealt = _dealt(rows, order)
    before = starts(dealt, F.sum(value).cast("bigint"))
    own = F.sum(value).over(Window.partitionBy("_part").orderBy("_place"))  # a partition is one range's share of the rows
    return dealt.withColumn("_own", own).join(F.broadcast(before), "_part").select(*rows.columns, (F.col("_before") + F.col("_own")).alias(name))
