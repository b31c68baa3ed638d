"""Windows over groups of which one may be very large.

A window sorts a group in one task. Groups of up to HOT rows are left to it. Rows of larger groups are dealt by range over all
tasks and numbered from one written table; what looks at neighbours then works on blocks of numbers, each with a halo of the
last rows before it. The results are the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnengine.functions.ordinal import with_ordinal
from turnengine.storage import drop_materialized, materialize

#: Rows from which a group is dealt over tasks, and rows of a block.
HOT, BLOCK = 500_000, 50_000


def hot_groups(rows: DataFrame, group: str) -> DataFrame | None:
    """(group) of the groups over HOT rows, or None. One pass over one column; only sums per group are shuffled."""
    found = materialize(rows.groupBy(group).agg(F.count("*").alias("n")).where(F.col("n") > HOT).select(group), "hot-groups")
    if found.isEmpty():
        drop_materialized(found)
        return None
    return found


def _apart(rows: DataFrame, group: str, hot: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows of other groups, rows of the hot ones), told apart by one left join; null groups are like others."""
    mark = hot.select(F.col(group).alias("_group"), F.lit(True).alias("_hot"))
    marked = rows.join(mark, rows[group].eqNullSafe(mark["_group"]), "left").drop("_group")
    return marked.where("_hot is null").drop("_hot"), marked.where("_hot").drop("_hot")


def _numbered(rows: DataFrame, group: str, order: list[str], name: str) -> DataFrame:
    told = with_ordinal(rows, [group, *order], "_n")
    first = materialize(told.groupBy(F.col(group).alias("_group")).agg(F.min("_n").alias("_first")), "hot-firsts")  # a row per hot group
    joined = told.join(first, told[group].eqNullSafe(first["_group"]))
    return joined.select(*rows.columns, (F.col("_n") - F.col("_first") + 1).cast("int").alias(name))


def number_within(rows: DataFrame, group: str, order: list[str], name: str, hot: DataFrame | None) -> DataFrame:
    """rows with name: their place, from 1, within their group. hot: the groups to deal over tasks, as of hot_groups."""
    nth = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    if hot is None:
        return rows.withColumn(name, nth)
    cold, large = _apart(rows, group, hot)
    return cold.withColumn(name, nth).unionByName(_numbered(large, group, order, name))


def with_before(rows: DataFrame, group: str, order: list[str], n: int, hot: DataFrame | None, add: Callable[[DataFrame, Window], DataFrame]) -> DataFrame:
    """What add makes of rows and a window over the n rows before each in its group."""
    plain = Window.partitionBy(group).orderBy(*order).rowsBetween(-n, -1)
    if hot is None:
        return add(rows, plain)
    cold, large = _apart(rows, group, hot)
    told = _numbered(large, group, order, "_i").withColumn("_block", F.floor((F.col("_i") - 1) / F.lit(BLOCK)))
    # the last n rows of a block also stand before the next
    late: Column = (F.col("_i") - 1) % BLOCK >= BLOCK - n
    blocks = F.when(late, F.array("_block", F.col("_block") + 1)).otherwise(F.array("_block"))
    dealt = told.select("*", F.explode(blocks).alias("_in"))
    done = add(dealt, Window.partitionBy(group, "_in").orderBy("_i").rowsBetween(-n, -1))
    done = done.where("_in = _block").drop("_in", "_block", "_i")
    return add(cold, plain).unionByName(done)
