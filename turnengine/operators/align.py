"""Aligning drafts with golden translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnengine.functions.text import null_to_empty, strip_ws

KEY = ["conversazione", "turn_index"]


def dedupe_last(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """The last row, by order, of every key: one aggregation with map-side partials, no window."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("last")).select(*key, *[F.col(f"last.{c}").alias(c) for c in rest])


def _sides(draft: DataFrame, golden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both sides as their join takes them. Scoring the pairs is work for the processor, so the draft is dealt to all
    partitions here, once, in the way that the join asks for."""
    n = int(draft.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    right = dedupe_last(golden.select(*KEY, F.col("italiano").alias("golden_italiano"), F.col("napoletano").alias("golden"), "note", "ord"), KEY, "ord").drop("ord").withColumn("in_golden", F.lit(True))
    left = draft.select(*KEY, "tu_id", "speaker", "italiano", F.col("napoletano").alias("gemma"), "ord", F.lit(True).alias("in_draft"))
    return left.repartition(n, *KEY), right


def _texts() -> list[Column]:
    return [strip_ws(null_to_empty(F.col("gemma"))).alias("gemma"), strip_ws(null_to_empty(F.col("golden"))).alias("golden"), null_to_empty(F.col("note")).alias("note")]


def align_pairs(draft: DataFrame, golden: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """Pairs of draft and golden turns on (conversation, turn): the golden side last wins, draft repeats stay.

    draft and golden: flat turns with ord. only (code): conversations taken.
    """
    left, right = _sides(_asked_only(draft, only), golden)
    return left.join(right, KEY).select(*KEY, "tu_id", "speaker", "italiano", *_texts(), "golden_italiano", "ord")


def _asked_only(rows: DataFrame, only: DataFrame | None) -> DataFrame:
    return rows if only is None else rows.join(only.select(F.col("code").alias("conversazione")), "conversazione", "left_semi")


def align_all(draft: DataFrame, golden: DataFrame) -> DataFrame:
    """Every key of either side in one join, one exchange a side: pairs as of align_pairs, and rows of one side alone, told
    apart by side (both, draft, golden), and first, which marks one row of each key. pairs_of, misaligned_of and
    source_mismatch take what they need from it, without further joins."""
    left, right = _sides(draft, golden)
    nth = F.row_number().over(Window.partitionBy(*KEY).orderBy("ord"))  # the partitioning and order of the join
    side = F.when(F.col("in_draft").isNull(), "golden").when(F.col("in_golden").isNull(), "draft").otherwise("both")
    joined = left.withColumn("first", nth == 1).join(right, KEY, "full_outer")
    return joined.select(*KEY, side.alias("side"), F.coalesce("first", F.lit(True)).alias("first"), "tu_id", "speaker", "italiano", *_texts(), "golden_italiano", "ord")


def pairs_of(aligned: DataFrame, only: DataFrame | None = None) -> DataFrame:
    """The pairs of align_all."""
    return _asked_only(aligned.where("side = 'both'").drop("side", "first"), only)


def misaligned_of(aligned: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys only in the draft, keys only in the golden data) of align_all."""
    alone = lambda side: aligned.where(f"side = '{side}' and first").select(*KEY)
    return alone("draft"), alone("golden")


def first_pairs(pairs: DataFrame, limit: int) -> DataFrame:
    """The first pairs in draft order."""
    return pairs.orderBy("ord").limit(limit)


def misaligned(draft: DataFrame, golden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keys only in the draft, keys only in the golden data), over the whole of both."""
    return misaligned_of(align_all(draft, golden))


def source_mismatch(pairs: DataFrame) -> DataFrame:
    """Aligned pairs whose source texts differ."""
    return pairs.where(~F.col("italiano").eqNullSafe(F.col("golden_italiano")))


def alignment_counts() -> dict[str, Column]:
    """Aggregates of align_all that say what did not align: to be observed while it is written."""
    alone = lambda side: F.count_if((F.col("side") == side) & F.col("first"))
    differs = (F.col("side") == "both") & ~F.col("italiano").eqNullSafe(F.col("golden_italiano"))
    return {"pairs": F.count_if(F.col("side") == "both"), "draft_only": alone("draft"), "golden_only": alone("golden"), "source_differs": F.count_if(differs)}
