"""Keyed corrections of turns: ordered literal replacements, all or nothing per turn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnengine.functions.text import null_to_empty


def correction_lists(corrections: DataFrame) -> DataFrame:
    """One row per turn key with its (old, new) pairs in order."""
    return corrections.groupBy("conversazione", "turn_index").agg(F.array_sort(F.collect_list(F.struct("ord", "old", "new"))).alias("pairs"))


def corrected(turns: DataFrame, corrections: DataFrame) -> DataFrame:
    """Every turn with fix_status: null, modified, already-correct or not-found, and the new napoletano.

    The pairs are folded left to right: an old text that is there is replaced everywhere; else a new text that is
    there counts as done; else the whole turn is left as it was.
    """
    joined = turns.join(correction_lists(corrections), ["conversazione", "turn_index"], "left")
    text = null_to_empty(F.col("napoletano"))
    fold = F.aggregate(
        "pairs",
        F.struct(text.alias("text"), F.lit(0).alias("problems")),
        lambda acc, p: F.struct(
            F.when(F.contains(acc["text"], p["old"]), F.replace(acc["text"], p["old"], p["new"])).otherwise(acc["text"]).alias("text"),
            (acc["problems"] + F.when(F.contains(acc["text"], p["old"]) | F.contains(acc["text"], p["new"]), 0).otherwise(1)).alias("problems"),
        ),
    )
    status = F.when(F.col("pairs").isNull(), None).when(F.col("fold.problems") > 0, "not-found").when(F.col("fold.text") != text, "modified").otherwise("already-correct")
    out = joined.withColumn("fold", fold).withColumn("fix_status", status)
    return out.withColumn("napoletano", F.when(F.col("fix_status") == "modified", F.col("fold.text")).otherwise(F.col("napoletano"))).drop("fold", "pairs")


def correction_status(turns: DataFrame, corrections: DataFrame) -> DataFrame:
    """One row per correction key and turn it meets: status, with absent where no turn does; sorted output is (key)."""
    done = corrected(turns, corrections).where("fix_status is not null").select("conversazione", "turn_index", "fix_status", "napoletano")
    keys = corrections.select("conversazione", "turn_index").distinct()
    return keys.join(done, ["conversazione", "turn_index"], "left").select("conversazione", "turn_index", F.coalesce("fix_status", F.lit("absent")).alias("status"), null_to_empty(F.col("napoletano")).alias("text"))
