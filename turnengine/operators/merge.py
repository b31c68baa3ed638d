"""Merging draft and golden texts by decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnengine.functions.text import null_to_empty
from turnengine.operators.align import KEY, dedupe_last
from turnengine.operators.build import nest

#: Names of the two sources in the result (fixed values).
GOLDEN, DRAFT = "golden", "gemma4"


def decide(decisions: DataFrame, threshold: float | None = None, golden_only: bool = False) -> DataFrame:
    """decisions with sostituire settled: stored, recomputed from the stored similarity, or always."""
    if golden_only:
        return decisions.withColumn("sostituire", F.lit(True))
    return decisions if threshold is None else decisions.withColumn("sostituire", F.col("similarita") < F.lit(float(threshold)))


def merge(structure: DataFrame, decisions: DataFrame, threshold: float | None = None, golden_only: bool = False) -> DataFrame:
    """Flat final turns: the structure's turns that have a decision, with text and fonte chosen by it.

    decisions: KEY, italiano, gemma, golden, similarita, sostituire, ord; the last of a key wins.
    """
    decisions = decide(decisions, threshold, golden_only).select(*KEY, "italiano", "gemma", "golden", "similarita", "sostituire", "ord")
    decided = dedupe_last(decisions, KEY, "ord").drop("ord").withColumnRenamed("italiano", "decided_italiano")
    joined = structure.drop("napoletano", "note", "fonte").join(decided, KEY)
    own = [c for c in ("conv_ord", "turn_ord") if c in structure.columns]
    return joined.select(
        *KEY, "regione", "macro_regione", "languages", "tu_id", "speaker", "italiano", F.when(F.col("sostituire"), F.col("golden")).otherwise(F.col("gemma")).alias("napoletano"), F.lit("").alias("note"),
        F.when(F.col("sostituire"), F.lit(GOLDEN)).otherwise(F.lit(DRAFT)).alias("fonte"), F.round("similarita", 2).alias("similarita"), "gemma", "golden", "decided_italiano", *own,
    )


def undecided(structure: DataFrame, decisions: DataFrame) -> DataFrame:
    """Turns of the structure without a decision; the merge leaves them out."""
    return structure.select(*KEY, "italiano").join(decisions.select(*KEY), KEY, "left_anti")


def merged_mismatch(final: DataFrame) -> DataFrame:
    """Merged turns whose source text differs from the one that was scored; they are kept."""
    return final.where(is_mismatched()).select(*KEY, "italiano", "decided_italiano")


def is_mismatched() -> Column:
    return ~null_to_empty(F.col("italiano")).eqNullSafe(null_to_empty(F.col("decided_italiano")))


def source_aggregates() -> dict[str, Column]:
    """Of a merge: total, and count and percentage of either source (null percentages on an empty one)."""
    n = F.count("*")
    per = {s: F.count_if(F.col("fonte") == s) for s in (GOLDEN, DRAFT)}
    return {"total": n} | {k: v for s, c in per.items() for k, v in ((s, c), (f"{s}_pct", F.try_divide(c * 100.0, n)))}


def source_counts(final: DataFrame) -> DataFrame:
    """One row of source_aggregates."""
    return final.agg(*[c.alias(n) for n, c in source_aggregates().items()])


def all_conversations(structure: DataFrame, final: DataFrame) -> DataFrame:
    """Turns left per conversation of the structure; those that lost all stay with zero."""
    return structure.select("conversazione").distinct().join(final.groupBy("conversazione").agg(F.count("*").alias("n")), "conversazione", "left").select("conversazione", F.coalesce("n", F.lit(0)).alias("n_turni_italiani"))


def regroup(samples: DataFrame, final: DataFrame) -> DataFrame:
    """Nested conversations of a merge: every conversation of samples, in their order; those that lost all turns stay."""
    heads = samples.select("id", *[null_to_empty(F.col(c)).alias(c) for c in ("regione", "macro_regione", "languages")], F.col("ord").alias("conv_ord"))
    nested = nest(final).select("id", "n_turni_italiani", "turni")
    none = F.array().cast(nested.schema["turni"].dataType)
    return heads.join(nested, "id", "left").select("id", "regione", "macro_regione", "languages", F.coalesce("n_turni_italiani", F.lit(0)).alias("n_turni_italiani"), F.coalesce("turni", none).alias("turni"), "conv_ord")


def kept_apart(final: DataFrame) -> DataFrame:
    """Kept drafts that differ from the golden text."""
    return final.where(is_kept_apart())


def is_kept_apart() -> Column:
    return (F.col("fonte") == DRAFT) & (F.col("gemma") != F.col("golden"))


def riskiest(final: DataFrame, n: int = 10) -> DataFrame:
    """The n rows of kept_apart of least similarity; a top-k, not a full sort."""
    return kept_apart(final).select("similarita", *KEY, "gemma", "golden").orderBy("similarita", *KEY, "gemma", "golden").limit(n)
