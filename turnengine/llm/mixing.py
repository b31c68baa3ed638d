"""Mixing sources to target weights by Poisson replication.

Each source has a target share of the mixed corpus. A document of source s is repeated Poisson(rate_s) times,
where rate_s = share_s * budget / characters_s, so that the expected characters of s in the result are
share_s * budget. The Poisson draw inverts the distribution at a uniform number made from an MD5 of the seed and
the document id: the same input and seed always give the same corpus, on any cluster, in any order, after any
retry. Built of DataFrame functions only.

Defined cases: null text counts zero characters; a null source is a source of its own; a source without any
characters has rate 1; a null doc_id draws as an id of its own; repeated rows with one doc_id get the same draw;
an empty table gives an empty table. Columns of the input keep their values, whatever their names: working
columns take free names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnengine.llm.common import free_name, materialize

#: The CDF of one draw is tabulated; larger rates are sums of independent draws of at most this rate.
PART_RATE = 16.0
#: Terms of the CDF table: at rate 16 the tail beyond 96 is below 1e-40, under the resolution of the uniform.
TERMS = 96


def uniform(seed: str, *parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 of seed and parts."""
    text = F.concat_ws(":", F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("bigint").cast("double") / F.lit(float(1 << 52))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, alpha: float = 0.5) -> DataFrame:
    """One row per source: mix_source, chars, rate, draws, cdf.

    weights: target shares by source, scaled to sum 1; sources it does not name get 0. None: shares in
    proportion to chars ** alpha. budget: expected characters of the result; None: those of docs.
    """
    stats = docs.groupBy(F.col("source").alias("mix_source")).agg(F.sum(F.coalesce(F.char_length("text"), F.lit(0))).cast("double").alias("chars"))
    stats = materialize(stats, "mix-sources")  # one row per source
    if weights is None:
        weight = F.when(F.col("chars") > 0, F.pow("chars", F.lit(alpha))).otherwise(F.lit(0.0))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("mix_source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    stats = stats.withColumn("weight", weight)
    total = stats.agg(F.sum("chars").alias("chars"), F.sum("weight").alias("weight")).first()
    budget = float(total["chars"] or 0.0) if budget is None else float(budget)
    mass = float(total["weight"] or 0.0)
    rate = F.when(F.col("chars") > 0, F.col("weight") / F.lit(mass or 1.0) * F.lit(budget) / F.col("chars")).otherwise(F.lit(1.0))
    draws = F.greatest(F.ceil(F.col("rate") / F.lit(PART_RATE)), F.lit(1)).cast("int")
    step = F.col("rate") / F.col("draws")
    start = F.struct(F.exp(-step).alias("p"), F.array(F.exp(-step)).alias("cdf"))
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS - 1)),
        start,
        lambda acc, k: F.struct((acc["p"] * step / k).alias("p"), F.concat(acc["cdf"], F.array(F.element_at(acc["cdf"], -1) + acc["p"] * step / k)).alias("cdf")),
        lambda acc: acc["cdf"],
    )
    return stats.withColumn("rate", rate).withColumn("draws", draws).withColumn("cdf", cdf).drop("weight")


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, budget: float | None = None, alpha: float = 0.5, seed: str = "mix-1", copy_col: str = "copy_no", key_col: str = "shuffle_key") -> DataFrame:
    """docs with every row repeated by its draw, plus copy_no (from 0) and shuffle_key, globally shuffled.

    The source table is joined without a hint: it is written first, so Spark broadcasts it only while its true
    size is under the threshold, and beyond that runs a sort-merge join whose hot sources AQE splits. The global
    shuffle deals rows by an MD5 of (document, copy) and orders each partition by it: a uniformly random
    permutation in one exchange, without the sampling pass of a global sort.
    """
    copy_col, key_col = free_name(docs.columns, copy_col), free_name(docs.columns, key_col)
    taken = [*docs.columns, copy_col, key_col]
    names = {c: free_name(taken, f"mix_{c}") for c in ("source", "draws", "cdf", "count", "place")}
    rates = materialize(source_rates(docs, weights, budget, alpha), "mix-rates")
    rates = rates.select(F.col("mix_source").alias(names["source"]), F.col("draws").alias(names["draws"]), F.col("cdf").alias(names["cdf"]))
    drawn = F.transform(F.sequence(F.lit(1), F.col(names["draws"])), lambda part: uniform(seed, F.col("doc_id"), part))  # one hash a draw
    count = F.aggregate(drawn, F.lit(0), lambda acc, u: acc + F.size(F.filter(F.col(names["cdf"]), lambda c: c <= u)))
    placed = docs.withColumn(names["place"], F.monotonically_increasing_id())
    mixed = (
        placed.join(rates, placed["source"].eqNullSafe(rates[names["source"]]), "inner")
        .withColumn(names["count"], count)
        .where(F.col(names["count"]) > 0)
        .withColumn(copy_col, F.explode(F.sequence(F.lit(0), F.col(names["count"]) - 1)))
        .drop(*[n for c, n in names.items() if c != "place"])
    )
    key = F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.lit("order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col(copy_col))), 1, 16)
    # rows that repeat, above all those without doc_id, share a key; their place in the input still spreads them
    return mixed.withColumn(key_col, key).repartition(key_col, names["place"]).sortWithinPartitions(key_col, names["place"]).drop(names["place"])
