"""Corpus-shaped DataFrames derived from the test tables by fixed arithmetic; catalog.py has the same rules as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Source turns: every turn of conversations."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("conv_id").cast("string").alias("conversazione"), (F.col("turn") + 1).cast("int").alias("turn_index"), F.col("turn").cast("string").alias("tu_id"), F.col("role").alias("speaker"), F.col("text").alias("italiano"),
        "conv_id", "turn", (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("ord"),
    )


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token rows: white-space words; marks by k = 7 conv_id + turn and the place of the word."""
    k = F.col("conv_id") * 7 + F.col("turn")
    words = turns(spark, sf_dir).select("conversazione", F.col("tu_id").alias("tu"), "speaker", k.alias("k"), "turn", F.posexplode(F.split("italiano", r"\s+")).alias("p", "form"))
    kind = F.when((F.col("k") % 7 == 0) & (F.col("p") == 1), "error").when(F.col("k") % 11 == 0, "shortpause").otherwise("linguistic")
    return words.select(
        "conversazione", (F.col("turn") * 100_000 + F.col("p")).alias("pos"), "speaker", "tu", "form", kind.alias("type"),
        F.when((F.col("k") % 5 == 0) & (F.col("p") == 0), "some").otherwise("none").alias("variation"), F.when(F.col("p") % 6 == 0, "SpaceAfter=No").otherwise("_").alias("feats"),
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata of conversations, from nation and region; those with conv_id mod 10 = 9 have none."""
    codes = table(spark, sf_dir, "conversations").select("conv_id").distinct().where("conv_id % 10 <> 9")
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    joined = codes.join(nation, F.col("conv_id") % 25 == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select(F.col("conv_id").cast("string").alias("code"), F.col("n_name").alias("regione"), F.col("r_name").alias("macro_regione"), F.when(F.col("conv_id") % 2 == 0, "italian").otherwise("italian,neapolitan").alias("languages"))


def _half(text: Column) -> Column:
    parts = F.split(text, r"\s+")
    return F.array_join(F.slice(parts, F.lit(1), F.ceil(F.size(parts) / 2).cast("int")), " ")


def draft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draft translations; by m = (conv_id + turn) mod 6: 1 empty, 5 absent, else the source text."""
    m = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6))
    return turns(spark, sf_dir).where(m != 5).withColumn("napoletano", F.when(m == 1, "").otherwise(F.col("italiano"))).withColumn("note", F.lit(""))


def golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden translations; by m: 2 lower case with "the" as "da", 3 the first half of the words, 4 absent, else the
    source text. Each turn with m = 2 has an older row too, which the last one overrides; where conv_id mod 9 = 0 the
    source text of turn 0 differs."""
    m = F.pmod(F.col("conv_id") + F.col("turn"), F.lit(6))
    rows = turns(spark, sf_dir).where(m != 4)
    rows = rows.withColumn("napoletano", F.when(m == 2, F.lower(F.replace("italiano", F.lit("the"), F.lit("da")))).when(m == 3, _half(F.col("italiano"))).otherwise(F.col("italiano")))
    rows = rows.withColumn("note", F.when(m == 3, "half").otherwise("")).withColumn("italiano", F.when((F.col("conv_id") % 9 == 0) & (F.col("turn") == 0), F.concat("italiano", F.lit("!"))).otherwise(F.col("italiano")))
    older = rows.where(m == 2).withColumn("napoletano", F.lit("older")).withColumn("ord", F.col("ord") - F.lit(1_000_000_000_000))
    return rows.unionByName(older)


def structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All turns with metadata, as the structure a merge follows; turn_ord is the place in the conversation."""
    from turnengine.operators.build import add_metadata

    rows = turns(spark, sf_dir).withColumn("turn_ord", F.col("turn"))
    return add_metadata(rows, metadata(spark, sf_dir)).withColumn("napoletano", F.lit("")).withColumn("note", F.lit(""))


def corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corrections of the turns with conv_id mod 4 = 0 and turn < 3, and of one key that is absent per conversation:
    turn 0: "the" and "an"; turn 1: "the" and a text that is nowhere; turn 2: a text whose new form is there."""
    t = turns(spark, sf_dir).where("conv_id % 4 = 0")
    rows = t.where("turn < 3").select("conversazione", "turn_index", "turn")
    first = rows.select("conversazione", "turn_index", F.lit(1).alias("ord"), F.when(F.col("turn") == 2, "qqq").otherwise("the").alias("old"), F.when(F.col("turn") == 2, "e").otherwise("'o").alias("new"))
    second = rows.where("turn < 2").select("conversazione", "turn_index", F.lit(2).alias("ord"), F.when(F.col("turn") == 0, "an").otherwise("zzzz").alias("old"), F.when(F.col("turn") == 0, "nu").otherwise("yyyy").alias("new"))
    lost = t.select("conversazione").distinct().select("conversazione", F.lit(9999).alias("turn_index"), F.lit(1).alias("ord"), F.lit("a").alias("old"), F.lit("b").alias("new"))
    return first.unionByName(second).unionByName(lost)


def workbook_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Workbook rows, all text, with flaws by k = 7 conv_id + turn: 19 divides k: no conversation; 23: turn_index is
    not a number; 29: turn_index as of the turn before; 31: no translation. pos is the order."""
    k = F.col("conv_id") * 7 + F.col("turn")
    index = F.when(k % 23 == 0, "a").when((k % 29 == 0) & (F.col("turn") > 0), F.col("turn").cast("string")).otherwise(F.col("turn_index").cast("string"))
    return structure(spark, sf_dir).select(
        F.when(k % 19 == 0, "").otherwise(F.col("conversazione")).alias("conversazione"), "regione", "macro_regione", "languages", index.alias("turn_index"), "tu_id", "speaker", "italiano",
        F.when(k % 31 == 0, "").otherwise(F.col("italiano")).alias("napoletano"), F.when(k % 3 == 0, "checked").otherwise("").alias("note"), F.col("ord").alias("pos"),
    )


def edited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The structure after edits: turns with k mod 13 = 0 lose their first letter, k mod 17 = 0 change speaker, and
    conversations with conv_id mod 8 = 0 lose turn 1."""
    k = F.col("conv_id") * 7 + F.col("turn")
    rows = structure(spark, sf_dir).where("not (conv_id % 8 = 0 and turn = 1)")
    return rows.withColumn("italiano", F.when(k % 13 == 0, F.expr("substring(italiano, 2)")).otherwise(F.col("italiano"))).withColumn("speaker", F.when(k % 17 == 0, "other").otherwise(F.col("speaker")))


def renamed(rows: DataFrame, rest: int, by: int, mark: str) -> DataFrame:
    """rows with a mark before the names of the conversations with conv_id mod by = rest."""
    return rows.withColumn("conversazione", F.concat(F.when(F.col("conv_id") % by == rest, mark).otherwise(""), "conversazione"))
