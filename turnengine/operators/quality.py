"""Structural checks, drift and verification; every violation is a row, and reports cap what they show."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnengine.functions.ordinal import with_ordinal
from turnengine.functions.sequence import hot_groups, number_within
from turnengine.functions.text import null_to_empty
from turnengine.schema import EngineError

FIELDS = ["turn_index", "tu_id", "speaker", "italiano", "napoletano"]


def classify(rows: DataFrame) -> DataFrame:
    """Rows of a workbook (all text, pos) with data_row (from 2, blank rows not counted) and problem.

    problem: empty_conversation, bad_turn_index, duplicate_turn_index (all but the first), or null for valid rows.
    """
    index = F.when(F.col("turn_index").rlike(r"^\p{Nd}+$"), F.col("turn_index").try_cast("int"))
    numbered = with_ordinal(rows, ["pos"], "data_row").withColumn("data_row", (F.col("data_row") + 1).cast("int")).withColumn("turn_no", index)
    problem = F.when(null_to_empty(F.col("conversazione")) == "", "empty_conversation").when(F.col("turn_no").isNull(), "bad_turn_index")
    marked = numbered.withColumn("problem", problem)
    nth = F.row_number().over(Window.partitionBy("conversazione", "turn_no", F.col("problem").isNull()).orderBy("pos"))
    return marked.withColumn("problem", F.when(F.col("problem").isNull() & (nth > 1), "duplicate_turn_index").otherwise(F.col("problem")))


def structural(rows: DataFrame) -> DataFrame:
    """Violations (check, conversazione, turn, data_row) of workbook rows."""
    marked = classify(rows)
    bad = marked.where("problem is not null").select(F.col("problem").alias("check"), "conversazione", F.col("turn_index").alias("turn"), "data_row")
    valid = marked.where("problem is null")
    blank = valid.where(null_to_empty(F.col("napoletano")) == "").select(F.lit("empty_napoletano").alias("check"), "conversazione", F.col("turn_index").alias("turn"), "data_row")
    gaps = valid.groupBy("conversazione").agg(F.min("turn_no").alias("a"), F.max("turn_no").alias("b"), F.count("*").alias("n")).where("a <> 1 or b <> n")
    gaps = gaps.select(F.lit("not_contiguous").alias("check"), "conversazione", F.lit("").alias("turn"), F.lit(0).alias("data_row"))
    return bad.unionByName(blank).unionByName(gaps)


def rows_to_turns(rows: DataFrame) -> DataFrame:
    """Valid rows as flat turns; a conversation's metadata come from its first valid-index row."""
    marked = classify(rows)
    meta = ["regione", "macro_regione", "languages"]
    numeric = marked.where(F.col("problem").isNull() | (F.col("problem") == "duplicate_turn_index"))
    heads = numeric.groupBy("conversazione").agg(F.min_by(F.struct(*[null_to_empty(F.col(c)).alias(c) for c in meta]), "pos").alias("head")).select("conversazione", "head.*")
    return numeric.where("problem is null").drop(*meta).join(heads, "conversazione").select("conversazione", "regione", "macro_regione", "languages", F.col("turn_no").alias("turn_index"), "tu_id", "speaker", "italiano", "napoletano", null_to_empty(F.col("note")).alias("note"))


def drift(turns: DataFrame, source: DataFrame) -> DataFrame:
    """Differences (check, conversazione, turn_index) of turns from their source; unknown conversations are skipped.

    source has ord, by which the last row of a key wins.
    """
    known = source.select("conversazione").distinct()
    mine = turns.join(known, "conversazione", "left_semi")
    counts = mine.groupBy("conversazione").agg(F.count("*").alias("n")).join(source.groupBy("conversazione").agg(F.count("*").alias("m")), "conversazione").where("n <> m")
    fields = ["italiano", "speaker", "tu_id"]
    other = source.groupBy("conversazione", "turn_index").agg(*[F.max_by(c, "ord").alias(f"s_{c}") for c in fields], F.lit(1).alias("there"))
    joined = mine.join(other, ["conversazione", "turn_index"], "left")
    changed = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"s_{c}")), F.lit(f"changed_{c}")) for c in fields]))
    checks = F.when(F.col("there").isNull(), F.array(F.lit("missing_in_source"))).otherwise(changed)
    return counts.select(F.lit("turn_count").alias("check"), "conversazione", F.lit(None).cast("int").alias("turn_index")).unionByName(joined.select(F.explode(checks).alias("check"), "conversazione", "turn_index"))


def _ith(turns: DataFrame, side: str) -> DataFrame:
    told = number_within(turns, "conversazione", ["turn_ord"], "i", hot_groups(turns, "conversazione"))
    return told.select("conversazione", "i", *[F.col(c).cast("string").alias(f"{side}_{c}") for c in FIELDS])


def verify(a: DataFrame, b: DataFrame) -> DataFrame:
    """Differences (check, conversazione, i, left, right): metadata, turn counts, and the i-th turns field by field.

    Where the sets of conversations differ, only that is reported.
    """
    ids = a.select("conversazione").distinct(), b.select("conversazione").distinct()
    lost = ids[0].subtract(ids[1]).select(F.lit("only_left").alias("check"), "conversazione").union(ids[1].subtract(ids[0]).select(F.lit("only_right").alias("check"), "conversazione"))
    none = F.lit(None)
    lost = lost.select("check", "conversazione", none.cast("int").alias("i"), none.cast("string").alias("left"), none.cast("string").alias("right"))
    meta = ["regione", "macro_regione", "languages"]
    per = [x.groupBy("conversazione").agg(*[F.min_by(c, "turn_ord").alias(f"{s}_{c}") for c in meta], F.count("*").cast("string").alias(f"{s}_turns")) for x, s in ((a, "l"), (b, "r"))]
    heads = _differing(per[0].join(per[1], "conversazione").withColumn("i", none.cast("int")), [*meta, "turns"])
    fields = _differing(_ith(a, "l").join(_ith(b, "r"), ["conversazione", "i"]), FIELDS)
    any_lost = lost.agg(F.count("*").alias("n_lost"))  # one row
    deeper = heads.unionByName(fields).join(any_lost, F.col("n_lost") == 0).drop("n_lost")
    return lost.unionByName(deeper)


def _differing(joined: DataFrame, fields: list[str]) -> DataFrame:
    cells: list[Column] = [F.when(~F.col(f"l_{c}").eqNullSafe(F.col(f"r_{c}")), F.struct(F.lit(c).alias("check"), F.col(f"l_{c}").alias("left"), F.col(f"r_{c}").alias("right"))) for c in fields]
    return joined.select("conversazione", "i", F.explode(F.array_compact(F.array(*cells))).alias("d")).select("d.check", "conversazione", "i", "d.left", "d.right")


def gate(violations: DataFrame, what: str, shown: int = 25) -> None:
    """Raise with the first violations if there are any."""
    found = violations.limit(shown + 1).collect()
    if found:
        more = " and more" if len(found) > shown else ""
        raise EngineError(f"{what}: " + "; ".join(str(tuple(r)) for r in found[:shown]) + more)


def import_rows(rows: DataFrame, source: DataFrame | None, allow_source_edits: bool = False) -> DataFrame:
    """Turns of workbook rows; raises on structural problems, and on drift from source unless edits are allowed."""
    gate(structural(rows), "structural problems")
    turns = rows_to_turns(rows)
    if source is not None and not allow_source_edits:
        gate(drift(turns, source), "the source texts were edited")
    return turns
