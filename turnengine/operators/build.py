"""From token rows to turns, and between flat and nested turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnengine.functions.ordinal import with_ordinal
from turnengine.functions.sequence import hot_groups, number_within
from turnengine.functions.text import digits_or_zero, null_to_empty, strip_ws

#: Token types that exclude their unit, and the one that makes text (fixed values).
BAD_TYPES = ["error", "unknown", "anonymized"]
LINGUISTIC = "linguistic"
DEFAULT_CONVERSATIONS = ["KPN001", "KPN003"]


def unit_text(tokens: Column) -> Column:
    """Text of ordered linguistic tokens (structs with form, glued): a space after each but the last, unless glued."""
    last = F.size(tokens)
    return strip_ws(F.array_join(F.transform(tokens, lambda t, i: F.concat(t["form"], F.when(t["glued"] | (i + 1 == last), F.lit("")).otherwise(F.lit(" ")))), ""))


def units(tokens: DataFrame) -> DataFrame:
    """One row per transcription unit: first_pos, speaker of its first token of any type, text, n, dialect, bad.

    Only the tokens that make text are gathered, in one hash aggregation with map-side partials; a unit is a
    speaker's utterance, so the array is as short as one.
    """
    spoken = F.col("type") == LINGUISTIC
    piece = F.struct("pos", null_to_empty(F.col("form")).alias("form"), null_to_empty(F.col("feats")).contains("SpaceAfter=No").alias("glued"))
    return (
        tokens.groupBy("conversazione", F.col("tu").alias("tu_id"))
        .agg(
            F.min("pos").alias("first_pos"),
            F.min_by("speaker", "pos").alias("speaker"),
            F.array_sort(F.collect_list(F.when(spoken, piece))).alias("toks"),
            F.coalesce(F.bool_or(F.col("variation") == "some"), F.lit(False)).alias("dialect"),
            F.coalesce(F.bool_or(F.col("type").isin(BAD_TYPES)), F.lit(False)).alias("bad"),
        )
        .select("conversazione", "tu_id", "first_pos", "speaker", unit_text(F.col("toks")).alias("text"), F.size("toks").alias("n"), "dialect", "bad")
    )


def kept_units(tokens: DataFrame) -> DataFrame:
    """Units without dialect or bad tokens that hold a linguistic token."""
    return units(tokens).where(~F.col("dialect") & ~F.col("bad") & (F.col("n") > 0))


def add_metadata(rows: DataFrame, meta: DataFrame) -> DataFrame:
    """Left join of conversation metadata (code, regione, macro_regione, languages); unknown codes get empty strings."""
    joined = rows.join(meta.withColumnRenamed("code", "conversazione"), "conversazione", "left")
    return joined.select(*rows.columns, *[null_to_empty(F.col(c)).alias(c) for c in ("regione", "macro_regione", "languages")])


def build_turns(tokens: DataFrame, meta: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Flat turns of token rows, renumbered from 1 over the kept units.

    conversations (code, conv_ord): the requested ones; the turns then carry conv_ord, the first place asked for. None
    takes all. The metadata is joined without a hint: it is broadcast while its size is known to be small.
    """
    asked = None if conversations is None else conversations.groupBy(F.col("code").alias("conversazione")).agg(F.min("conv_ord").alias("conv_ord"))
    if asked is not None:
        tokens = tokens.join(asked, "conversazione", "left_semi")
    # a conversation has no more units than tokens, which are cheaper to count
    kept = kept_units(tokens).withColumn("_order", digits_or_zero(F.col("tu_id")))
    turns = number_within(kept, "conversazione", ["_order", "first_pos"], "turn_index", hot_groups(tokens, "conversazione"))
    turns = add_metadata(turns, meta).select(
        "conversazione", "regione", "macro_regione", "languages", "turn_index", "tu_id", "speaker", F.col("text").alias("italiano"), F.lit("").alias("napoletano"), F.lit("").alias("note"),
    )
    return turns if asked is None else turns.join(asked, "conversazione")


def file_order(turns: DataFrame) -> list[str]:
    """The columns that give the order of a file: of its source where the turns know it, else of names and numbers."""
    return ["conv_ord" if "conv_ord" in turns.columns else "conversazione", "turn_ord" if "turn_ord" in turns.columns else "turn_index"]


def select_conversations(known: DataFrame, everything: bool = False, conversations: list[str] | None = None, conversation: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(requested, unknown): requested conversations (code, conv_ord) by precedence all, list, one, default; and those
    not in known (code)."""
    spark = known.sparkSession
    if everything:
        return with_ordinal(known.select("code").distinct(), ["code"], "conv_ord").withColumn("conv_ord", F.col("conv_ord").cast("int")), known.select("code").limit(0)
    codes = conversations or ([conversation] if conversation else DEFAULT_CONVERSATIONS)
    asked = spark.createDataFrame([(c, i) for i, c in enumerate(codes, 1)], "code string, conv_ord int")
    return asked.join(known.select("code").distinct(), "code", "left_semi"), asked.select("code").join(known, "code", "left_anti").distinct()


def nest(turns: DataFrame) -> DataFrame:
    """Flat turns as one row per conversation with its turns in order; conv_ord is kept where the turns have it."""
    by = file_order(turns)[1]
    own = [F.min("conv_ord").alias("conv_ord")] if "conv_ord" in turns.columns else []
    fields = [c for c in ("turn_index", "tu_id", "speaker", "italiano", "napoletano", "note", "fonte") if c in turns.columns]
    return (
        turns.groupBy(F.col("conversazione").alias("id"))
        .agg(
            *[F.min_by(c, by).alias(c) for c in ("regione", "macro_regione", "languages")],
            F.count("*").cast("int").alias("n_turni_italiani"),
            F.transform(F.array_sort(F.collect_list(F.struct(F.col(by).alias("by"), F.struct(*fields).alias("turn")))), lambda t: t["turn"]).alias("turni"),
            *own,
        )
    )


def flatten(samples: DataFrame) -> DataFrame:
    """Nested conversations as flat turns, with empty strings for what is missing, plus turn_ord (place in the list)."""
    turn = samples.select(*[null_to_empty(F.col(c)).alias(n) for c, n in (("id", "conversazione"), ("regione", "regione"), ("macro_regione", "macro_regione"), ("languages", "languages"))], F.posexplode("turni").alias("turn_ord", "t"))
    has = [f.name for f in samples.schema["turni"].dataType.elementType.fields]
    texts = [null_to_empty(F.col(f"t.{c}")).alias(c) if c in has else F.lit("").alias(c) for c in ("tu_id", "speaker", "italiano", "napoletano", "note")]
    extra = [null_to_empty(F.col("t.fonte")).alias("fonte")] if "fonte" in has else []
    return turn.select("conversazione", "regione", "macro_regione", "languages", F.col("t.turn_index").alias("turn_index"), *texts, *extra, "turn_ord")


def todo_turns(turns: DataFrame) -> DataFrame:
    """Turns without a translation."""
    return turns.where(null_to_empty(F.col("napoletano")) == "")


def dataset_summary(turns: DataFrame) -> DataFrame:
    """One row: conversations, turns, turns_per_conversation, italian_only conversations."""
    per = turns.groupBy("conversazione").agg(F.count("*").alias("n"), F.max("languages").alias("languages"))
    return per.agg(
        F.count("*").alias("conversations"), F.coalesce(F.sum("n"), F.lit(0)).alias("turns"),
        F.try_divide(F.sum("n"), F.count("*")).alias("turns_per_conversation"), F.count_if(F.col("languages") == "italian").alias("italian_only"),
    )


def conversation_counts(turns: DataFrame) -> DataFrame:
    """Turns, and turns with a note, of every conversation."""
    return turns.groupBy("conversazione").agg(F.count("*").alias("turns"), F.count_if(null_to_empty(F.col("note")) != "").alias("notes"))
