"""Alignment, merging, corrections, quality and translation on micro-fixtures."""

import pytest
from pyspark.sql import functions as F

from turnengine.operators import align, merge, patch, quality, translate
from turnengine.schema import CORRECTION, EngineError

FLAT = "conversazione string, turn_index int, tu_id string, speaker string, italiano string, napoletano string, note string, ord long"


def flat(spark, rows):
    return spark.createDataFrame([(c, t, str(t), "A", i, n, note, k) for k, (c, t, i, n, note) in enumerate(rows)], FLAT)


def test_align(spark):
    draft = flat(spark, [("a", 1, "x", " ciao ", ""), ("a", 1, "x", "two", ""), ("a", 2, "y", None, ""), ("b", 1, "z", "only draft", "")])
    golden = flat(spark, [("a", 1, "x", "old", "n1"), ("a", 1, "X", "ciao", "n2"), ("a", 2, "y", "g", None), ("c", 1, "z", "only golden", "")])
    pairs = align.align_pairs(draft, golden)
    assert [(r.turn_index, r.gemma, r.golden, r.note) for r in pairs.orderBy("ord").collect()] == [(1, "ciao", "ciao", "n2"), (1, "two", "ciao", "n2"), (2, "", "g", "")]
    assert align.source_mismatch(pairs).count() == 2
    only_draft, only_golden = align.misaligned(draft, golden)
    assert [tuple(r) for r in only_draft.collect()] == [("b", 1)] and [tuple(r) for r in only_golden.collect()] == [("c", 1)]
    assert [r.gemma for r in align.first_pairs(pairs, 1).collect()] == ["ciao"]


def test_align_all_is_one_pass(spark, tmp_path):
    """Pairs, both anti-joins and differing texts from one table, written with one exchange a side."""
    from turnengine.storage import measured

    draft = flat(spark, [("a", 1, "x", " ciao ", ""), ("a", 1, "x", "two", ""), ("a", 2, "y", None, ""), ("b", 1, "z", "only", ""), ("b", 1, "z", "again", "")])
    golden = flat(spark, [("a", 1, "x", "old", "n1"), ("a", 1, "X", "ciao", "n2"), ("a", 2, "y", "g", None), ("c", 1, "z", "only golden", ""), ("c", 1, "z", "again", "")])
    draft.write.parquet(str(tmp_path / "draft"))
    golden.write.parquet(str(tmp_path / "golden"))
    draft, golden = (spark.read.parquet(str(tmp_path / n)) for n in ("draft", "golden"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = align.align_all(draft, golden)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 2 and plan.count("FullOuter") == 1
        aligned, seen = measured(align.align_all(draft, golden), "aligned", **align.alignment_counts())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert seen == {"pairs": 3, "draft_only": 1, "golden_only": 1, "source_differs": 2}
    pairs = align.pairs_of(aligned)
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(pairs) == key(align.align_pairs(draft, golden)) and pairs.columns == align.align_pairs(draft, golden).columns
    assert [key(x) for x in align.misaligned_of(aligned)] == [[("b", 1)], [("c", 1)]]
    assert key(align.source_mismatch(pairs).select("ord")) == [(0,), (1,)]
    only = spark.createDataFrame([("b",)], "code string")
    assert align.pairs_of(aligned, only).isEmpty() and align.align_pairs(draft, golden, only).isEmpty()


def _structure(spark):
    return flat(spark, [("a", 1, "x", "", ""), ("a", 2, "y", "", ""), ("b", 1, "z", "", "")]).withColumns({c: F.lit(c) for c in ("regione", "macro_regione", "languages")}).drop("ord")


def test_merge(spark):
    decisions = spark.createDataFrame([("a", 1, "x", "g1", "G1", 85.0, True, 1), ("a", 2, "q", "g2", "G2", 90.0, True, 2), ("a", 2, "q", "g2", "G2", 90.0, False, 3)], "conversazione string, turn_index int, italiano string, gemma string, golden string, similarita double, sostituire boolean, ord long")
    got = lambda **k: [(r.turn_index, r.napoletano, r.fonte) for r in merge.merge(_structure(spark), decisions, **k).orderBy("turn_index").collect()]
    assert got() == [(1, "G1", "golden"), (2, "g2", "gemma4")]
    assert got(threshold=85.0) == [(1, "g1", "gemma4"), (2, "g2", "gemma4")]  # the stored similarity is rounded
    assert got(golden_only=True) == [(1, "G1", "golden"), (2, "G2", "golden")]
    final = merge.merge(_structure(spark), decisions)
    assert [tuple(r)[:2] for r in merge.undecided(_structure(spark), decisions).collect()] == [("b", 1)]
    assert sorted(tuple(r) for r in merge.all_conversations(_structure(spark), final).collect()) == [("a", 2), ("b", 0)]
    assert [r.turn_index for r in merge.merged_mismatch(final).collect()] == [2]
    assert merge.source_counts(final).first().golden_pct == 50.0
    assert merge.source_counts(final.limit(0)).first().golden_pct is None
    assert [r.turn_index for r in merge.riskiest(final).collect()] == [2]


@pytest.mark.parametrize(
    ("text", "pairs", "status", "after"),
    [
        ("a why b why", [("why", "pecché")], "modified", "a pecché b pecché"),
        ("a pecché", [("why", "pecché")], "already-correct", "a pecché"),
        ("a", [("why", "pecché")], "not-found", "a"),
        ("x old1", [("old1", "n1"), ("old2", "n2")], "not-found", "x old1"),
        ("n1 old2", [("old1", "n1"), ("old2", "n2")], "modified", "n1 n2"),
    ],
)
def test_corrections(spark, text, pairs, status, after):
    turns = flat(spark, [("a", 1, "x", text, "")])
    table = spark.createDataFrame([("a", 1, i, o, n) for i, (o, n) in enumerate(pairs)] + [("z", 9, 0, "p", "q")], CORRECTION)
    got = {r.conversazione: (r.status, r.text) for r in patch.correction_status(turns, table).collect()}
    assert got == {"a": (status, after), "z": ("absent", "")}
    again = patch.corrected(patch.corrected(turns, table).drop("fix_status"), table).first()
    assert again.napoletano == after


def _rows(spark, rows):
    return spark.createDataFrame([(c, "r", "m", "l", t, str(i), "A", "x", n, "", i) for i, (c, t, n) in enumerate(rows)], "conversazione string, regione string, macro_regione string, languages string, turn_index string, tu_id string, speaker string, italiano string, napoletano string, note string, pos long")


def test_structural(spark):
    rows = _rows(spark, [("a", "1", "n"), ("", "1", "n"), ("a", "x", "n"), ("a", "1", "dup"), ("a", "2", ""), ("b", "1", "n"), ("b", "3", "n")])
    got = sorted((r.check, r.conversazione, r.data_row) for r in quality.structural(rows).collect())
    assert got == [("bad_turn_index", "a", 4), ("duplicate_turn_index", "a", 5), ("empty_conversation", "", 3), ("empty_napoletano", "a", 6), ("not_contiguous", "b", 0)]
    with pytest.raises(EngineError):
        quality.import_rows(rows, None)
    fine = _rows(spark, [("a", "1", "n"), ("a", "2", "n")])
    assert quality.import_rows(fine, None).count() == 2
    edited = quality.rows_to_turns(fine).withColumn("speaker", F.lit("B")).withColumn("ord", F.col("turn_index"))
    assert [r.check for r in quality.drift(quality.rows_to_turns(fine), edited).collect()] == ["changed_speaker"] * 2
    with pytest.raises(EngineError):
        quality.import_rows(fine, edited)
    assert quality.import_rows(fine, edited, allow_source_edits=True).count() == 2


def test_translate_sees_what_it_made(spark):
    turns = flat(spark, [("a", i, f"t{i}", "done" if i == 2 else "", "") for i in (1, 2, 3)]).withColumn("turn_ord", F.col("turn_index"))
    seen = translate.translate(turns, lambda m: "<" + m[1]["content"].replace("\n", "/") + ">").orderBy("turn_ord").collect()
    first = "<Translate:/t1>"
    assert [r.napoletano for r in seen] == [first, "done", f"<Context:/- t1  ->  {first}/- t2  ->  done//Translate:/t3>"]
    assert [r.fresh for r in seen] == [True, False, True]

    def broken(messages):
        raise OSError

    assert [r.failed for r in translate.translate(turns, broken).orderBy("turn_ord").collect()] == [True, False, True]
    assert translate.translate(turns, lambda m: "x", limit=1).where("fresh").count() == 1
    assert translate.resume(turns, translate.translate(turns, lambda m: "x", limit=1)).where("napoletano = ''").count() == 1


def test_retries():
    waits, calls = [], []

    def flaky(messages):
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return " ok "

    assert translate.with_retries(flaky, sleep=waits.append)([]) == "ok" and waits == [2.0, 4.0]
    with pytest.raises(RuntimeError):
        translate.with_retries(lambda m: 1 / 0, sleep=waits.append)([])
    assert waits[2:] == [2.0, 4.0, 8.0]


def test_context_of_none(spark):
    turns = flat(spark, [("a", 1, "x", "", "")]).withColumn("turn_ord", F.lit(0))
    assert translate.context_window(turns, 0).first().context == []
