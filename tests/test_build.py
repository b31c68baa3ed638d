"""Micro-fixtures of the corpus build."""

from turnengine.operators import build
TOKEN = "conversazione string, pos long, speaker string, tu string, form string, type string, variation string, feats string"

ROWS = [
    ("A", "10", "ciao", "linguistic", "none", "_"),
    ("B", "2", "l'", "linguistic", "none", "SpaceAfter=No"),
    ("B", "2", "amico", "linguistic", "none", "_"),
    ("A", "3", "jamm", "linguistic", "some", "_"),
    ("A", "4", "x", "error", "none", "_"),
    ("B", "5", "(.)", "shortpause", "none", "_"),
    ("C", "x1", "eh", "linguistic", "none", "_"),
    ("D", "6", "(.)", "shortpause", "none", "SpaceAfter=No"),
    ("E", "6", "si", "linguistic", "none", "SpaceAfter=No"),
]


def tokens(spark, rows=ROWS):
    return spark.createDataFrame([("K1", i, *r) for i, r in enumerate(rows)], TOKEN)


def meta(spark, rows=()):
    return spark.createDataFrame(list(rows), "code string, regione string, macro_regione string, languages string")


def test_turns(spark):
    got = [(r.turn_index, r.tu_id, r.speaker, r.italiano, r.regione) for r in build.build_turns(tokens(spark), meta(spark)).orderBy("turn_index").collect()]
    assert got == [(1, "x1", "C", "eh", ""), (2, "2", "B", "l'amico", ""), (3, "6", "D", "si", ""), (4, "10", "A", "ciao", "")]


def test_empty_form_still_counts(spark):
    got = build.kept_units(tokens(spark, [("A", "1", "", "linguistic", "none", "_")])).collect()
    assert [(r.text, r.n) for r in got] == [("", 1)]


def test_metadata_and_selection(spark):
    known = meta(spark, [("K1", "Campania", "Sud", "italian"), ("K2", "x", "y", "z")])
    turns = build.build_turns(tokens(spark), known)
    assert turns.first().regione == "Campania"
    asked, unknown = build.select_conversations(known, conversations=["K2", "K1", "K1", "nope"])
    assert sorted((r.conv_ord, r.code) for r in asked.collect()) == [(1, "K2"), (2, "K1"), (3, "K1")]
    assert [r.code for r in unknown.collect()] == ["nope"]
    assert build.build_turns(tokens(spark), known, conversations=asked.where("code = 'K2'")).count() == 0
    assert [r.code for r in build.select_conversations(known, everything=True)[0].orderBy("conv_ord").collect()] == ["K1", "K2"]
    assert build.select_conversations(known)[1].count() == 2  # the default ones are not there


def test_nest_flatten(spark):
    turns = build.build_turns(tokens(spark), meta(spark))
    back = build.flatten(build.nest(turns)).drop("turn_ord")
    assert sorted(map(tuple, back.select(turns.columns).collect())) == sorted(map(tuple, turns.collect()))


def test_summary_of_nothing(spark):
    row = build.dataset_summary(build.build_turns(tokens(spark, []), meta(spark))).first()
    assert (row.conversations, row.turns, row.turns_per_conversation) == (0, 0, None)
