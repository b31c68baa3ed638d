"""Scores: identities, hand-made values and a plain implementation."""

import random
from collections import Counter

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from turnengine.functions.text import strip_ws, to_bool, words
from turnengine.operators import metrics
from pyspark.sql import functions as F


def plain_lcs(a, b):
    rows = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            rows[i + 1][j + 1] = rows[i][j] + 1 if x == y else max(rows[i][j + 1], rows[i + 1][j])
    return rows[-1][-1]


@settings(max_examples=200)
@given(st.lists(st.sampled_from("abcd")), st.lists(st.sampled_from("abcd")))
def test_lcs(a, b):
    assert metrics.lcs(a, b) == plain_lcs(a, b) == metrics.lcs(b, a)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abc"), max_size=9), st.lists(st.sampled_from("abcd"), max_size=9)), min_size=1, max_size=6))
def test_word_counts_of_a_batch(pairs):
    lists = [pa.array(x, pa.list_(pa.string())) for x in zip(*pairs, strict=True)]
    counted = metrics._overlaps(*metrics._words(*lists), 4)
    for (a, b), found in zip(pairs, counted.tolist(), strict=True):
        x, y = ([Counter(tuple(s[i : i + n]) for i in range(len(s) - n + 1)) for n in range(1, 5)] for s in (a, b))
        assert found == [c.total() for c in x] + [c.total() for c in y] + [(c & d).total() for c, d in zip(x, y, strict=True)]


def scores(spark, rows, **how):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, gemma string, golden string")
    return metrics.decisions(df, **how).orderBy("i").collect()


def test_scores(spark):
    same, empty, marks, apart = scores(spark, [("il gatto è qui oggi", "il gatto è qui oggi"), ("", "ciao"), ("?!", "?!"), ("aaa bbb", "ccc ddd")])
    assert abs(same.chrf - 100) < 1e-9 and abs(same.bleu - 100) < 1e-9 and same.rouge == 100 and not same.sostituire
    assert (empty.chrf, empty.bleu, empty.rouge, empty.similarita, empty.sostituire) == (0, 0, 0, 0, True)
    assert marks.rouge == 0 and abs(marks.chrf - 100) < 1e-9
    assert (apart.chrf, apart.bleu, apart.rouge) == (0, 0, 0)


def test_corpus_of_one_is_the_sentence(spark):
    df = spark.createDataFrame([("the cat sat", "the cat sits")], "gemma string, golden string")
    assert abs(metrics.corpus_scores(df).first().corpus_chrf - metrics.sentence_scores(df).first().chrf) < 1e-9
    assert metrics.corpus_scores(df.limit(0)).first().corpus_chrf == 0


def test_long_random_pairs(spark):
    rng = random.Random(1)
    text = lambda: " ".join("".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 40)))
    for r in scores(spark, [(text(), text()) for _ in range(20)], word_order=2):
        assert 0 <= r.chrf <= 100 and 0 <= r.bleu <= 100 and 0 <= r.similarita <= 100


def test_text_functions(spark):
    row = spark.createDataFrame([("　\x1c a b \n", "L'atu vuo' cca'  ha_ccà l’ombra 3.5 ROSTÌ", " TRUE\t")], "s string, w string, b string").select(strip_ws(F.col("s")).alias("s"), words(F.col("w")).alias("w"), to_bool(F.col("b")).alias("b")).first()
    assert row.s == "a b" and row.b
    assert row.w == ["l'atu", "vuo", "cca", "ha", "ccà", "l’ombra", "3", "5", "rostì"]


def test_greedy_kernel(spark):
    rows = [(1, "hyp", 0, [1.0, 0.0]), (1, "ref", 0, [2.0, 0.0]), (1, "ref", 1, [0.0, 1.0])]
    r = metrics.greedy_match(spark.createDataFrame(rows, "pair_id int, side string, pos int, embedding array<double>")).first()
    assert (r.precision, r.recall) == (100, 50) and abs(r.f1 - 200 / 3) < 1e-9


def test_memory_of_counts_follows_neither_batch_nor_table():
    import tracemalloc

    def peak(n):
        texts = pa.array([f"{i} some words of a turn, again and again " * 20 for i in range(n)])
        words_ = pa.array([t.split() for t in texts.to_pylist()])
        tracemalloc.start()
        rows = metrics.char_counts.func(texts, texts), metrics.word_counts_4.func(words_, words_), metrics.lcs_counts.func(words_, words_)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most, [r.to_pylist() for r in rows]

    (few, a), (many, b) = peak(1_500), peak(6_000)
    assert many < 1.7 * few and [r[:1_500] for r in b] == a
