"""Weak supervision: held-out accuracy, isolation from held-out labels, odd cases."""

from pathlib import Path
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F


from turnengine.llm import toxicity as T

DATA = Path("/root/testdata")


def split(rows):
    return [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2]


def corpus(n=1500, seed=0):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("aeioulmnrst") for _ in range(rng.randint(2, 6))) for _ in range(rng.randint(5, 80))]
        toxic = rng.random() < 0.12
        for _ in range(rng.randint(2, 5) * toxic):
            words.insert(rng.randrange(len(words)), rng.choice(["vilewort", "nastix", "grobian", "schuft", "canaille"]))
        docs.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    return docs, labels


LABEL = "doc_id long, quality int, toxic int"


def test_held_out_accuracy(spark, make_docs):
    rows, labels = corpus()
    docs = make_docs(rows, extra=True)
    truth = {d: t for d, _, t in labels}
    flipped = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 4 == 2 else t) for d, q, t in labels]
    results = []
    for given in (labels, flipped):
        model = T.fit_toxicity(docs, spark.createDataFrame(given, LABEL))
        results.append({r.doc_id: r for r in T.score_toxicity(docs, model).collect()})
    assert {d: r.score for d, r in results[0].items()} == {d: r.score for d, r in results[1].items()}  # held-out labels change nothing
    held = [d for d, r in results[0].items() if r.held_out]
    assert set(held) == {d for d, _ in split(rows)}
    assert np.mean([results[0][d].predicted == truth[d] for d in held]) > 0.97
    kept = T.drop_toxic(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {d for d, r in results[1].items() if not r.predicted}


def test_odd_rows(spark, make_docs, odd_rows):
    rows, labels = corpus(400)
    docs = make_docs([*odd_rows, *((d + 1000, t) for d, t in rows)], extra=True)
    given = [(d + 1000, q, t) for d, q, t in labels] + [(1, 1, None), (None, 1, 1), (999_999, 1, 1), (6, 1, 0), (6, 1, 0)]
    out = T.score_toxicity(docs, T.fit_toxicity(docs, spark.createDataFrame(given, LABEL)))
    assert out.count() == docs.count() and out.where("score is null or score < 0 or score > 1 or predicted <> int(score >= 0.3)").count() == 0
    assert out.where("doc_id in (1, 2, 3) and predicted = 1").count() == 0
    empty = T.fit_toxicity(docs, spark.createDataFrame([], LABEL))
    assert T.score_toxicity(docs, empty).where("predicted = 1").count() == 0
    assert T.score_toxicity(docs.limit(0), empty).count() == 0 == T.drop_toxic(docs.limit(0), empty).count()


def test_copies_make_no_lexicon(spark, make_docs):
    rows, labels = corpus(600)
    copied = [(5000 + i, "uniquely strange sentence copied many times over") for i in range(40)]
    docs = make_docs(rows + copied)
    model = T.fit_toxicity(docs, spark.createDataFrame(labels + [(d, 1, 1) for d, _ in copied], LABEL))
    assert "nastix" in model.lexicon and "strange" not in model.lexicon


def test_lexicon_has_no_cap_and_the_fit_is_bounded_by_rows(spark, make_docs, monkeypatch):
    rng = np.random.default_rng(2)
    filler = [f"plain{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(1200):
        toxic = i % 3 == 0
        words = list(rng.choice(filler, 20))
        for k in range(12 if toxic else 0):
            words.insert(int(rng.integers(0, len(words))), f"bad{(i // 3 * 12 + k) % 300}")
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    docs, labels = make_docs(rows), spark.createDataFrame(labels, LABEL)
    whole = T.fit_toxicity(docs, labels)
    assert len(whole.lexicon) > 256
    monkeypatch.setattr(T, "SAMPLE_CELLS", 40_000)
    some = T.fit_toxicity(docs, labels)
    assert set(some.lexicon) == set(whole.lexicon)
    told = T.score_toxicity(docs, some).join(labels, "doc_id").select((F.col("predicted") == F.col("toxic")).alias("right")).collect()
    assert sum(r.right for r in told) > 0.95 * len(told)


def test_label_model_finds_accuracies():
    rng = np.random.default_rng(0)
    y = rng.random(6000) < 0.2
    good = np.where(rng.random((6000, 3)) < 0.9, np.where(y, 1, -1)[:, None], np.where(y, -1, 1)[:, None])
    noise = rng.integers(-1, 2, (6000, 2))
    v = np.column_stack([good, good[:, :1], noise]).astype(np.int8)  # one voter is there twice
    post, table, corr = T.label_model(v, np.ones(len(v)), 0.2)
    assert ((post > 0.5) == y).mean() > 0.93
    assert (np.abs(table[:3, 1, 2] - 0.9) < 0.06).all() and corr[0, 3] > 0.9 and abs(corr[0, 4]) < 0.1


def test_em_against_plain_loops():
    """Posteriors of counted rows against EM written out row by row, with the weights that the correlations give."""
    rng = np.random.default_rng(4)
    rows = rng.integers(-1, 2, (12, 4)).astype(np.int8)
    counts = rng.integers(1, 9, 12)
    share = 0.3
    weight = [1.0] * 4
    whole = np.repeat(rows, counts, axis=0)

    def table_of(post):
        table = [[[0.1] * 3 for _ in range(2)] for _ in range(4)]
        for row, p in zip(whole, post, strict=True):
            for m, vote in enumerate(row):
                table[m][0][vote + 1] += 1 - p
                table[m][1][vote + 1] += p
        return [[[n / sum(of) for n in of] for of in voter] for voter in table]

    for stage in range(3):
        post = [0.9 if sum(w * v for w, v in zip(weight, row, strict=True)) > 0 else 0.02 for row in whole]
        for _ in range(25 if stage else 0):
            table = table_of(post)
            odds = [sum(weight[m] * math.log(table[m][1][v + 1] / table[m][0][v + 1]) for m, v in enumerate(row)) for row in whole]
            low, high = -100.0, 100.0
            for _ in range(60):
                mid = (low + high) / 2
                post = [1 / (1 + math.exp(-o - mid)) for o in odds]
                low, high = (mid, high) if sum(post) < share * len(whole) else (low, mid)
        table = table_of(post)
        rest = [[v - sum(c * sum((k - 1) * table[m][y][k] for k in range(3)) for y, c in ((0, 1 - p), (1, p))) for m, v in enumerate(row)] for row, p in zip(whole, post, strict=True)]
        corr = np.corrcoef(np.array(rest).T)
        weight = [1 / max(1.0, sum(min(max(c, 0.0), 1.0) ** 3 for c in row)) for row in corr]
    got, got_table, got_corr = T.label_model(rows, counts, share)
    assert np.allclose(np.repeat(got, counts), post, atol=1e-4) and np.allclose(got_table, table, atol=1e-4) and np.allclose(got_corr, corr, atol=1e-4)
    assert abs(got @ counts / counts.sum() - share) < 1e-6


@pytest.mark.skipif(not DATA.exists(), reason="no test tables")
def test_on_the_tables(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    out = T.score_toxicity(docs, T.fit_toxicity(docs, labels)).where("held_out").join(labels, "doc_id").select("predicted", "toxic").toPandas()
    hit = ((out.predicted == 1) & (out.toxic == 1)).sum()
    assert hit / (out.toxic == 1).sum() >= 0.9 and hit / (out.predicted == 1).sum() > 0.9
