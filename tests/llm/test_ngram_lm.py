"""Stupid backoff against counts in plain dictionaries."""

import math
from collections import Counter

import numpy as np
import pytest

from turnengine.llm import ngram_lm as L


def plain(texts, order, alpha=L.ALPHA, leave_out=True):
    docs = [(t or "").encode().lower().split() for t in texts]
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)) + Counter({(): len(w)})
    own = [grams(w) for w in docs]
    every = sum(own, Counter())
    out = []
    for w, mine in zip(docs, own, strict=True):
        c = lambda g: every[g] - (mine[g] if leave_out else 0)  # noqa: B023, E731

        def s(context, x):
            if c((*context, x)) > 0:
                return math.log(c((*context, x))) - math.log(c(context))
            return math.log(alpha) + s(context[1:], x) if context else -math.log(c(()) + 1)

        out.append((len(w), sum(s(tuple(w[max(0, i - order + 1) : i]), x) for i, x in enumerate(w))))
    return out


@pytest.mark.parametrize(("order", "leave_out"), [(1, True), (2, True), (3, True), (3, False)])
def test_scores(make_docs, odd_rows, monkeypatch, order, leave_out):
    monkeypatch.setattr(L, "CHUNK", 20_000)
    texts = [t for _, t in odd_rows] + ["the cat sat", "the cat ran", "THE dog sat the cat", "a b c", "zebra", "b c d e", "Été ÉTÉ été", "x\x0by\x0cz"]
    docs = make_docs(list(enumerate(texts)), extra=True)
    for scores in (L.score_corpus, L.relational_scores):
        if scores is L.relational_scores:
            texts = [t and t[:2000] for t in texts]
            docs = make_docs(list(enumerate(texts)))
        got = sorted((r.doc_id, r.n_tokens, r.log_score, r.mean_log_score) for r in scores(docs, order, leave_out=leave_out).collect())
        for (i, n, score, mean), (m, expected) in zip(got, plain(texts, order, leave_out=leave_out), strict=True):
            assert n == m and abs(score - expected) < 1e-6 * max(1, abs(expected)), texts[i]
            assert abs(mean - score / max(n, 1)) < 1e-9
        assert scores(docs.limit(0)).count() == 0


def test_repeated_rows_spread_over_chunks(make_docs, monkeypatch):
    monkeypatch.setattr(L, "CHUNK", 100)
    texts = ["same words here"] * 60 + ["other words"]
    got = sorted((r.n_tokens, round(r.log_score, 9)) for r in L.score_corpus(make_docs([(None, t) for t in texts])).collect())
    assert got == sorted((n, round(s, 9)) for n, s in plain(texts, 3))


@pytest.mark.parametrize("bits", [6, 24, 30])
def test_buckets_keep_the_order_of_keys(bits):
    keys = np.unique(np.random.default_rng(2).integers(0, 1 << 64, 5000, dtype=np.uint64))
    buckets, cuts, low = L.bucket_runs(keys, bits)
    assert (np.diff(buckets) > 0).all() and cuts[-1] == len(keys)
    again = np.concatenate([(np.uint64(b) << np.uint64(min(40, 64 - bits))) + low[i:j] for b, i, j in zip(buckets, cuts, cuts[1:], strict=False)])
    assert (again == keys >> np.uint64(64 - bits - min(40, 64 - bits))).all()


def test_codecs():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 4000):
        keys = np.unique(rng.integers(0, 1 << 40, n, dtype=np.uint64))
        assert (L.unpack_keys(L.pack_keys(keys)) == keys).all()
        for top in (3, 300, 70_000, 1 << 40):
            counts = rng.integers(0, top, n)
            assert (L.unpack_counts(L.pack_counts(counts)) == counts).all()
