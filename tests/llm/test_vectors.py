"""The two vector operators against brute force."""

import numpy as np
import pytest

from turnengine.llm import embed_forest as E
from turnengine.llm import entries
from turnengine.llm import pivot_topk as P

SCHEMA = "vec_id long, embedding array<float>, label int, rep long, cells string, score string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], l, 1, "clash", "clash") for i, v, l in rows], SCHEMA)


def odd():
    return [(1, None, 1), (2, [], 1), (3, [0, 0], 1), (4, [1, None], 1), (5, [float("nan"), 1], 1), (6, [float("inf"), 1], 1), (7, [1, 1], None), (None, [1, 1], 1), (8, [1, 1], 1), (9, [2, 2], 1), (9, [2, 2], 1), (10, [1, 1], 2), (11, [1, 1, 1], 1), (12, [1e-30, 1e-30], 1)]


def plain_links(x, labels):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = (u @ u.T >= E.COSINE) & (labels[:, None] == labels[None])
    np.fill_diagonal(near, False)
    part = np.arange(len(x))
    while True:
        new = np.where(near, part[None], len(x)).min(axis=1)
        new = np.minimum(part, new)
        if (new == part).all():
            return near.sum(axis=1), part
        part = new


@pytest.mark.parametrize("blocks", [512, 40])
def test_forest(spark, monkeypatch, blocks):
    monkeypatch.setattr(E, "BLOCK", blocks)
    monkeypatch.setattr(E, "LEAF", 60)
    rng = np.random.default_rng(3)
    centres = rng.standard_normal((60, 16))
    x = np.concatenate([centres[rng.integers(0, 60, 500)] + 0.12 * rng.standard_normal((500, 16)), np.repeat(centres[:1], 60, axis=0), centres[1] + 0.05 * rng.standard_normal((140, 16))]).astype(np.float32)
    labels = rng.integers(0, 3, len(x))
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.near_vectors(frame(spark, [(i, v, int(l)) for i, (v, l) in enumerate(zip(x.tolist(), labels, strict=True))])).collect()}
    links, part = plain_links(x.astype(np.float64), labels)
    assert sum(got[i][0] for i in got) >= 0.98 * links.sum() and all(got[i][0] <= links[i] for i in got)
    assert np.mean([got[i][1] == part[i] for i in got]) > 0.98
    assert all(k == (i == c) for i, (_, c, k) in got.items())


@pytest.mark.parametrize("share", [0.33, 1.0])
def test_forest_keeps_the_pairs_of_a_dense_group(share):
    rng = np.random.default_rng(6)
    centre = E._unit(rng.standard_normal((1, 64)))
    dense = lambda n: E._unit(centre + 0.23 / 8 * rng.standard_normal((n, 64)))  # noqa: E731  pairs at about 0.95
    n = int(6000 * share)
    x = rng.permutation(np.concatenate([dense(n), E._unit(rng.standard_normal((6000 - n, 64)))]))
    a, b = dense(1000), dense(1000)
    near = (a * b).sum(axis=1) >= E.COSINE
    met = np.zeros(1000, bool)
    for t in range(E.shape(200_000)[1]):
        root, levels = E.grow(x, t, 10), E.level_splits(x, t, 10)
        met |= [bool(set(p) & set(q)) for p, q in zip(E.leaves(a, t, root, levels), E.leaves(b, t, root, levels), strict=True)]
    assert near.sum() > 500 and met[near].mean() >= 0.95


@pytest.mark.parametrize("n", [5_000, 320_000, 20_000_000])
def test_forest_planted_pairs_and_growth(n):
    """Recall of pairs between 0.93 and 0.95 at the depth and number of trees of a label of n vectors, and rows per vector."""
    rng = np.random.default_rng(n)
    x = E._unit(rng.standard_normal((E.SAMPLE, 64)))
    a = E._unit(rng.standard_normal((1500, 64)))
    cosine = rng.uniform(0.93, 0.95, (1500, 1))
    aside = rng.standard_normal((1500, 64))
    b = cosine * a + np.sqrt(1 - cosine**2) * E._unit(aside - (aside * a).sum(axis=1, keepdims=True) * a)
    depth, trees = E.shape(n)
    met, rows, size = np.zeros(1500, bool), 0, {}
    for t in range(trees):
        root, levels = E.grow(x, t, depth), E.level_splits(x, t, depth)
        of_a, of_b = E.leaves(a, t, root, levels), E.leaves(b, t, root, levels)
        met |= [bool(set(p) & set(q)) for p, q in zip(of_a, of_b, strict=True)]
        rows += sum(map(len, of_a)) / 1500
    assert met.mean() >= 0.98
    assert rows <= 1.8 * n**0.2


def test_planted_vectors_have_links(spark):
    base = frame(spark, [(i, v, i % 3) for i, v in enumerate(np.random.default_rng(9).standard_normal((200, 48)).tolist())]).select("vec_id", "label", "embedding")
    rows = {r.vec_id: (r.n_links, r.component_id) for r in E.near_vectors(entries.planted_vectors(base)).collect()}
    links, _ = plain_links(np.array([r.embedding for r in entries.planted_vectors(base).orderBy("vec_id").collect()]), np.tile(np.arange(200) % 3, 2))
    assert [rows[i][0] for i in sorted(rows)] == links.tolist() and 200 < links.sum() < 400
    assert all(rows[i + 1_000_000] == rows[i] for i in range(200) if i % 5 < 2)


@pytest.mark.parametrize("far", [8192, 90])
def test_forest_misses_no_link(spark, monkeypatch, far):
    """Trees without spill part many near pairs; these are found all the same, in one block and between blocks and tiles."""
    monkeypatch.setattr(E, "SPILL", 0.0)
    monkeypatch.setattr(E, "LEAF", 20)
    monkeypatch.setattr(E, "KEPT", 0.0)
    monkeypatch.setattr(E, "FAR", far)
    monkeypatch.setattr(E, "TILE", 64)
    rng = np.random.default_rng(5)
    x = rng.standard_normal((300, 24))
    x = np.concatenate([x, x + 0.34 * rng.standard_normal((300, 24)), x[:40], x[0] + 0.3 * rng.standard_normal((60, 24))]).astype(np.float32)
    labels = np.concatenate([np.tile(np.arange(300) % 2, 2), np.arange(40) % 2, np.zeros(60, int)])
    got = {r.vec_id: (r.n_links, r.component_id) for r in E.near_vectors(frame(spark, [(i, v, int(l)) for i, (v, l) in enumerate(zip(x.tolist(), labels, strict=True))])).collect()}
    links, part = plain_links(x.astype(np.float64), labels)
    assert links.sum() > 400 and [got[i] for i in range(len(x))] == list(zip(links.tolist(), part.tolist(), strict=True))


def test_forest_odd_rows(spark):
    rows = sorted((r.vec_id, r.n_links, r.component_id) for r in E.near_vectors(frame(spark, odd())).collect())
    alone = [(i, 0, i) for i in (1, 2, 3, 4, 5, 6, 7, 10)]
    assert rows == sorted([*alone, (8, 3, 8), (9, 3, 8), (9, 3, 8), (11, 0, 11), (12, 3, 8)])
    assert E.near_vectors(frame(spark, odd()).limit(0)).count() == 0


def plain_top(rows, k, every):
    ints = [(i, [int(np.floor(1024 * float(np.float32(x)))) for x in v]) for i, v, _ in rows]
    out = set()
    for i, v in ints:
        if i % every == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for j, w in ints if j != i)[:k]
            out |= {(i, r, j, -s) for r, (s, j) in enumerate(best, 1)}
    return out


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(P, "STEP", 8)
    rng = np.random.default_rng(5)
    rows = [(i, v, 0) for i, v in enumerate(np.concatenate([rng.standard_normal((150, 8)), np.repeat(rng.standard_normal((1, 8)), 30, axis=0)]).astype(np.float32).tolist())]
    for every, k in ((10, 10), (1, 3)):
        assert {tuple(r) for r in P.top_k(frame(spark, rows), k, every).collect()} == plain_top(rows, k, every)
    huge = [(i, [x * 1e5 for x in v], 0) for i, v, _ in rows[:20]]
    assert {tuple(r) for r in P.top_k(frame(spark, huge), 5, 4).collect()} == plain_top(huge, 5, 4)


def test_top_k_odd_rows(spark):
    rows = [(100 * (i or 0) if i in (8, 9) else i, v, l) for i, v, l in odd()]
    got = sorted(tuple(r) for r in P.top_k(frame(spark, rows), 10, 100).collect())
    assert {g[0] for g in got} == {800, 900}
    assert [(g[1], g[2]) for g in got if g[0] == 800] == [(1, 900), (2, 900), (3, 7), (4, 10), (5, 11), (6, 2), (7, 3), (8, 12)]
    assert P.top_k(frame(spark, rows).limit(0)).count() == 0
    assert P.top_k(frame(spark, [(100, [1.0], 0)])).count() == 0


def test_bound_eliminates_most_of_clustered_vectors(spark, monkeypatch):
    monkeypatch.setattr(P, "CANDIDATES", 300)  # hot regions are several blocks
    monkeypatch.setattr(P, "QUERIES", 5)
    rng = np.random.default_rng(8)
    centres = rng.standard_normal((40, 32))
    share = np.r_[np.zeros(1000, int), rng.integers(0, 40, 2000)]  # a third of all vectors in one cluster
    rows = [(i, v, 0) for i, v in enumerate((centres[share] + 0.05 * rng.standard_normal((3000, 32))).astype(np.float32).tolist())]
    assert {tuple(r) for r in P.top_k(frame(spark, rows), 10, 60).collect()} == plain_top(rows, 10, 60)
    done = {r.query_id: r.evaluated for r in P.evaluations(frame(spark, rows), 10, 60).collect()}
    assert set(done) == set(range(0, 3000, 60)) and sum(done.values()) < 0.3 * 3000 * len(done)
