"""Product codes against plain Lloyd rounds, whitening against an eigendecomposition."""

import hashlib

import numpy as np
import pytest

from turnengine.llm import elkan_codes as K
from turnengine.llm import jacobi_whiten as J

SCHEMA = "vec_id long, embedding array<float>, label int, x string, code string, entry string, n string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if c is None else float(c) for c in v], l, *"abcde") for i, v, l in rows], SCHEMA)


def odd():
    """Nulls, no components, short vectors, repeated rows, ties, a null vec_id and null labels."""
    bad = [(1, None, 1), (2, [1, None], 1), (3, [float("nan"), 1], 1), (4, [float("-inf"), 1], 1)]
    return [*bad, (5, [], 1), (6, [0.25, -0.5], None), (6, [0.25, -0.5], None), (7, [1, 2, 3, 4, 5, 6, 7, 8, 9], 2), (None, [1, 1], None), (8, [1, 1], 2), (8, [0.5, 1], 2), (9, [1, 1], 1)]


def usable(rows, scale, offset=0):
    kept = [(i, [np.float32(c) for c in v], l) for i, v, l in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    width = max((len(v) for _, v, _ in kept), default=0)
    return [(i, [int(np.floor(np.float64(c) * scale)) + offset for c in v] + [offset] * (width - len(v)), l) for i, v, l in kept]


def plain_codes(rows, rounds=6):
    rows = usable(rows, 4096)
    width = max(8, -(-len(rows[0][1]) // 8) * 8)
    x = np.array([v + [0] * (width - len(v)) for _, v, _ in rows], np.int64).reshape(len(rows), 8, -1)
    first = {}
    for (i, _, _), v in zip(rows, x, strict=True):
        key = (i is None, i or 0)
        first[key] = min(first.get(key, v.ravel().tolist()), v.ravel().tolist())
    books = np.array([first[k] for k in sorted(first)[:16]], np.int64).reshape(-1, 8, width // 8).transpose(1, 0, 2).copy()
    for r in range(rounds + 1):
        d = ((x[:, :, None] - books[None]) ** 2).sum(axis=3)
        near = d.argmin(axis=2)
        if r < rounds:
            for p in range(8):
                for e in range(books.shape[1]):
                    if (near[:, p] == e).any():
                        books[p, e] = [int(s) // int((near[:, p] == e).sum()) for s in x[near[:, p] == e, p].sum(axis=0)]
    error = d.min(axis=2).sum(axis=1)
    labels = [l for _, _, l in rows]
    sha = hashlib.sha256(",".join(str(int(v)) for v in books.ravel()).encode()).hexdigest()
    return sorted((str(i), bytes(n.astype(np.uint8)).hex(), int(e), sum(int(o) for o, k in zip(error, labels, strict=True) if k == l), sha) for (i, _, l), n, e in zip(rows, near, error, strict=True))


def codes(df):
    return sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in df.collect())


@pytest.mark.parametrize("seed", [0, 1])
def test_codes_equal_plain_rounds(spark, monkeypatch, seed):
    monkeypatch.setattr(K, "SLICE", 64)
    rng = np.random.default_rng(seed)
    # few distinct values make many ties; a third of the rows are one vector
    x = (rng.integers(-3, 4, (400, 24)) / 4 if seed else rng.standard_normal((400, 24))).astype(np.float32)
    x[rng.random(400) < 0.33] = x[0]
    rows = [(i, v, int(l)) for i, (v, l) in enumerate(zip(x.tolist(), rng.integers(0, 3, 400), strict=True))]
    assert codes(K.product_codes(frame(spark, rows).repartition(3))) == plain_codes(rows)


def test_codes_of_odd_rows(spark):
    assert codes(K.product_codes(frame(spark, odd()).repartition(3))) == plain_codes(odd())
    assert K.product_codes(frame(spark, odd()[:4])).count() == 0 and K.product_codes(frame(spark, [])).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    with pytest.raises(ValueError, match="64 bits"):
        K.product_codes(frame(spark, [(1, [1e20], 1)]))


def test_bounds_prune_and_hold(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((16, 32))
    x = (centres[rng.integers(0, 16, 3000)] + 0.05 * rng.standard_normal((3000, 32))).astype(np.float32)
    x[:16] = centres
    model, state, before = K.fit_codes(frame(spark, [(i, v, 0) for i, v in enumerate(x.tolist())]))
    assert model.shares[0] == 1.0 and max(model.shares[2:]) < 0.2  # clustered rows: few distances are evaluated
    for r in state.where("counts is null").limit(200).collect():
        v = np.frombuffer(r.x, "<i4").reshape(1, 8, -1).astype(np.int64)
        d = np.sqrt(K.squared(v, before))[0]
        entry = np.frombuffer(r.entry, np.uint8)
        assert (np.frombuffer(r.lower, "<f4").reshape(8, 16) <= d).all() and (np.frombuffer(r.upper, "<f4") >= d[np.arange(8), entry]).all()
        assert (entry == d.argmin(axis=1)).all()


def plain_whitening(rows):
    rows = usable(rows, 64, 1_000_000)
    fit = np.array(sorted({tuple(v) for _, v, _ in rows}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    centred = ((n * fit - sums) / n).astype(np.float64)
    e, v = np.linalg.eigh(centred.T @ centred / n)
    e, v = e[::-1], v[:, ::-1]
    return rows, n, sums, e, v


def check_whitening(found, rows, keep):
    rows, n, sums, e, v = plain_whitening(rows)
    by = {}
    for r in found:
        by.setdefault((r.vec_id, r.deviation), {}).setdefault(r.component, []).append(r)
    assert len(found) == len(rows) * keep and {r.n for r in found} == {n} and all(r.identity_error <= 1e-8 for r in found)
    for i, x, _ in rows:
        scaled = [n * a - b for a, b in zip(x, sums, strict=True)]
        got = by[i, sum(s * s for s in scaled)]
        for k in range(keep):
            expected = float((np.array(scaled, np.float64) / n) @ v[:, k] / np.sqrt(e[k]))
            assert any(abs(abs(g.whitened) - abs(expected)) < 1e-6 for g in got[k + 1])
            assert abs(got[k + 1][0].explained / (e[k] / e.sum()) - 1) < 1e-6


@pytest.mark.parametrize("block, fan", [(4096, 32), (16, 2)])
def test_whitening(spark, monkeypatch, block, fan):
    monkeypatch.setattr(J, "BLOCK", block)
    monkeypatch.setattr(J, "FAN", fan)
    rng = np.random.default_rng(2)
    x = (rng.standard_normal((300, 20)) * np.geomspace(1, 40, 20)).astype(np.float32)
    x[100:200] = x[0]  # copies count once
    rows = [(i, v, 0) for i, v in enumerate(x.tolist())]
    check_whitening(J.whiten(frame(spark, rows).repartition(9)).collect(), rows, 16)
    assert len(J.whiten(frame(spark, rows), components=3).collect()) == 900


def test_whitening_of_odd_rows(spark):
    found = J.whiten(frame(spark, odd()).repartition(3)).collect()
    rows, n, sums, e, v = plain_whitening(odd())
    check_whitening(found, odd(), int((e > 1e-9 * e[0]).sum()))
    for rows in ([], odd()[:4], [(1, [1, 2], 0), (2, [1, 2], 0)], [(1, [], 0)]):
        assert J.whiten(frame(spark, rows)).count() == 0


def test_jacobi_equals_singular_values():
    rng = np.random.default_rng(4)
    for d in (1, 2, 7, 40):
        r = np.triu(rng.standard_normal((d, d)) * np.geomspace(1, 1e6, d))
        length, v = J.jacobi(r)
        assert np.allclose(length, np.linalg.svd(r, compute_uv=False), rtol=1e-10)
        assert np.allclose(v.T @ v, np.eye(d), atol=1e-12) and np.allclose(np.linalg.norm(r @ v, axis=0), length)
