"""SimHash groups and near-duplicate stage against brute force."""

import random
import re

import numpy as np
from xxhash import xxh64_intdigest

from turnengine.llm import simhash as S
from turnengine.llm.components import connected_components


def plain_fingerprint(text, size=3):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + size]) for i in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(n, linked):
    parent = list(range(n))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(n):
        for b in range(a):
            if linked(a, b):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_odd_rows(make_docs, odd_rows):
    rows = {(r.doc_id, r.fingerprint, r.component_id) for r in S.simhash_components(make_docs(odd_rows, extra=True)).collect()}
    fp = {d: f"{plain_fingerprint(t):016x}" for d, t in odd_rows}
    assert {(d, f) for d, f, _ in rows} == set(fp.items())
    assert {c for d, _, c in rows if d in (1, 2, 3)} == {1} and {c for d, _, c in rows if d in (6, 7, None)} == {6}
    assert S.simhash_components(make_docs(odd_rows)).count() == len(odd_rows)
    assert S.simhash_components(make_docs(odd_rows).limit(0)).count() == 0


def test_rows_without_id_link_others(make_docs, monkeypatch):
    codes = {"a": 0, "b": 0b111, "c": 0b111111, "d": 1 << 40 | 0b111000111000}
    monkeypatch.setattr(S, "fingerprints", lambda docs, size: docs.selectExpr("doc_id", "CAST(n_chars AS bigint) AS fp"))
    docs = make_docs([(1, "a"), (None, "b"), (2, "c"), (None, "d")])
    docs = docs.drop("n_chars").join(docs.sparkSession.createDataFrame(list(codes.items()), "text string, n_chars long"), "text")
    assert {(r.doc_id, r.component_id) for r in S.simhash_components(docs).collect()} == {(1, 1), (None, 1), (2, 1), (None, None)}


def test_against_brute_force(make_docs, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)  # so that cells split into blocks
    rng = random.Random(5)
    base = [" ".join(rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(60)) for _ in range(12)]
    texts = [rng.choice(base) for _ in range(60)]
    for _ in range(240):
        words = rng.choice(base).split()
        for _ in range(rng.randint(0, 2)):
            words[rng.randrange(60)] = "edit" + rng.choice("ab")
        texts.append(" ".join(words))
    texts += [" ".join(rng.choice("abc") for _ in range(3)) for _ in range(40)]
    fps = [plain_fingerprint(t) for t in texts]
    expected = classes(len(texts), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in S.simhash_components(make_docs(list(enumerate(texts)))).collect()}
    assert got == {i: (f"{fps[i]:016x}", expected[i]) for i in range(len(texts))}
    assert len(set(expected)) < len(set(fps))


def test_embedding_bounds_hamming():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 63, 5000, dtype=np.uint64)
    flips = np.array([sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 9), replace=False)) for _ in a], np.uint64)
    b = a ^ flips
    count = lambda x: np.array([[int(v) >> 2 * s & 1 for s in range(32)] for v in x]) + np.array([[int(v) >> 2 * s + 1 & 1 for s in range(32)] for v in x])
    assert (S.manhattan(a, b) == np.abs(count(a) - count(b)).sum(axis=1)).all()
    assert (S.manhattan(a, b) <= np.bitwise_count(a ^ b)).all()


def test_every_close_pair_shares_a_cell(spark):
    from pyspark.sql import functions as F

    rng = random.Random(9)
    rows = []
    for i in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 3)):
            b ^= 1 << bit
        rows.append((i, S._signed(a), S._signed(b)))
    df = spark.createDataFrame(rows, "i int, a long, b long").select(F.arrays_overlap(S.grid_cells(F.col("a")), S.grid_cells(F.col("b"))).alias("meet"))
    assert df.where("not meet").count() == 0


def test_components(spark):
    rng = random.Random(4)
    chain = [(i, i + 1) for i in range(200, 260)]
    star = [(1, i) for i in range(2, 90)]
    loose = [(rng.randrange(300, 700), rng.randrange(300, 700)) for _ in range(250)]
    edges = chain + star + loose + [(7, 7), (None, 3)]
    expected = classes(701, lambda a, b, s=set(edges): (a, b) in s or (b, a) in s)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert {n: c for n, c in got.items() if n != c} == {n: c for n, c in enumerate(expected) if n != c}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_copies(make_docs, odd_rows):
    rng = random.Random(8)
    texts = [" ".join(rng.choice("abcdefghijklmnop") + rng.choice("qrstuvwxyz") for _ in range(200)) for _ in range(30)]
    rows = [(100 + i, t) for i, t in enumerate(texts)]
    for i, t in enumerate(texts[:15]):
        words = t.split()
        for _ in range(2):
            words[rng.randrange(200)] = "zz"
        rows.append((300 + i, " ".join(words)))
    docs = make_docs([*odd_rows, *rows], extra=True)
    kept = S.drop_near_copies(docs)
    assert kept.columns == docs.columns
    ids = sorted((r.doc_id for r in kept.collect()), key=str)
    assert ids == sorted([1, 4, 5, 6, None, 8, *range(100, 130)], key=str)
    assert S.drop_near_copies(docs.limit(0)).count() == 0


def plain_similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


def test_near_groups_are_exact_around_the_threshold(make_docs, monkeypatch):
    monkeypatch.setattr(S, "BLOCK", 16)  # so that components split into blocks
    rng = random.Random(12)
    texts, shares = [], []
    for _ in range(120):
        base = [f"{rng.choice('abcdefgh')}{rng.randrange(10**6)}" for _ in range(204)]  # 200 shingles, all distinct
        cut = rng.randint(18, 27)  # J = (200 - cut) / (200 + cut): 0.835 to 0.762
        other = base[: 204 - cut] + [f"z{rng.randrange(10**6)}" for _ in range(cut)]
        texts += [" ".join(base), " ".join(other)]
        shares.append(plain_similarity(*texts[-2:]))
    family = [f"w{i}" for i in range(204)]  # a chain of copies, each like its neighbours only
    texts += [" ".join(f"{'v' if i < k else 'w'}{i}" for i in range(204)) for k in range(0, 200, 10)] + [" ".join(family)]
    expected = classes(len(texts), lambda a, b: plain_similarity(texts[a], texts[b]) >= 0.8)
    got = {r.doc_id: r.component_id for r in S.near_groups(make_docs(list(enumerate(texts)))).collect()}
    assert got == dict(enumerate(expected))
    assert min(shares) < 0.78 and max(shares) > 0.82


def test_near_copies_are_found_by_fingerprints(make_docs, monkeypatch):
    """Where no two sets share a band, pairs within RADIUS bits are found all the same, and verified."""
    monkeypatch.setattr(S, "sketch", lambda h: np.random.default_rng(int(h.sum() >> np.uint64(1))).integers(0, 1 << 32, S.BANDS * S.ROWS, dtype=np.uint32))
    monkeypatch.setattr(S, "CANDIDATE", 0.0)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join(words), " ".join([*words[:-1], "x"]), " ".join(["y", *words[1:]]), " ".join(words[150:] + ["z"] * 150), "one two three", "one two four"]
    assert all((S.majority(S.shingle_hashes(a.encode(), 3)) ^ S.majority(S.shingle_hashes(texts[0].encode(), 3))).bit_count() <= S.RADIUS for a in texts[1:3])
    got = {r.doc_id: r.component_id for r in S.near_groups(make_docs(list(enumerate(texts)))).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4, 5: 5}


def test_a_repeated_id_keeps_its_unique_text(make_docs):
    rng = random.Random(2)
    one, two = (" ".join(f"{c}{rng.randrange(10**6)}" for _ in range(200)) for c in "ab")
    near = " ".join(["new", *two.split()[1:]])
    rows = [(1, one), (2, one), (2, two), (2, near), (3, two), (3, "quite another text of the same id"), (3, "quite another text of the same id")]
    kept = S.drop_near_copies(make_docs(rows)).collect()
    assert sorted(r.doc_id for r in kept) == [1, 2, 3] and {r.text for r in kept if r.doc_id != 2} == {one, rows[5][1]}
    assert {r.text for r in kept if r.doc_id == 2} < {two, near}


def test_of_repeats_from_other_sources_always_the_same_stays(make_docs):
    one, two = "one two three four five six", "another text of seven words in all"
    rows = [(1, one, s) for s in "cabc"] + [(2, one, "a"), (3, two, "z"), (3, two, None), (None, one, "b"), (None, one, "a")]
    for order in (rows, rows[::-1]):
        kept = S.drop_near_copies(make_docs(order, extra=True).repartition(4)).collect()
        assert sorted((r.doc_id, r.source) for r in kept if r.doc_id) == [(1, "a"), (3, "z")]
        assert sorted(r.source for r in kept if r.doc_id is None) == ["a", "b"]


def test_ids_are_not_broadcast(make_docs):
    found = S.simhash_components(make_docs([(i, f"word{i} b c d") for i in range(20)]))
    assert found.count() == 20 and "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
