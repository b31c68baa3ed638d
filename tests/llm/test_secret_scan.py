"""Secret scan against the patterns as they are stated, and against entropy counted anew per window."""

import hashlib
import math
import random
import re
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st

from turnengine.llm import secret_scan as S


def plain_base(text):
    found = []
    for k, (pattern, flags, ok) in enumerate((
        (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, lambda m: len(m[2]) >= 8),
        (r"AKIA[A-Z0-9]+", 0, lambda m: len(m[0]) >= 16), (r"[0-9a-f]+", 0, lambda m: len(m[0]) >= 32),
    )):
        found += [(m.start(), k, m.end()) for m in re.finditer(pattern, text, flags) if ok(m)]
    return sorted(found)


PARTS = ["token", "SECRET", "api_key", "apikey", "passwd", "=", ":", '"', "'", " ", "  ", "abc", "abcdefgh1", "AKIA", "AKIAABCDEFGHIJKL", "0f" * 16, "0123456789abcdef", "ſecret=abcdefgh9", "é", "\n", "x.y/z-"]


@settings(max_examples=400, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=12))
def test_base(parts):
    text = "".join(parts)
    base, every = S.scan(text)
    assert base == plain_base(text) and set(base) <= set(every) and every == sorted(every)


def plain_entropy(run, least):
    spans = []
    for i in range(len(run) - S.WINDOW + 1):
        h = -sum(c / S.WINDOW * math.log2(c / S.WINDOW) for c in Counter(run[i : i + S.WINDOW]).values())
        if h >= least - 1e-10:
            if spans and spans[-1][1] >= i:
                spans[-1] = (spans[-1][0], i + S.WINDOW)
            else:
                spans.append((i, i + S.WINDOW))
    return spans


def test_entropy_windows():
    rng = random.Random(3)
    for _ in range(200):
        run = "".join(rng.choice("0123456789abcdefXYZ"[: rng.choice((3, 8, 19))]) for _ in range(rng.randint(0, 120)))
        for least in (2.5, 3.0, 3.7):
            assert S.entropy_spans(run, least) == plain_entropy(run, least)


def test_candidates_and_allow_list():
    assert [S.KINDS[k] for _, k, _ in S.scan("key q8Zr4LmX0vTb7NcJ2kPw5YdH end")[1]] == ["entropy"]
    for calm in ("123e4567-e89b-12d3-a456-426614174000", "2024-01-02-2024-01-03-2024", "alpha-beta-gamma-delta-12-epsilon", "q8Zr4LmX0vTEXAMPLEcJ2kPw5YdH", "aaaaaaaaaaaaaaaaaaaaaaaa1", "donaudampfschifffahrtsgesellschaft", ""):
        assert S.scan(calm)[1] == []


def found(make, n=300):
    rng = random.Random(6)
    return sum(any(k == 3 for _, k, _ in S.scan(make(rng))[1]) for _ in range(n)) / n


def test_a_name_beside_a_secret_hides_nothing():
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    secret = lambda rng, n=24, of="0123456789abcdef": "".join(rng.choice(of) for _ in range(n))
    for before in ("", "key_", "id=", "x", "SESSION=", "example_key=", "000000-"):
        assert found(lambda rng, b=before: b + secret(rng)) > 0.95
    assert found(lambda rng: secret(rng, 40, letters)) > 0.95
    assert found(lambda rng: secret(rng, 30) + "=EXAMPLE") > 0.95
    for calm in ("id=12345678901234567890", "example=2024-01-02-2024-01-03", "getElementsByClassNameOrTagName"):
        assert S.scan(calm)[1] == []


def test_windows_are_judged_by_their_own_class():
    rng = random.Random(7)
    for _ in range(300):
        run = "1" + "".join(rng.choice(rng.choice(("0123456789abcdef", "ghijkXYZ", "=_-")[: rng.randint(1, 3)])) for _ in range(rng.randint(19, 70)))
        if S.PLACEHOLDER.search(run):
            continue
        covered = set()
        for i in range(len(run) - S.WINDOW + 1):
            part = run[i : i + S.WINDOW]
            least = next(c[2] for c in S.CLASSES if set(part) <= c[1])
            if not part.isdigit() and plain_entropy(part, least):
                covered |= set(range(i, i + S.WINDOW))
        assert {x for a, b in S.run_spans(run) for x in range(a, b)} == covered


def test_digest_and_redaction(make_docs, odd_rows):
    secret = 'x token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" y'
    docs = make_docs([*odd_rows, (20, secret), (20, secret)], extra=True)
    rows = S.secret_digest(docs).collect()
    assert len(rows) == len(odd_rows) + 2
    hit = [r for r in rows if r.doc_id == 20]
    assert hit[0] == hit[1] and (hit[0].n_assign, hit[0].n_access, hit[0].n_hex) == (1, 0, 1)
    assert hit[0].base_sha256 == hashlib.sha256(b"assign:2:51,hex:11:51").hexdigest() and hit[0].spans.startswith("assign:2:51,")
    assert all(r.base_sha256 == hashlib.sha256(b"").hexdigest() for r in rows if r.doc_id != 20)
    out = S.redact_secrets(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    changed = out.where("doc_id = 20").first()
    assert changed.text == 'x [SECRET]" y' and changed.n_chars == len(changed.text)
    assert sorted(map(str, out.where("doc_id < 20").collect())) == sorted(map(str, docs.where("doc_id < 20").collect()))
    assert S.secret_digest(docs.limit(0)).count() == 0
