"""Secret scans: fixed patterns plus sliding-window Shannon entropy per character class.

Base kinds (assign, access, hex) are regular expressions over the whole text. The entropy kind looks at
candidate strings: maximal runs of [A-Za-z0-9+/_=-] of at least WINDOW characters. A window of WINDOW characters
slides over each run, and the window's entropy is kept by incremental counts: when one character enters and one
leaves, two terms of sum(c * log2 c) change. A window is held to the threshold of the narrowest character class that
holds it, whatever stands beside it in the run; runs without a digit have a higher threshold. Windows at or above
their threshold merge into spans. The allow list suppresses runs that are known to be harmless (UUIDs, dates,
phone-like digit groups, URLs' hosts, words with separators), and windows that touch a placeholder string. Base spans
are never suppressed. The result per text is one map step: no shuffle, memory bounded by an Arrow batch, and a lost
task is simply run again.

Defined cases: null and empty texts have no spans; ties cannot occur (a span is its kind, start and end); offsets
are code points, end exclusive; repeated rows are scanned one by one; columns of other names are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from turnengine.llm.common import ship

KINDS = ("assign", "access", "hex", "entropy")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: Runs are maximal, so a run of 32 or more is what is left of [0-9a-f]+ once shorter matches are dropped.
HEX = re.compile(r"[0-9a-f]{32,}")

WINDOW = 20
#: Class name, its characters, least entropy in bits of a window of 20 (at most log2 20 = 4.32).
CLASSES = (
    ("hex", frozenset("0123456789abcdefABCDEF"), 3.0),
    ("alnum", frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"), 3.7),
    ("base64", frozenset("0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/=_-"), 3.9),
)
#: In runs without a digit: no hex, and more for letters, which may be words.
LETTERS = (("letters", CLASSES[1][1], 3.75), CLASSES[2])
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
_PARTS = {c[0]: re.compile(f"[{re.escape(''.join(sorted(c[1])))}]{{{WINDOW},}}") for c in (*CLASSES, *LETTERS)}
_DIGIT = re.compile("[0-9]")
#: Allow list, matched against the whole candidate.
ALLOWED = re.compile(
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"  # UUID
    r"|[0-9][0-9/_=+-]*"  # dates, phone numbers, ids of digits and separators
    r"|(?:[A-Za-z]{1,14}|[0-9]{1,4})(?:[-_/=+]+(?:[A-Za-z]{1,14}|[0-9]{1,4}))+"  # words or short numbers with separators
)
#: Placeholders: they cut a candidate, so no window holds one.
PLACEHOLDER = re.compile(r"EXAMPLE|example|x{6,}|X{6,}|0{6,}")
_CLOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 2)]  # one more while a character enters
_FULL = math.log2(WINDOW)


def entropy_spans(run: str, least: float) -> list[tuple[int, int]]:
    """Merged [start, end) of all windows of run with entropy >= least; counts are kept incrementally."""
    counts: dict[str, int] = {}
    total = 0.0  # sum of c * log2 c over the window
    most = (_FULL - least) * WINDOW + 1e-9  # entropy >= least is the same as total <= most
    spans: list[tuple[int, int]] = []
    for i, char in enumerate(run):
        c = counts.get(char, 0)
        total += _CLOG[c + 1] - _CLOG[c]
        counts[char] = c + 1
        if i >= WINDOW:
            old = run[i - WINDOW]
            c = counts[old]
            total += _CLOG[c - 1] - _CLOG[c]
            counts[old] = c - 1
        if i >= WINDOW - 1 and total <= most:
            if spans and spans[-1][1] >= i - WINDOW + 1:
                spans[-1] = (spans[-1][0], i + 1)
            else:
                spans.append((i - WINDOW + 1, i + 1))
    return spans


def run_spans(run: str) -> list[tuple[int, int]]:
    """Merged [start, end) of all windows of a candidate that reach the threshold of their own class.

    A window lies in a class just if it lies in a maximal part of that class, so each class scans its parts.
    """
    found = []
    classes = CLASSES if _DIGIT.search(run) else LETTERS
    cuts = [0, *(at for m in PLACEHOLDER.finditer(run) for at in m.span()), len(run)]
    for low, high in zip(cuts[::2], cuts[1::2], strict=True):
        for name, _, least in classes:
            for m in _PARTS[name].finditer(run, low, high):
                if not m.group().isdigit():  # an id or a phone number, as in the allow list
                    found += [(m.start() + a, m.start() + b) for a, b in entropy_spans(m.group(), least)]
    spans: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if spans and spans[-1][1] >= a:
            spans[-1] = (spans[-1][0], max(spans[-1][1], b))
        else:
            spans.append((a, b))
    return spans


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of assign, access and hex matches that pass their length limits."""
    found = []
    lowered = text.lower()
    if any(w in lowered for w in ASSIGN_WORDS):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return found


def scan(text: str | None) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base spans, all spans) of a text, each (start, kind index, end), sorted by start, then kind."""
    if not text:
        return [], []
    base = sorted(base_spans(text))
    extra = []
    for m in CANDIDATE.finditer(text):
        run = m.group()
        if ALLOWED.fullmatch(run):
            continue
        extra += [(m.start() + a, 3, m.start() + b) for a, b in run_spans(run)]
    return base, sorted(base + extra)


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str | None, mask: str = "[SECRET]") -> str | None:
    """text with every span replaced by mask; overlapping or touching spans become one."""
    _, spans = scan(text)
    if not spans:
        return text
    out, at, i = [], 0, 0
    while i < len(spans):
        start, _, end = spans[i]
        while i + 1 < len(spans) and spans[i + 1][0] <= end:
            i += 1
            end = max(end, spans[i][2])
        out += [text[at:start], mask]
        at, i = end, i + 1
    return "".join([*out, text[at:]])


def secret_digest(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, SHA-256 of the base spans, all spans and n_entropy; one row per document."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [scan(t) for t in batch.column(1).to_pylist()]
            count = lambda k: pa.array([sum(s[1] == k for s in spans) for _, spans in rows], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), count(0), count(1), count(2), pa.array([hashlib.sha256(join_spans(b).encode()).hexdigest() for b, _ in rows]), pa.array([join_spans(s) for _, s in rows]), count(3)],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_entropy"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_entropy long")


def redact_secrets(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with secrets in text masked and n_chars, where it is a column, set to the new length; all rows stay."""
    ship(docs.sparkSession)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = {n: batch.column(i) for i, n in enumerate(names)}
            old = columns["text"].to_pylist()
            new = [redact(t, mask) for t in old]
            columns["text"] = pa.array(new, columns["text"].type)
            if "n_chars" in columns:
                kept = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([c if a == b else len(b) for a, b, c in zip(old, new, kept, strict=True)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return docs.mapInArrow(run, docs.schema)
