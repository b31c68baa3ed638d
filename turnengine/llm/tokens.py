"""Whole-text tokenisation with the tokenizers library, each distinct word encoded once per worker.

Byte-pair encoders work word by word, and most words of a corpus repeat. A worker splits a text where the
tokenizer's own pre-tokenizer always splits too, encodes the words it has not met, and joins the stored ids. The
result equals encoding the whole text at once:

- "spaced" (byte-level BPE whose words carry their leading space): a split before each space and newline. A run of
  two such signs before a word is cut the same way by the pre-tokenizer; texts with longer runs of white space, or
  with a run at their end, are encoded whole, as are texts that begin with any other white space.
- "bare" (white space dropped, case ignored): a split at spaces and newlines; other white space stays inside the words.

Both kinds also split Latin letters (but U+0130) from the punctuation that follows. Words are found and told apart in one pass of
numpy over the bytes of many texts; new words of letters alone are encoded together as one text, whose ids are cut
apart again at the signs of a word's start or end. Texts that hold the string of an added token (which the library cuts out first) are encoded whole.

The store is bounded: it is emptied when it would pass MAX_WORDS, and words over MAX_WORD bytes are not kept.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

MAX_WORDS = 1_200_000
MAX_WORD = 48
#: New words encoded as one text, and characters of texts worked on at once.
JOINED, AT_ONCE = 2048, 1 << 19
_RUNS = re.compile(r"\s{3}|\s\s\Z")
_ODD = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Before a single space between letters.
_CUT = re.compile(r"[A-Za-z] (?=[A-Za-z])")
#: A space or newline, and letters that no normalisation changes.
_CORE = re.compile(r"[ \n][A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u024f]+")
#: Bytes with newlines as spaces and A-Z lowered.
_PLAIN = np.array([32 if b == 10 else b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
#: ASCII punctuation but the apostrophe, which contractions start with.
_MARK = np.zeros(256, bool)
_MARK[list(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")] = True
_LETTER = np.zeros(256, bool)
_LETTER[list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")] = True
_OPEN: dict[tuple[str, str], WordTokenizer] = {}


class WordTokenizer:
    def __init__(self, path: str, kind: str):
        from tokenizers import Tokenizer

        if kind not in ("spaced", "bare"):
            raise ValueError(f"kind must be spaced or bare, not {kind!r}")
        self.spaced = kind == "spaced"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.edge = np.zeros(max(vocabulary.values()) + 1, bool)  # ids at a word's start (spaced) or end (bare)
        self.edge[[i for t, i in vocabulary.items() if (t.startswith("\u0120") if self.spaced else t.endswith("</w>"))]] = True
        self.blank = dict(zip((b" ", b"\n"), self._ids([" ", "\n"]) if self.spaced else (b"", b""), strict=True))
        self.words: dict[bytes, bytes] = dict(self.blank)

    def _ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each whole text, null as empty, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        part: list[str] = []
        held = 0
        for t in texts:
            if t is not None and len(t) > 2 * AT_ONCE:
                out += [*self._encode(part), b"".join(ids for piece in self._pieces(t) for ids in self._encode([piece]))]
                part, held = [], 0
                continue
            part.append(t or "")
            held += len(part[-1])
            if held >= AT_ONCE:
                out += self._encode(part)
                part, held = [], 0
        return out + (self._encode(part) if part else [])

    def _pieces(self, text: str) -> Iterator[str]:
        """A very long text cut before single spaces, where words part whatever stands around them."""
        at = 0
        while len(text) - at > 2 * AT_ONCE and not any(" " in a for a in self.added):
            cut = _CUT.search(text, at + AT_ONCE)
            if cut is None:
                break
            yield text[at : cut.start() + 1]
            at = cut.start() + 1
        yield text[at:]

    def _apart(self, text: str) -> bool:
        """Whether a text has to be encoded whole."""
        if any(a in text for a in self.added):
            return True
        run = self.spaced and ("  " in text or "\n\n" in text or " \n" in text or "\n " in text or _ODD.search(text))
        return bool(run and (_RUNS.search(text) or _ODD.match(text)))

    def _encode(self, texts: list[str]) -> list[bytes]:
        whole = [i for i, t in enumerate(texts) if self._apart(t)]
        apart = set(whole)
        # every word begins with the sign before it; the first word of a text, which has none, gets a newline
        raw = [b"" if i in apart else b"\n" + t.encode() for i, t in enumerate(texts)]
        buffer = b"".join(raw)
        signs = np.frombuffer(buffer, np.uint8)
        if not self.spaced:
            signs = _PLAIN[signs]
            buffer = signs.tobytes()
        start = word_starts(signs)
        group, first = distinct_words(signs, start)
        stop = np.append(start[1:], len(signs))
        keys = [buffer[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist(), strict=True)]
        if len(self.words) + len(keys) > MAX_WORDS:
            self.words = dict(self.blank)
        known = list(map(self.words.get, keys))
        new = [k for k, ids in zip(keys, known, strict=True) if ids is None]
        if new:
            self._learn(new)
            known = list(map(self.words.__getitem__, keys))
            for k in new:
                if len(k) > MAX_WORD:
                    del self.words[k]
        ids = np.frombuffer(b"".join(known), np.uint32)
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begin = np.cumsum(size) - size
        length = size[group]
        after = np.cumsum(length)
        placed = ids[np.repeat(begin[group] - after + length, length) + np.arange(after[-1] if len(after) else 0)]
        at = np.cumsum([0, *map(len, raw)])
        ends = np.append(0, after)[np.searchsorted(start, at)].tolist()  # ids before each text
        flat, lead = placed.tobytes(), 1 if self.spaced else 0
        out = [flat[4 * (a + lead) : 4 * b] for a, b in zip(ends, ends[1:], strict=False)]
        for i, ids_of in zip(whole, self._ids([texts[i] for i in whole]), strict=True):
            out[i] = ids_of
        return out

    def _learn(self, new: list[bytes]) -> None:
        """Put words into the store."""
        texts = [k.decode() for k in new]
        core = [_CORE.fullmatch(t) is not None for t in texts]
        for sign in " \n":
            self.words.update(self._together([(k, t) for k, t, c in zip(new, texts, core, strict=True) if c and t[0] == sign], sign == " "))
        odd = [(k, t) for k, t, c in zip(new, texts, core, strict=True) if not c]
        self.words.update(zip([k for k, _ in odd], self._ids([t for _, t in odd]), strict=True))

    def _together(self, cores: list[tuple[bytes, str]], space: bool) -> list[tuple[bytes, bytes]]:
        """Ids of words of letters alone, all behind a space or all behind a newline, encoded as one text."""
        out: list[tuple[bytes, bytes]] = []
        line = self.spaced and not space
        for at in range(0, len(cores), JOINED):
            part = cores[at : at + JOINED]
            text = "".join([t for _, t in part])
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint32)
            edge = ids == np.frombuffer(self.blank[b"\n"], np.uint32)[0] if line else self.edge[ids]
            cuts = np.flatnonzero(edge)
            cuts = [*cuts.tolist(), len(ids)] if self.spaced else [0, *(cuts + 1).tolist()]
            if len(cuts) != len(part) + 1 or cuts[0] or cuts[-1] != len(ids):
                out += zip([k for k, _ in part], self._ids([t for _, t in part]), strict=True)
                continue
            raw = ids.tobytes()
            out += [(k, raw[4 * a : 4 * b]) for (k, _), a, b in zip(part, cuts, cuts[1:], strict=False)]
        return out


_BASES = tuple(np.uint64(b) for b in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F))
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n - 1), modulo 2**64."""
    if base not in _POWERS or len(_POWERS[base]) < n:
        _POWERS[base] = np.cumprod(np.r_[np.uint64(1), np.full(max(n, AT_ONCE) - 1, np.uint64(base), np.uint64)])
    return _POWERS[base][:n]


def word_starts(signs: np.ndarray) -> np.ndarray:
    """Where words begin: at spaces and newlines, and at punctuation behind a letter of ASCII or U+00C0 to U+023F but U+0130."""
    begins = (signs == 32) | (signs == 10)
    mark = np.flatnonzero(_MARK[signs])
    mark = mark[mark >= 2]
    before, lead = signs[mark - 1], signs[mark - 2]
    latin = (lead >= 0xC3) & (lead <= 0xC8) & (before >= 0x80) & ~((lead == 0xC3) & ((before == 0x97) | (before == 0xB7)))
    latin &= ~((lead == 0xC4) & (before == 0xB0))  # U+0130, whose lower case ends in a combining dot that keeps what follows
    begins[mark[_LETTER[before] | latin]] = True
    return np.flatnonzero(begins)


def distinct_words(signs: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(group of each word, a word of each group): words are the runs of signs from each start to the next.

    Words are told apart by two polynomial hashes of 64 bits, taken from running sums: one sorts, the other confirms.
    """
    n = len(signs)
    stop = np.append(start[1:], n)
    hashes = []
    for base in _BASES:
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(signs * _powers(int(base), n), out=total[1:])
        back = _powers(pow(int(base), -1, 1 << 64), n)
        hashes.append((total[stop] - total[start]) * back[start])
    order = np.argsort(hashes[0])
    ranked = hashes[0][order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    first = order[fresh]
    if (hashes[1] != hashes[1][first][group]).any():  # two words share the first hash: compare the words themselves
        seen: dict[bytes, int] = {}
        group = np.array([seen.setdefault(signs[a:b].tobytes(), len(seen)) for a, b in zip(start.tolist(), stop.tolist(), strict=True)])
        first = np.unique(group, return_index=True)[1]
    return group, first


def open_tokenizer(path: str, kind: str) -> WordTokenizer:
    """The worker's tokenizer for a file; reused by later tasks of the same worker."""
    if (path, kind) not in _OPEN:
        _OPEN[path, kind] = WordTokenizer(path, kind)
    return _OPEN[path, kind]


def public_path(name: str) -> str:
    """Where the public tokenizer file of this name is installed."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
