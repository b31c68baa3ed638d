"""Vector bin packing of token sequences: dot-product placement under three simultaneous limits.

An item asks for a vector of tokens, segments (always 1) and loss-bearing tokens; a sequence offers max_tokens,
max_segments and max_loss. A sequence is filled by taking, again and again, the item that fits in all three
dimensions and has the largest dot product of its demand with what is left, both in shares of the limits. Where
items may be cut (pre-training text), full-length pieces of long documents come first, the item that scores best
is cut to close the last gap, and a sequence that ends short is split at powers of two, which need no padding.
Where they may not (instruction data), a sequence closes when nothing fits.

Packing is a map over input partitions: no shuffle. A worker holds a pool of at most POOL items, so its memory
does not grow with the partition, and a task that is run again after a loss gives the same sequences, with the
same ids, because it reads the same rows in the same order.

Defined cases: null and empty texts are the end id alone; a null doc_id stays null; repeated rows are packed one
by one; an empty table gives no pieces; very long texts are cut into full sequences; columns of other names are
not read. An item over a limit that may not be cut raises an error.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from turnengine.llm.common import ship
from turnengine.llm.tokens import open_tokenizer

POOL = 512


@dataclass(frozen=True)
class Limits:
    max_tokens: int = 2048
    max_segments: int = 256
    max_loss: int = 2048


@dataclass
class Item:
    """A run of one document's tokens that is still to be placed."""

    key: object
    start: int
    length: int
    loss: int


@dataclass
class DotPacker:
    """Bounded pool of items and the sequences closed from it: lists of (item, offset)."""

    limits: Limits
    cut: bool
    slots: list[Item | None] = field(default_factory=lambda: [None] * POOL)
    n: int = 0

    def __post_init__(self) -> None:
        self.tokens = np.full(POOL, 1 << 30, np.int64)  # an empty slot never fits
        self.loss = np.zeros(POOL, np.int64)
        self.free = list(range(POOL - 1, -1, -1))

    def _loss(self, length: int) -> int:
        return length - 1  # within a piece, the first token has nothing before it to be predicted from

    def _put(self, item: Item) -> None:
        i = self.free.pop()
        self.slots[i], self.tokens[i], self.loss[i] = item, item.length, item.loss
        self.n += 1

    def _take(self, i: int) -> Item:
        item = self.slots[i]
        self.slots[i], self.tokens[i], self.loss[i] = None, 1 << 30, 0
        self.free.append(i)
        self.n -= 1
        return item

    def add(self, key: object, length: int, loss: int | None = None) -> Iterator[list[tuple[Item, int]]]:
        """Take in an item; yields the sequences that this closes."""
        size, start = self.limits.max_tokens, 0
        if self.cut:
            while length - start >= size and self._loss(size) <= self.limits.max_loss:
                yield [(Item(key, start, size, self._loss(size)), 0)]
                start += size
        elif length > size or (loss or 0) > self.limits.max_loss:
            raise ValueError(f"item {key!r} is over a limit and may not be cut")
        if start < length or not self.cut:
            if self.n == POOL:
                while self.n > POOL * 3 // 4:
                    yield from self._fill()
            rest = length - start
            self._put(Item(key, start, rest, self._loss(rest) if self.cut else loss or 0))

    def drain(self) -> Iterator[list[tuple[Item, int]]]:
        while self.n:
            yield from self._fill()

    def _fill(self) -> Iterator[list[tuple[Item, int]]]:
        caps = self.limits
        tokens, segments, loss = caps.max_tokens, caps.max_segments, caps.max_loss
        placed: list[tuple[Item, int]] = []
        while segments and tokens and self.n:
            score = self.tokens * (tokens / caps.max_tokens**2) + self.loss * (loss / max(1, caps.max_loss) ** 2)
            score[(self.tokens > tokens) | (self.loss > loss)] = -1.0
            best = int(score.argmax())
            if score[best] < 0:
                if not self.cut:
                    break
                room = min(tokens, loss + 1)
                best = int(np.where(self.tokens < 1 << 30, self.tokens, -1).argmax())
                if room < 1 or room >= self.tokens[best]:
                    break
                item = self._take(best)
                self._put(Item(item.key, item.start + room, item.length - room, self._loss(item.length - room)))
                item = Item(item.key, item.start, room, self._loss(room))
            else:
                item = self._take(best)
            placed.append((item, caps.max_tokens - tokens))
            tokens, segments, loss = tokens - item.length, segments - 1, loss - item.loss
        yield from self._close(placed)

    def _close(self, placed: list[tuple[Item, int]]) -> Iterator[list[tuple[Item, int]]]:
        """A full sequence as it is; a short one, where cuts are allowed, as sequences of powers of two."""
        total = sum(item.length for item, _ in placed)
        if not self.cut or total == self.limits.max_tokens:
            yield placed
            return
        parts, k = [i for i, _ in placed], 0
        for bit in range(total.bit_length() - 1, -1, -1):
            size, offset, sequence = 1 << bit, 0, []
            if not total & size:
                continue
            while offset < size:
                item = parts[k]
                n = min(item.length, size - offset)
                sequence.append((Item(item.key, item.start, n, self._loss(n)), offset))
                parts[k] = Item(item.key, item.start + n, item.length - n, self._loss(item.length - n))
                k += n == item.length
                offset += n
            yield sequence


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"


def pack_documents(docs: DataFrame, tokenizer_path: str, kind: str = "bare", end_id: int = 1, limits: Limits | None = None) -> DataFrame:
    """Tokenise every whole text, append end_id, and pack all ids; one row per piece.

    sequence_id is the partition number times 2**32 plus the sequence's number in it.
    """
    ship(docs.sparkSession)
    limits = limits or Limits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = open_tokenizer(tokenizer_path, kind), np.uint32(end_id).tobytes()
        packer, sequence = DotPacker(limits, cut=True), TaskContext.get().partitionId() << 32
        out: list[tuple] = []

        def rows(closed: Iterator[list[tuple[Item, int]]]) -> None:
            nonlocal sequence
            for placed in closed:
                for item, offset in placed:
                    doc_id, ids, base, total = item.key
                    at = 4 * (item.start - base)
                    out.append((doc_id, item.start, item.length, zlib.crc32(ids[at : at + 4 * item.length]), total, sequence, offset, item.loss))
                sequence += 1

        def flush() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[c.split()[0] for c in PIECES.split(", ")])
            out.clear()
            return done

        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for doc_id, ids in zip(part.column(0).to_pylist(), tokenizer.encode(part.column(1).to_pylist()), strict=True):
                    ids += end
                    total = len(ids) // 4
                    # only the tail that goes to the pool is held on to; full pieces are cut off at once
                    whole = total - total % limits.max_tokens if limits.max_loss >= limits.max_tokens - 1 else 0
                    for start in range(0, whole, limits.max_tokens):
                        rows(iter([[(Item((doc_id, ids, 0, total), start, limits.max_tokens, limits.max_tokens - 1), 0)]]))
                    if whole < total:
                        tail = (doc_id, bytes(memoryview(ids)[4 * whole :]), whole, total)
                        for closed in packer.add(tail, total - whole):
                            rows(iter([_shift(closed)]))
                if len(out) >= 8192:
                    yield flush()
        for closed in packer.drain():
            rows(iter([_shift(closed)]))
        if out:
            yield flush()

    return docs.select("doc_id", "text").mapInArrow(run, PIECES)


def _shift(placed: list[tuple[Item, int]]) -> list[tuple[Item, int]]:
    """Starts in the tail as starts in the document."""
    return [(Item(i.key, i.start + i.key[2], i.length, i.loss), offset) for i, offset in placed]


def pack_examples(examples: DataFrame, limits: Limits, key: str = "example_id", tokens: str = "n_tokens", loss: str = "loss_tokens") -> DataFrame:
    """Whole instruction examples (key long, tokens and loss counts) placed uncut; one row per example.

    Null counts are 0. The result has key, sequence_id, offset.
    """
    ship(examples.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, sequence = DotPacker(limits, cut=False), TaskContext.get().partitionId() << 32

        def rows(closed: Iterator[list[tuple[Item, int]]]) -> Iterator[tuple]:
            nonlocal sequence
            for placed in closed:
                yield from ((item.key, sequence, offset) for item, offset in placed)
                sequence += 1

        def batch_of(out: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=[key, "sequence_id", "offset"])

        for batch in batches:
            out = [r for k, n, m in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True) for r in rows(packer.add(k, n or 0, m or 0))]
            if out:
                yield batch_of(out)
        if out := list(rows(packer.drain())):
            yield batch_of(out)

    return examples.select(key, tokens, loss).mapInArrow(run, f"{key} long, sequence_id long, offset long")
