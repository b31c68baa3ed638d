"""Splittable reading of files whose records hold their own separators: JSON arrays, and CSV with line breaks in quotes.

Spark's text source cuts such a file into splits, and each split into pieces at a byte that ends every record, though not
only records: "}" for JSON, a line feed for CSV. Whether a piece ends a record depends on all before it, but only
through a small state: within quotes or not, and for JSON the nesting depth. So reading takes two passes:

1. Every split is scanned in parallel for its effect on the state: where it leaves either start ("in quotes" or not), and
   by how much the depth changes. The effects, one row a split, are composed in file order on the driver (a prefix scan over
   some hundred bytes per split of spark.sql.files.maxPartitionBytes), which gives every split the state it starts in.
2. Every split is scanned again, now knowing its state, and gives its records whole. A record that goes on into later
   splits gives fragments; only those are shuffled, by the split the record began in, and put together.

So a file is read by as many tasks as it has splits, no task holds more than a batch and the record it is in, and text moves
between tasks only at the borders of splits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnengine.schema import EngineError
from turnengine.shipping import ship

#: Pieces worked on at once.
PIECES = 4096
#: Records of a split, at most.
_ROOM = 1 << 33


@dataclass
class Scan:
    """Of some pieces: where each leaves the states 0 (outside of quotes) and 1 (within) [piece, state], and by how much
    it changes the depth from either [piece, state]."""

    to: np.ndarray
    depth: np.ndarray

    def states(self, start: int) -> np.ndarray:
        """The state before each piece, and after the last."""
        out = np.empty(len(self.to) + 1, np.int8)
        at, now = 0, start
        for i in np.flatnonzero((self.to[:, 0] != 0) | (self.to[:, 1] != 1)).tolist():  # pieces that change the state
            out[at : i + 1] = now
            at, now = i + 1, int(self.to[i, now])
        out[at:] = now
        return out

    def follow(self, start: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(state, depth) after each piece."""
        states = self.states(start)
        return states[1:], depth + np.cumsum(self.depth[np.arange(len(self.depth)), states[:-1]])


def _bytes(pieces: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(the bytes of all pieces, where each begins and the last ends)."""
    raw = [b"" if p is None else p for p in pieces.cast(pa.binary()).to_pylist()]
    return np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])


class JsonPieces:
    """Pieces of JSON that "}" ends."""

    separator = "}"

    def scan(self, pieces: pa.Array) -> Scan:
        b, at = _bytes(pieces)
        place = np.arange(len(b))
        # a quote is escaped if an odd number of backslashes stands before it
        plain = np.maximum.accumulate(np.where(b != 92, place, -1)) if len(b) else place
        quote = np.flatnonzero(b == 34)
        run = np.where(quote > 0, quote - 1 - plain[quote - 1], 0)
        quote = quote[run % 2 == 0]
        is_quote = np.zeros(len(b), np.int64)
        is_quote[quote] = 1
        before = np.concatenate([[0], np.cumsum(is_quote)])  # quotes before each byte
        piece = np.repeat(np.arange(len(at) - 1), np.diff(at))
        within = (before[:-1] - before[at[:-1]][piece]) % 2  # in quotes, if the piece starts outside
        step = ((b == 123) | (b == 91)).astype(np.int64) - ((b == 125) | (b == 93))
        odd = (before[at[1:]] - before[at[:-1]]) % 2
        depth = np.stack([np.bincount(piece[within == k], step[within == k], len(odd)) for k in (0, 1)], axis=1).astype(np.int64)
        depth[np.arange(len(odd)), odd] -= 1  # the separator closes something if it is outside of quotes
        return Scan(np.stack([odd, 1 - odd], axis=1).astype(np.int8), depth)

    def base(self, first: str) -> int:
        """The depth between records."""
        return 1 if first == "[" else 0

    def ends_well(self, state: int, depth: int, base: int) -> bool:
        """Whether a file may end so. What follows its last "}" counts as a piece, so the depth is one less there."""
        return state == 0 and (depth == -1 or depth == base == 0)

    def join(self, pieces: list[str]) -> str:
        return "".join(p + "}" for p in pieces)

    glue = ""

    def record(self, text: Column) -> Column:
        """A record without what stands before it; null if there is none."""
        found = F.when(text.rlike(r"^[\s,\[\x{FEFF}]*\{"), F.regexp_replace(text, r"^[^{]*", ""))
        blank = F.when(~text.rlike(r"^[\s,\[\]}\x{FEFF}]*$"), F.raise_error(F.concat(F.lit("a list of objects is expected, not "), F.substring(text, 1, 80))))
        return F.coalesce(found, blank.cast("string"))


_FIELD = r'(?:"(?:[^"]|"")*+"[^,"]*+|[^",][^,]*+|)'
_CLOSED = re.compile(rf"{_FIELD}(?:,{_FIELD})*+")
_REOPENED = re.compile(rf'(?:[^"]|"")*+"[^,"]*+(?:,{_FIELD})*+')


class CsvPieces:
    """Lines of CSV that a line feed ends; quotes are doubled within quotes."""

    separator = "\n"

    def scan(self, pieces: pa.Array) -> Scan:
        to = np.tile(np.array([0, 1], np.int8), (len(pieces), 1))
        for i, line in enumerate(pieces.to_pylist()):
            if line and '"' in line:
                bare = line.removesuffix("\r").lstrip("﻿")
                to[i] = (0 if _CLOSED.fullmatch(bare) else 1, 0 if _REOPENED.fullmatch(bare) else 1)
        return Scan(to, np.zeros((len(pieces), 2), np.int64))

    def base(self, first: str) -> int:
        return 0

    def ends_well(self, state: int, depth: int, base: int) -> bool:
        return True

    def join(self, pieces: list[str]) -> str:
        return "\n".join(pieces)

    glue = "\n"

    def record(self, text: Column) -> Column:
        return F.nullif(F.regexp_replace(text, r"^\x{FEFF}|\r$", ""), F.lit(""))


def _pieces(spark: SparkSession, path: str, kind: JsonPieces | CsvPieces) -> DataFrame:
    return spark.read.text(path, lineSep=kind.separator).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[str, int], pa.Array]]:
    """Pieces with the split they are of, in order, PIECES at most at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, PIECES):
            part = batch.slice(at, PIECES)
            keys = list(zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True))
            cut = 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[cut]:
                    yield keys[cut], part.column(0).slice(cut, i - cut)
                    cut = i


@dataclass(frozen=True)
class Split:
    """What a split starts with: its rank among all, whether it is a file's first, the state and depth, whether within a
    record and of which split, and the depth between records."""

    rank: int
    first: bool
    state: int
    depth: int
    open: bool
    owner: int
    base: int


_EFFECT = "path string, start long, first string, to0 int, to1 int, depth0 long, depth1 long, least0 long, least1 long, pieces long"


def split_starts(spark: SparkSession, path: str, kind: JsonPieces | CsvPieces) -> dict[tuple[str, int], Split]:
    """The first pass, and the composition of its effects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, told = None, None

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([v]) for v in (*key, *told)], schema=schema)

        schema = pa.schema([(n, {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[t]) for n, t in (c.split() for c in _EFFECT.split(", "))])
        for of, pieces in _runs(batches):
            if of != key:
                if key is not None:
                    yield row()
                key, told = of, [pieces[0].as_py().lstrip("﻿ \t\r\n")[:1], 0, 1, 0, 0, None, None, 0]
            scan = kind.scan(pieces)
            for k in (0, 1):
                state, depth = scan.follow(told[1 + k], told[3 + k])
                outside = depth[state == 0]
                if len(outside):  # the least depth at which a piece ends outside of quotes
                    told[5 + k] = int(outside.min()) if told[5 + k] is None else min(told[5 + k], int(outside.min()))
                told[1 + k], told[3 + k] = int(state[-1]), int(depth[-1])
            told[7] += len(pieces)
        if key is not None:
            yield row()

    starts: dict[tuple[str, int], Split] = {}
    now, state, depth, owner, base, is_open = None, 0, 0, 0, 0, False

    def end() -> None:
        if now is not None and not kind.ends_well(state, depth, base):
            raise EngineError(f"{now} is cut off")

    for rank, r in enumerate(_pieces(spark, path, kind).mapInArrow(run, _EFFECT).orderBy("path", "start").toLocalIterator()):  # one row per split
        if fresh := r["path"] != now:
            end()
            now, state, depth, owner, base, is_open = r["path"], 0, 0, rank, kind.base(r["first"]), False
        starts[now, r["start"]] = Split(rank, fresh, state, depth, is_open, owner if is_open else rank, base)
        least = r[f"least{state}"]
        if not is_open or (least is not None and depth + least <= base):
            owner = rank
        state, depth = r[f"to{state}"], depth + r[f"depth{state}"]
        is_open = (state, depth) != (0, base)
    end()
    return starts


#: text of whole records, fragment of others: Spark may parse a column before it filters by another, so no fragment stands in text.
_RECORD = "rank long, nth long, part long, whole boolean, first boolean, text string, fragment string"
_TYPES = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string(), pa.string())


def read_records(spark: SparkSession, path: str, kind: JsonPieces | CsvPieces, skip_first: bool = False) -> DataFrame:
    """(ord, record) of every record of the files of a path; ord rises in file order. skip_first: without each file's first."""
    ship(spark)
    starts = spark.sparkContext.broadcast(split_starts(spark, path, kind))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, split, head = None, None, False  # head: what is held began in an earlier split
        state = depth = nth = 0
        held: list[str] = []
        out: list[tuple] = []

        def leave(whole: bool) -> None:
            """What is held is a record, or a fragment of one."""
            nonlocal nth, head
            if head:
                out.append((split.owner, None, split.rank, False, False, None, kind.join(held)))
            else:
                out.append((split.rank, nth, split.rank, whole, split.first and nth == 0, *((kind.join(held), None) if whole else (None, kind.join(held)))))
                nth += 1
            head = False
            held.clear()

        def flush() -> pa.RecordBatch:
            rows = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _TYPES, strict=True)], names=[c.split()[0] for c in _RECORD.split(", ")])
            out.clear()
            return rows

        for of, pieces in _runs(batches):
            if of != key:
                if held:
                    leave(False)
                key, split = of, starts.value[of]
                state, depth, nth, head = split.state, split.depth, 0, split.open
            states, depths = kind.scan(pieces).follow(state, depth)
            texts, last = pieces.to_pylist(), 0
            for i in np.flatnonzero((states == 0) & (depths == split.base)).tolist():
                held += texts[last : i + 1]
                leave(True)
                last = i + 1
            held += texts[last:]
            state, depth = int(states[-1]), int(depths[-1])
            if out:
                yield flush()
        if held:
            leave(False)
        if out:
            yield flush()

    rows = _pieces(spark, path, kind).mapInArrow(run, _RECORD)
    order = F.col("rank") * F.lit(_ROOM)
    whole = rows.where("whole").select((order + F.col("nth")).alias("ord"), "first", "text")
    parts = F.array_sort(F.collect_list(F.struct("part", "fragment")))  # the splits of one record
    glued = rows.where("not whole").groupBy("rank").agg(F.max("nth").alias("nth"), F.bool_or("first").alias("first"), parts.alias("parts"))
    glued = glued.select((order + F.col("nth")).alias("ord"), "first", F.array_join(F.transform("parts", lambda p: p["fragment"]), kind.glue).alias("text"))
    every = whole.unionByName(glued)
    every = every.where("not first") if skip_first else every
    return every.select("ord", kind.record(F.col("text")).alias("record")).where("record is not null")
