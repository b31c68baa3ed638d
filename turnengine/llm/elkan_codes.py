"""Product codes of vectors: one codebook per part, fitted by Lloyd's rounds with Elkan's bounds, in exact integers.

Components become integers floor(SCALE * x) and vectors are cut into PARTS equal parts. A part's codebook starts as that
part of the ENTRIES smallest vec_ids. A round assigns every part to its nearest entry (squared Euclidean distance, ties
to the lower index) and moves every entry to the floor of its parts' mean; entries that nothing chose stay.

Elkan's bounds: for every part a row keeps its entry, an upper bound of the distance to it, and a lower bound of the
distance to each entry. When entries move, the upper bound grows and the lower bounds shrink by how far their entries
moved. An entry is left out only if its lower bound, or half its distance from the part's entry, is strictly above the
upper bound; then it is strictly farther, so ties are never pruned. What is left is compared by integer distances,
which also renew the bounds. Bounds are 32-bit floats rounded to the safe side, as is all arithmetic on them.

Scale: rows, assignments and bounds are a Parquet table per round in the shared folder (some 600 bytes a row besides the
vector; the table of the round before is deleted), so a lost executor costs the tasks it had, and a task reads its rows once
and holds a slice of them. Every task adds one row with the sums and counts of its parts to that table; those rows are
added up by Spark per component, so the driver gets PARTS * ENTRIES * (width + 1) numbers, whatever the table's size. The only
shuffles are those sums, the smallest vec_ids, and the errors per label, which are summed before they are joined back.

Defined cases: null vectors and vectors with null or non-finite components are dropped; vectors shorter than the longest
or than a multiple of PARTS are filled up with zeros; a repeated vec_id starts one entry, by its least vector, and null
vec_ids come last; fewer vec_ids than ENTRIES give as many entries; rows that repeat are rows each; an empty table gives
no rows; further columns are not read. Vectors whose squared distances could pass 64 bits raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnengine.llm.common import drop_materialized, materialize, ship
from turnengine.llm.vectors import finite, matrix

SCALE, PARTS, ENTRIES, ROUNDS = 4096, 8, 16, 6
#: Rows worked on at once.
SLICE = 2048


def _up(x: np.ndarray) -> np.ndarray:
    """32-bit floats that are not below x."""
    return np.nextafter(np.nextafter(x.astype(np.float32), np.float32(np.inf)), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    """32-bit floats from zero on that are not above x, which is not negative."""
    return np.maximum(np.nextafter(np.nextafter(np.maximum(x, 0).astype(np.float32), np.float32(0)), np.float32(0)), np.float32(0))


def squared(x: np.ndarray, books: np.ndarray) -> np.ndarray:
    """Squared distances [row, part, entry] of parts [row, part, position] to all entries of their codebooks."""
    return np.stack([((x[:, :, None, :] - books[None, :, j : j + 1, :]) ** 2).sum(axis=3)[:, :, 0] for j in range(books.shape[1])], axis=2)


@dataclass
class Bounds:
    """Of some rows: entry [row, part], upper bound [row, part], lower bounds [row, part, entry]."""

    entry: np.ndarray
    upper: np.ndarray
    lower: np.ndarray


def first_bounds(x: np.ndarray, books: np.ndarray) -> tuple[Bounds, int]:
    """Bounds from all distances, and how many those are."""
    d = squared(x, books)
    root = np.sqrt(d)
    entry = d.argmin(axis=2)  # the first of equals
    return Bounds(entry.astype(np.uint8), _up(np.take_along_axis(root, entry[:, :, None], 2)[:, :, 0]), _down(root)), d.size


def moved(old: np.ndarray, new: np.ndarray) -> np.ndarray:
    """How far each entry [part, entry] moved, rounded up."""
    return np.sqrt(((new - old) ** 2).sum(axis=2)) * (1 + 1e-12)


def shift(b: Bounds, by: np.ndarray) -> None:
    """Loosen bounds by the movement of their entries."""
    part = np.arange(by.shape[0])[None]
    b.upper = _up(b.upper.astype(np.float64) + by[part, b.entry])
    b.lower = _down(b.lower.astype(np.float64) - by[None])


def half_gaps(books: np.ndarray) -> np.ndarray:
    """Half the distance of every two entries of a part, rounded down; an entry and itself are infinitely far."""
    half = np.sqrt(squared(books.transpose(1, 0, 2), books).transpose(1, 0, 2)) * (0.5 * (1 - 1e-12))
    half[:, np.arange(half.shape[1]), np.arange(half.shape[1])] = np.inf
    return half


def reassign(x: np.ndarray, b: Bounds, books: np.ndarray, half: np.ndarray) -> int:
    """Nearest entries under books, whose movement the bounds have; the distances evaluated."""
    part = np.broadcast_to(np.arange(x.shape[1]), b.entry.shape)
    nearest = half.min(axis=2)[part, b.entry]
    row, p = np.nonzero(nearest <= b.upper)
    own = b.entry[row, p].astype(np.int64)
    open_ = (b.lower[row, p] <= b.upper[row, p, None]) & (half[p, own] <= b.upper[row, p, None])
    some = open_.any(axis=1)
    row, p, own, open_ = row[some], p[some], own[some], open_[some]
    best = ((x[row, p] - books[p, own]) ** 2).sum(axis=1)
    tight = _up(np.sqrt(best))
    b.lower[row, p, own] = _down(np.sqrt(best))
    open_ &= (b.lower[row, p] <= tight[:, None]) & (half[p, own] <= tight[:, None])
    evaluated, chosen = len(row), own.copy()
    at, entry = np.nonzero(open_)
    d = ((x[row[at], p[at]] - books[p[at], entry]) ** 2).sum(axis=1)
    evaluated += len(d)
    b.lower[row[at], p[at], entry] = _down(np.sqrt(d))
    # the least (distance, index) of each part's candidates: sort them, and take the first of each part
    order = np.lexsort((entry, d, at))
    first = order[np.r_[True, at[order][1:] != at[order][:-1]]] if len(order) else order
    to, d, entry = at[first], d[first], entry[first]
    wins = (d < best[to]) | ((d == best[to]) & (entry < own[to]))
    chosen[to[wins]], best[to[wins]] = entry[wins], d[wins]
    b.entry[row, p] = chosen
    b.upper[row, p] = _up(np.sqrt(best))
    return evaluated


@dataclass
class Codebooks:
    """Entries [part, entry, position], and for every round the share of distances that were evaluated."""

    books: np.ndarray
    shares: list[float] = field(default_factory=list)

    @property
    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.books.ravel().tolist())).encode()).hexdigest()


def _integers(embeddings: DataFrame) -> DataFrame:
    """vec_id, label and x of the rows that are kept."""
    x = F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE))
    return embeddings.where(finite(F.col("embedding"))).select("vec_id", "label", x.alias("x"))


def _start(rows: DataFrame, width: int) -> np.ndarray:
    """The parts of the smallest vec_ids [part, entry, position]."""
    ids = [r[0] for r in rows.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(ENTRIES).collect()]
    chosen = F.col("vec_id").isin([i for i in ids if i is not None]) | (F.col("vec_id").isNull() if None in ids else F.lit(False))
    vectors = {r["vec_id"]: r["x"] for r in rows.where(chosen).groupBy("vec_id").agg(F.min("x").alias("x")).collect()}  # ENTRIES rows at most
    filled = np.array([list(vectors[i]) + [0] * (width - len(vectors[i])) for i in ids], np.int64)
    return filled.reshape(len(ids), PARTS, -1).transpose(1, 0, 2)


_STATE = ["vec_id", "label", "x", "entry", "upper", "lower", "sums", "counts", "evaluated"]


def _fixed(column: pa.Array, dtype: str, *shape: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(len(column), *shape)


def _bytes(rows: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(rows).reshape(len(rows), -1)
    return pa.array([r.tobytes() for r in flat], pa.binary())


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, SLICE) for batch in batches for at in range(0, batch.num_rows, SLICE))


def _read_state(part: pa.RecordBatch, parts: int, entries: int) -> tuple[np.ndarray, Bounds]:
    x = _fixed(part.column(2), "<i4", parts, -1).astype(np.int64)
    return x, Bounds(_fixed(part.column(3), "u1", parts).copy(), _fixed(part.column(4), "<f4", parts).copy(), _fixed(part.column(5), "<f4", parts, entries).copy())


def _round(state: DataFrame, books: np.ndarray, before: np.ndarray | None) -> DataFrame:
    """The table of a round: rows with their new assignments and bounds, and a row of sums per task.

    before: the codebooks that the table's bounds are about; None for integer vectors without bounds.
    """
    parts, entries, long = books.shape
    half, by = half_gaps(books), None if before is None else moved(before, books)
    label = state.schema["label"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts, evaluated, label_type = np.zeros((parts, entries, long), np.int64), np.zeros((parts, entries), np.int64), 0, None
        for piece in _slices(batches):
            label_type = piece.column(1).type
            if by is None:
                x = matrix(piece.column(2), parts * long).astype(np.int64).reshape(-1, parts, long)
                b, n = first_bounds(x, books)
            else:
                x, b = _read_state(piece, parts, entries)
                shift(b, by)
                n = reassign(x, b, books, half)
            evaluated += n
            for p in range(parts):
                np.add.at(sums[p], b.entry[:, p], x[:, p])
                counts[p] += np.bincount(b.entry[:, p], minlength=entries)
            none = pa.nulls(len(x), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([piece.column(0).cast(pa.int64()), piece.column(1), _bytes(x.astype("<i4")), _bytes(b.entry), _bytes(b.upper.astype("<f4")), _bytes(b.lower.astype("<f4")), none, none, pa.nulls(len(x), pa.int64())], names=_STATE)
        if label_type is not None:
            empty = [pa.nulls(1, pa.int64()), pa.nulls(1, label_type), *(pa.nulls(1, pa.binary()) for _ in range(4))]
            yield pa.RecordBatch.from_arrays([*empty, *(pa.array([a.ravel().tolist()], pa.list_(pa.int64())) for a in (sums, counts)), pa.array([evaluated], pa.int64())], names=_STATE)

    source = state.where("counts is null") if "counts" in state.columns else state
    return source.mapInArrow(run, f"vec_id long, label {label}, x binary, entry binary, upper binary, lower binary, sums array<long>, counts array<long>, evaluated long")


def _next_books(state: DataFrame, books: np.ndarray) -> tuple[np.ndarray, float]:
    """The codebooks that a round's table gives, and the share of distances it evaluated."""
    told = state.where("counts is not null")
    of = {name: {r["pos"]: r["n"] for r in told.select(F.posexplode(name).alias("pos", "n")).groupBy("pos").agg(F.sum("n").alias("n")).collect()} for name in ("sums", "counts")}  # as many rows as the codebooks have numbers
    sums, counts = (np.array([of[name].get(i, 0) for i in range(n)], np.int64) for name, n in (("sums", books.size), ("counts", books.shape[0] * books.shape[1])))
    counts = counts.reshape(books.shape[:2])
    new = np.where(counts[:, :, None] > 0, sums.reshape(books.shape) // np.maximum(counts, 1)[:, :, None], books)
    every = int(counts.sum()) * books.shape[1]
    return new, told.agg(F.sum("evaluated").alias("n")).first()["n"] / max(every, 1)


def fit_codes(embeddings: DataFrame, rounds: int = ROUNDS) -> tuple[Codebooks, DataFrame | None, np.ndarray | None]:
    """(codebooks, the last round's table, the codebooks its bounds are about); the last two None for no rows."""
    ship(embeddings.sparkSession)
    rows = _integers(embeddings)
    range_ = rows.agg(F.max(F.size("x")).alias("width"), F.max(F.array_max("x")).alias("high"), F.min(F.array_min("x")).alias("low")).first()
    if range_["width"] is None:
        return Codebooks(np.zeros((PARTS, 0, 0), np.int64)), None, None
    most = max(range_["high"] or 0, -(range_["low"] or 0))
    if most >= 1 << 31 or 4 * most * most * range_["width"] >= 1 << 63:
        raise ValueError("squared distances would pass 64 bits")
    books = _start(rows, max(PARTS, -(-range_["width"] // PARTS) * PARTS))
    state, before, shares = rows, None, []
    for _ in range(rounds):
        done = materialize(_round(state, books, before), "codes-round")
        drop_materialized(state)
        state, before = done, books
        books, share = _next_books(state, books)
        shares.append(share)
    return Codebooks(books, shares), state, before


def product_codes(embeddings: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of every row that is kept."""
    spark = embeddings.sparkSession
    model, state, before = fit_codes(embeddings, rounds)
    if state is None:
        return spark.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    books = model.books
    parts, entries, _ = books.shape
    half, by = half_gaps(books), moved(before, books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in _slices(batches):
            x, b = _read_state(piece, parts, entries)
            shift(b, by)
            reassign(x, b, books, half)
            error = ((x - books[np.arange(parts)[None], b.entry]) ** 2).sum(axis=(1, 2))
            yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array([r.tobytes().hex() for r in b.entry], pa.string()), pa.array(error)], names=["vec_id", "label", "code", "error"])

    coded = materialize(state.where("counts is null").mapInArrow(run, f"vec_id long, label {state.schema['label'].dataType.simpleString()}, code string, error long"), "codes")
    drop_materialized(state)
    # one row per label, written so that Spark knows its size: it is broadcast only if small, and a hot label is split otherwise
    totals = materialize(coded.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error")), "codes-labels")
    return coded.join(totals, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "code", "error", "label_error", F.lit(model.sha256).alias("codebooks_sha256"))
