"""Exact top-k by inner product with pivot-table elimination.

Every vector becomes integers floor(SCALE * x) and gets a row of the pivot table: its distances to PIVOTS fixed
vectors, computed once. For a query q and a candidate x, |d(q, p) - d(x, p)| never exceeds d(q, x), so the largest
such gap over all pivots bounds d(q, x) from below and the inner product (|q|^2 + |x|^2 - d^2) / 2 from above. The
origin is a pivot too; the others are taken farthest first from a bounded sample.

The bound eliminates twice. Candidates lie in regions, by their nearest pivot, and the table knows the range of every
pivot's distances in every region; so one comparison bounds a whole region. A query first searches one block of the
region with the best bound, which gives it a k-th score to beat. Then it goes to the blocks of those regions alone
whose bound reaches that score; there candidates are bounded one by one and evaluated in the order of their bounds
until the next bound is below the k-th score: the rest cannot enter, so the result is exact.

Scale: a region is dealt into blocks of about CANDIDATES vectors, so a hot region is many blocks. A candidate travels
once per QUERIES queries that reach its block, and not at all to a search whose bound keeps the block out; a query
travels once per block it reaches. A task holds one block and streams the queries past it. The driver and the tasks'
closures get the pivots and the ranges: PIVOTS rows and PIVOTS ** 2 pairs of numbers, whatever the table's size. Where
nothing can be eliminated, as among random directions in many dimensions, every query reaches every block.

Defined cases: rows without vec_id, and vectors that are null or hold null or non-finite components take no part;
shorter and empty vectors count as filled up with zeros; ties go to the smaller vec_id; a row is known by its vec_id, so
a query never meets rows of its own vec_id, and a query row that repeats is asked once; repeated candidates are
candidates each; fewer candidates than k give all; an empty table gives no rows; extra columns are not read. A score beyond
64 bits raises an error.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnengine.llm.common import drop_materialized, materialize, ship
from turnengine.llm.vectors import finite, matrix

SCALE, QUERY_EVERY, K = 1024, 100, 10
#: Pivots, and rows of the sample they are chosen from.
PIVOTS, SAMPLE = 64, 4096
#: Vectors of a block, queries that share one passage of a block, candidates evaluated at a time.
CANDIDATES, QUERIES, STEP = 1024, 8192, 128
#: Products of integers up to here add up exactly in doubles, for up to 2**13 components.
_EXACT = 1 << 20
FOUND = "query_id long, vec_id long, score long, evaluated long"


def integers(vectors: np.ndarray) -> np.ndarray:
    return np.floor(vectors * SCALE)


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """The origin, and rows of the sample, each the farthest from those before it."""
    chosen = [np.zeros(sample.shape[1])]
    far = (sample * sample).sum(axis=1)
    while len(chosen) < n and len(far) and far.max() > 0:
        chosen.append(sample[int(far.argmax())])
        far = np.minimum(far, ((sample - chosen[-1]) ** 2).sum(axis=1))
    return np.array(chosen)


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of every row to every pivot."""
    out = np.empty((len(x), len(pivots)))
    for at in range(0, len(x), 256):
        out[at : at + 256] = np.sqrt(((x[at : at + 256, None, :] - pivots[None]) ** 2).sum(axis=2))
    return out


def upper(q_gap: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Bounds from above of the inner products of queries (rows of q_gap) with all vectors of each region.

    low and high: the least and largest distance to each pivot [region, pivot]; pivot 0 is the origin, so its distances
    are the lengths.
    """
    gap = np.maximum(np.maximum(low[None] - q_gap[:, None], q_gap[:, None] - high[None]), 0).max(axis=2)
    q, x = q_gap[:, :1], high[None, :, 0]
    return np.minimum((q * q + x * x - gap * gap) / 2, q * x) + _slack(q * q + x * x)


def _slack(squares: np.ndarray) -> np.ndarray:
    """More than rounding can take away from a bound."""
    return 1e-6 * (squares + 1)


def search(q: np.ndarray, q_gap: np.ndarray, ids: np.ndarray, x: np.ndarray, gaps: np.ndarray, own: int, k: int, floor: float = -np.inf) -> tuple[list[tuple[int, int]], int]:
    """The k best (score, vec_id) of candidates other than own that may reach floor, and how many were evaluated.

    gaps and q_gap are rows of the pivot table.
    """
    squares = q_gap[0] ** 2 + gaps[:, 0] ** 2
    low = np.abs(gaps - q_gap).max(axis=1)
    bound = (squares - low * low) / 2 + _slack(squares)
    order = np.flatnonzero(bound >= floor)
    order = order[np.argsort(-bound[order], kind="stable")]
    exact = max(np.abs(q).max(initial=0), np.abs(x).max(initial=0)) < _EXACT
    best: list[tuple[int, int]] = []
    done = 0
    for at in range(0, len(order), STEP):
        part = order[at : at + STEP]
        if len(best) == k and bound[part[0]] < -best[-1][0]:
            break
        part = part[ids[part] != own]
        done += len(part)
        if exact:
            scores = (x[part] @ q).astype(np.int64).tolist()
        else:
            scores = [sum(int(a) * int(b) for a, b in zip(row, q, strict=True)) for row in x[part]]
        best = sorted(best + [(-s, i) for s, i in zip(scores, ids[part].tolist(), strict=True)])[:k]
    return [(-s, i) for s, i in best], done


def _ranges(table: DataFrame) -> tuple[dict[int, int], np.ndarray, np.ndarray]:
    """(vectors of each region, least and largest distance to each pivot [region, pivot]); PIVOTS ** 2 rows at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            region, gap = batch.column(0).to_numpy(), matrix(batch.column(1))
            for r in np.unique(region).tolist():
                own = gap[region == r]
                n, low, high = held.get(r, (0, np.inf, -np.inf))
                held[r] = [n + len(own), np.minimum(low, own.min(axis=0)), np.maximum(high, own.max(axis=0))]
        rows = [(r, p, n, float(low[p]), float(high[p])) for r, (n, low, high) in held.items() for p in range(len(low))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], names=["region", "pivot", "n", "low", "high"])

    parts = table.select("region", "gap").mapInArrow(run, "region long, pivot long, n long, low double, high double")
    rows = parts.groupBy("region", "pivot").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).collect()
    counts = {r["region"]: r["n"] for r in rows}
    place = {r: i for i, r in enumerate(sorted(counts))}
    low, high = (np.zeros((len(place), max((r["pivot"] for r in rows), default=0) + 1)) for _ in range(2))
    for r in rows:
        low[place[r["region"]], r["pivot"]], high[place[r["region"]], r["pivot"]] = r["low"], r["high"]
    return dict(sorted(counts.items())), low, high


def _meet(candidates: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """FOUND rows: the k best of every query in every block it goes to, and one row (null vec_id) with its evaluations.

    candidates: block, vec_id, x, gap. asked: those, and floor.
    """
    reached = asked.groupBy("block").agg(F.count("*").alias("n")).select("block", F.ceil(F.col("n") / F.lit(QUERIES)).cast("int").alias("chunks"))
    stay = candidates.join(reached, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(False).alias("asks"), "vec_id", "x", "gap", F.lit(0.0).alias("floor"))
    come = asked.join(reached, "block").select("block", F.pmod(F.xxhash64("vec_id", F.lit("q")), F.col("chunks")).cast("int").alias("chunk"), F.lit(True).alias("asks"), "vec_id", "x", "gap", "floor")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for batch in batches:
            keys = np.column_stack([batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)])
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                part = batch.slice(a, b - a)
                if key != tuple(keys[a, :2]):
                    key, held, block = tuple(keys[a, :2]), [], None
                if not keys[a, 2]:
                    held.append(part)
                    continue
                if block is None:
                    rows = pa.Table.from_batches(held) if held else part.slice(0, 0)
                    block = [rows.column(3).to_numpy(), matrix(rows.column(4)), matrix(rows.column(5))]
                    held = []
                ids, x, gap, floor = part.column(3).to_numpy(), matrix(part.column(4)), matrix(part.column(5)), part.column(6).to_numpy()
                out: list[tuple] = []
                for i in range(len(ids)):
                    found, done = search(x[i], gap[i], *block, int(ids[i]), k, floor[i]) if len(block[0]) else ([], 0)
                    out += [(int(ids[i]), v, s, None) for s, v in found] + [(int(ids[i]), None, None, done)]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["query_id", "vec_id", "score", "evaluated"])

    return stay.union(come).repartition("block", "chunk").sortWithinPartitions("block", "chunk", "asks").mapInArrow(run, FOUND)


def searched(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """FOUND rows of every query, written to the shared folder: its best candidates by block, and its evaluations."""
    ship(vectors.sparkSession)
    usable = vectors.where(F.col("vec_id").isNotNull() & finite(F.col("embedding"))).select(F.col("vec_id").cast("bigint").alias("vec_id"), "embedding")
    sample = matrix(usable.orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(SAMPLE).select("embedding").toArrow().column(0))  # SAMPLE rows
    width = int(usable.agg(F.greatest(F.coalesce(F.max(F.size("embedding")), F.lit(1)), F.lit(1)).alias("width")).first()["width"])
    pivots = choose_pivots(integers(np.pad(sample, ((0, 0), (0, width - sample.shape[1])))), PIVOTS)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = integers(matrix(batch.column(1), width))
            gap = distances(x, pivots)
            region = pa.array(gap.argmin(axis=1).astype(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), region, pa.array(list(x), pa.list_(pa.float64())), pa.array(list(gap), pa.list_(pa.float64()))], names=["vec_id", "region", "x", "gap"])

    table = materialize(usable.mapInArrow(measure, "vec_id long, region long, x array<double>, gap array<double>"), "pivot-table")
    counts, low, high = _ranges(table)
    blocks = [-(-n // CANDIDATES) for n in counts.values()]
    base = np.cumsum([0, *blocks]).tolist()
    place = F.create_map(*[F.lit(v) for i, r in enumerate(counts) for v in (r, i)]) if counts else F.create_map(F.lit(0), F.lit(0))
    at = F.element_at(place, F.col("region").cast("int"))
    of = lambda listed: F.element_at(F.array(*[F.lit(v) for v in listed or [1]]), at + 1)
    candidates = table.select((of(base[:-1]) + F.pmod(F.xxhash64("vec_id", F.lit("c")), of(blocks))).cast("bigint").alias("block"), "vec_id", "x", "gap")
    queries = table.where(F.col("vec_id") % every == 0).select("vec_id", "x", "gap").dropDuplicates(["vec_id", "x"])

    def send(first: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, 256):
                    batch = whole.slice(start, 256)
                    ids, floor = batch.column(0).to_numpy(), batch.column(3).to_numpy()
                    bound = upper(matrix(batch.column(2)), low, high)
                    home = bound.argmax(axis=1)
                    first_block = np.array(base)[home] + ids % np.array(blocks)[home]
                    if first:
                        row, block = np.arange(len(ids)), first_block
                    else:
                        row, region = np.nonzero(bound >= floor[:, None])
                        n = np.array(blocks)[region]
                        row, region = np.repeat(row, n), np.repeat(region, n)
                        block = np.array(base)[region] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
                        other = block != first_block[row]
                        row, block = row[other], block[other]
                    for a in range(0, len(row), 4096):  # a few at a time: each carries its vector
                        taken = batch.take(pa.array(row[a : a + 4096]))
                        yield pa.RecordBatch.from_arrays([pa.array(block[a : a + 4096].astype(np.int64)), *taken.columns], names=["block", "vec_id", "x", "gap", "floor"])

        return run

    asked_schema = "block long, vec_id long, x array<double>, gap array<double>, floor double"
    asked = materialize(queries.withColumn("floor", F.lit(float("-inf"))).mapInArrow(send(True), asked_schema), "pivot-asked")
    near = materialize(_meet(candidates, asked, k), "pivot-near")
    # the k-th score of the first block; a query whose first block has fewer candidates has nothing to beat yet
    floors = near.where("vec_id is not null").groupBy("query_id").agg(F.min("score").alias("kth"), F.count("*").alias("n"))
    floors = floors.select("query_id", F.when(F.col("n") >= k, F.col("kth").cast("double")).otherwise(F.lit(float("-inf"))).alias("floor"))
    again = queries.join(floors, queries["vec_id"] == floors["query_id"], "left").select("vec_id", "x", "gap", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    more = materialize(again.mapInArrow(send(False), asked_schema), "pivot-more")
    far = materialize(_meet(candidates, more, k), "pivot-far")
    found = materialize(near.union(far), "pivot-found")
    for spent in (table, asked, near, more, far):
        drop_materialized(spent)
    return found


def top_k(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of every query."""
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    best = searched(vectors, k, every).where("vec_id is not null").withColumn("rank", F.row_number().over(order))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def evaluations(vectors: DataFrame, k: int = K, every: int = QUERY_EVERY) -> DataFrame:
    """query_id, evaluated: how many candidates each query was compared with in full; the bounds eliminated the rest."""
    return searched(vectors, k, every).where("vec_id is null").groupBy("query_id").agg(F.sum("evaluated").alias("evaluated"))
