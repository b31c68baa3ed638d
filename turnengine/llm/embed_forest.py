"""Embedding near-deduplication with a forest of random-projection trees.

Trees split the unit vectors by random directions at the median, again and again; vectors near a split go to both
sides (spill). Vectors that share a leaf and a label are compared exactly; links from all trees unite. A node is not
split where that would part too many of its near pairs, as it does inside a dense group: of the near pairs of a tree's
sample, about KEPT at least stay together all the way down, whatever the depth.

Scale: equal vectors of a label are one node with a count. The depth follows the size of the largest label, so that a
leaf with its spill holds about LEAF vectors: each level keeps 0.5 + SPILL of a node, and rows grow by 1 + 2 SPILL. The
number of trees follows the depth, so that a pair at the limit meets somewhere with chance MEET. Rows per vector so
grow as about n ** 0.2. The splits are fitted on at most SAMPLE vectors; below the level at which a node has too few
of them, directions and thresholds are those of the whole sample. Leaves that are still large are cut into blocks of
about BLOCK vectors and all pairs of blocks meet, so a task holds two blocks at most and no pair of the leaf is lost. A
pair that meets in several leaves is counted in the first leaf common to both alone (every row carries its leaves), so
link counts are exact without emitting pairs: a task returns one count per vector and a spanning forest of its links.

What the forest misses: a pair that every tree parts, about one in a hundred at the limit on large labels. No spill that
rules this out keeps vectors of random directions apart, so an exact pass follows: blocks of a label meet, at single
precision less its rounding error, and pairs found there that share no leaf are checked as the others are. Its products
grow with the square of a label; a vector goes to MOST_BLOCKS blocks at most, as long as these hold FAR_MOST vectors.

Defined cases: a null label, and vectors that are null, empty, zero or hold null or non-finite components, link
with nothing: no links, their own component; vectors of different length never link; repeated rows with one vec_id
are rows each and one node of the graph; rows without vec_id are left out; an empty table gives no rows; extra
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnengine.llm.common import drop_materialized, materialize, ship, shuffle_partitions
from turnengine.llm.components import connected_components
from turnengine.llm.vectors import finite, matrix

COSINE, SPILL = 0.93, 0.05
#: Vectors a leaf should hold, of a block of a larger leaf, and of the sample that the splits are fitted on.
LEAF, BLOCK, SAMPLE = 512, 1024, 20_000
#: The chance that a pair at the limit meets in a leaf, and that one split parts it: for random directions, vectors at
#: a cosine of 0.93 differ by 0.37 deviations, and 0.4 * E[(|difference| - width of the spill)+] is 0.045.
MEET, PARTED, MIN_TREES, MAX_TREES = 0.99, 0.045, 4, 31
#: The least sample vectors of a node that is split.
_LEAST = 16
#: Vectors of a block of the exact pass at least and at most, blocks of a label until they are that large, and of a tile of products.
FAR, FAR_MOST, MOST_BLOCKS, TILE = 8192, 65_536, 16, 1024
#: Near pairs that the splits down to a leaf may leave together, and the sample vectors of a node they are counted on.
KEPT, SEEN = 0.7, 512

#: A node: (direction seed, low, high, left, right), or a leaf: the number of levels still to go by the whole sample's
#: splits, 0 where none may follow. Projections below high go left, above low right.
Node = tuple | int


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length one; each is divided by its largest component first, so that squares neither vanish nor overflow."""
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True), np.finfo(float).tiny)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), np.finfo(float).tiny)


def _direction(seed: tuple[int, ...], width: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal(width)


def parted(x: np.ndarray, at: np.ndarray, low: float, high: float) -> float:
    """Share of the near pairs of x that a split parts; a few pairs that stay are added, so that chance alone stops no split."""
    step = -(-len(x) // SEEN)
    x, at = x[::step], at[::step]
    near = x @ x.T >= COSINE
    return float(near[at < low][:, at > high].sum() / ((near.sum() - np.trace(near)) / 2 + 8))


def shape(n: int) -> tuple[int, int]:
    """(depth, trees) for a label of n vectors."""
    depth = max(0, int(np.ceil(np.log(max(n, 1) / LEAF) / -np.log(0.5 + SPILL))))
    stay = (1 - PARTED) ** depth
    trees = int(np.ceil(np.log(1 - MEET) / np.log1p(-stay))) if stay < 1 else 1
    return depth, min(max(trees, MIN_TREES), MAX_TREES) if depth else 1


def _cut(x: np.ndarray, seed: tuple[int, ...]) -> tuple[np.ndarray, float, float]:
    at = x @ _direction(seed, x.shape[1])
    low, high = np.quantile(at, [0.5 - SPILL, 0.5 + SPILL])
    return at, float(low), float(high)


def grow(x: np.ndarray, tree: int, depth: int, node: int = 1, kept: float = 1.0) -> Node:
    """A tree of random splits, fitted on the rows of x; they follow the spill as all rows will."""
    if not depth or len(x) < _LEAST:
        return depth
    at, low, high = _cut(x, (tree, node))
    kept *= 1 - parted(x, at, low, high)
    if kept < KEPT:
        return 0
    return (node, low, high, grow(x[at <= high], tree, depth - 1, 2 * node, kept), grow(x[at >= low], tree, depth - 1, 2 * node + 1, kept))


def level_splits(x: np.ndarray, tree: int, depth: int) -> list[tuple[float, float]]:
    """Low and high of the splits of the whole sample, for each number of levels still to go."""
    return [_cut(x, (tree, 0, left))[1:] for left in range(depth + 1)] if len(x) else []


def leaves(x: np.ndarray, tree: int, root: Node, levels: list[tuple[float, float]]) -> list[list[int]]:
    """The leaves of each row of x: numbers of nodes."""
    out: list[list[int]] = [[] for _ in range(len(x))]
    at_level: dict[int, np.ndarray] = {}

    def walk(node: Node, number: int, rows: np.ndarray) -> None:
        if not len(rows):
            return
        if isinstance(node, int):
            if not node or not levels:
                for r in rows:
                    out[r].append(number)
                return
            if node not in at_level:
                at_level[node] = x @ _direction((tree, 0, node), x.shape[1])
            at, (low, high), left, right = at_level[node][rows], levels[node], node - 1, node - 1
        else:
            seed, low, high, left, right = node
            at = x[rows] @ _direction((tree, seed), x.shape[1])
        walk(left, 2 * number, rows[at <= high])
        walk(right, 2 * number + 1, rows[at >= low])

    walk(root, 1, np.arange(len(x)))
    return out


def earlier_meetings(cells: list[list[int]], cell: int) -> np.ndarray:
    """Which pairs of rows share a leaf with a smaller number than cell."""
    size = [len(c) for c in cells]
    row, flat = np.repeat(np.arange(len(cells)), size), np.array([c for own in cells for c in own], np.int64)
    row, flat = row[flat < cell], flat[flat < cell]
    _, column, n = np.unique(flat, return_inverse=True, return_counts=True)
    row, column = row[n[column] > 1], column[n[column] > 1]
    _, column = np.unique(column, return_inverse=True)
    met = np.zeros((len(cells), len(cells)), bool)
    for at in range(0, int(column.max(initial=-1)) + 1, 2048):
        own = (column >= at) & (column < at + 2048)
        share = np.zeros((len(cells), 2048), np.float32)
        share[row[own], column[own] - at] = 1
        met |= share @ share.T > 0
    return met


def spanning(near: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """(node, smallest node it reaches) of all but the smallest ones, from a matrix of links."""
    left = np.ones(len(ids), bool)
    edges: list[tuple[int, int]] = []
    for i in np.argsort(ids).tolist():
        if not left[i]:
            continue
        left[i] = False
        latest = np.array([i])
        while len(latest):
            latest = np.flatnonzero(near[latest].any(axis=0) & left)
            left[latest] = False
            edges += [(int(ids[j]), int(ids[i])) for j in latest]
    return edges


def compare(ids: np.ndarray, counts: np.ndarray, x: np.ndarray, side: np.ndarray, split: bool, cells: list[list[int]], cell: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]:
    """Links of one cell or pair of blocks: (ids, links of each, spanning edges). split: only rows of different sides meet."""
    near = x @ x.T >= COSINE
    np.fill_diagonal(near, False)
    if split:
        near &= side[:, None] != side[None]
    busy = np.flatnonzero(near.any(axis=1))
    near = near[np.ix_(busy, busy)]
    here = near & ~earlier_meetings([cells[i] for i in busy], cell)
    links = (here.astype(np.float64) @ counts[busy].astype(np.float64)).astype(np.int64)
    return ids[busy], links, spanning(near, ids[busy])


def common_leaves(a: list[list[int]], b: list[list[int]]) -> np.ndarray:
    """Which rows of a share a leaf with which rows of b."""
    sides = [(np.repeat(np.arange(len(s)), [len(c) for c in s]), np.array([c for own in s for c in own], np.int64), len(s)) for s in (a, b)]
    both = np.intersect1d(sides[0][1], sides[1][1])
    met = np.zeros((len(a), len(b)), bool)
    for at in range(0, len(both), 2048):
        some, held = both[at : at + 2048], []
        for row, flat, size in sides:
            column = np.minimum(np.searchsorted(some, flat), len(some) - 1)
            own = some[column] == flat
            share = np.zeros((size, len(some)), np.float32)
            share[row[own], column[own]] = 1
            held.append(share)
        met |= held[0] @ held[1].T > 0
    return met


def missed(ids: np.ndarray, counts: np.ndarray, x: np.ndarray, side: np.ndarray, split: bool, cells: pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, int]]]]:
    """Links of one block, or between two (split), of rows that share no leaf: (ids, links of each, spanning edges) of each tile that has any."""
    first = np.flatnonzero(side == side.min())
    second = np.flatnonzero(side != side.min()) if split else first
    single, least = x.astype(np.float32), np.float32(COSINE - (x.shape[1] + 8) * 1.2e-7)
    for p in range(0, len(first), TILE):
        for q in range(0 if split else p, len(second), TILE):
            a, b = first[p : p + TILE], second[q : q + TILE]
            near = single[a] @ single[b].T >= least
            if not split and p == q:
                np.fill_diagonal(near, False)
            if not near.any():
                continue
            a, b = a[near.any(axis=1)], b[near.any(axis=0)]
            near = (x[a] @ x[b].T >= COSINE) & (a[:, None] != b[None]) & ~common_leaves(cells.take(pa.array(a)).to_pylist(), cells.take(pa.array(b)).to_pylist())
            a, b, near = a[near.any(axis=1)], b[near.any(axis=0)], near[np.ix_(near.any(axis=1), near.any(axis=0))]
            if not len(a):
                continue
            links = (near @ counts[b].astype(np.int64), counts[a].astype(np.int64) @ near)
            whole = np.zeros((len(a) + len(b),) * 2, bool)
            whole[: len(a), len(a) :], whole[len(a) :, : len(a)] = near, near.T
            edges = [(u, v) for u, v in spanning(whole, np.concatenate([ids[a], ids[b]])) if u != v]
            if not split and p == q:  # both sides are the same rows
                yield ids[a], links[0], edges
            else:
                yield np.concatenate([ids[a], ids[b]]), np.concatenate(links), edges


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each block, of batches sorted by block."""
    rest: pa.Table | None = None
    for batch in batches:
        table = pa.Table.from_batches([batch])
        table = pa.concat_tables([rest, table]) if rest is not None else table
        keys = table.column("block").to_numpy()
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist()]
        for a, b in zip(cuts, cuts[1:], strict=False):
            yield table.slice(a, b - a)
        rest = table.slice(cuts[-1]) if len(keys) else None
    if rest is not None:
        yield rest


def _rows(ids: np.ndarray, links: np.ndarray, edges: list[tuple[int, int]]) -> pa.RecordBatch:
    linked = [(i, None, n) for i, n in zip(ids.tolist(), links.tolist(), strict=True) if n]
    u, v, n = zip(*linked, *[(a, b, None) for a, b in edges], strict=True) if linked or edges else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (u, v, n)], names=["u", "v", "n"])


def near_vectors(vectors: DataFrame) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    ship(vectors.sparkSession)
    rows = vectors.where("vec_id is not null").select(F.col("vec_id").cast("bigint").alias("vec_id"), "label", "embedding")
    linkable = F.col("label").isNotNull() & finite(F.col("embedding")) & F.coalesce(F.exists("embedding", lambda v: v != 0), F.lit(False))
    good = rows.where(linkable)
    nodes = materialize(good.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")), "forest-nodes")
    stats = nodes.agg(F.count("*").alias("n"), F.coalesce(F.max(F.size("embedding")), F.lit(1)).alias("width")).first()
    largest = nodes.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("n")).first()["n"]
    (depth, n_trees), width = shape(largest), int(stats["width"])
    share = min(1.0, 0.95 * SAMPLE / max(stats["n"], 1))
    sample = nodes.where(F.pmod(F.xxhash64("rep", F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20))).select("embedding").orderBy(F.xxhash64("embedding")).limit(SAMPLE).toArrow()  # SAMPLE vectors at most
    fitted = _unit(matrix(sample.column(0), width)) if sample.num_rows else np.zeros((0, width))
    trees = [(grow(fitted, t, depth), level_splits(fitted, t, depth)) for t in range(n_trees)]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(matrix(batch.column(0), width))
            own: list[list[int]] = [[] for _ in range(len(x))]
            for t, (root, levels) in enumerate(trees):
                for cells, more in zip(own, leaves(x, t, root, levels), strict=True):
                    cells += [(t << 56) | leaf for leaf in more]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int64())), batch.column(0), batch.column(1), batch.column(2), batch.column(3)], names=["cells", "embedding", "label", "rep", "copies"])

    kind = dict(nodes.dtypes)
    placed = nodes.select("embedding", "label", "rep", "copies").mapInArrow(route, f"cells array<long>, embedding {kind['embedding']}, label {kind['label']}, rep long, copies long")
    placed = materialize(placed, "forest-cells")
    at_cell = placed.select(F.explode("cells").alias("cell"), "cells", "embedding", "label", "rep", "copies")
    sizes = at_cell.groupBy("label", "cell").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    dealt = at_cell.join(sizes.hint("merge"), ["label", "cell"]).withColumn("side", F.pmod(F.xxhash64("rep", F.lit(5)), blocks).cast("int"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    dealt = dealt.select("cell", F.xxhash64("label", "cell", F.least("side", "other"), F.greatest("side", "other")).alias("block"), "label", "cells", "embedding", "rep", "copies", "side", (F.col("side") != F.col("other")).alias("split"))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches):
            yield _rows(*compare(
                t.column("rep").to_numpy(), t.column("copies").to_numpy(), _unit(matrix(t.column("embedding"), width)), t.column("side").to_numpy(), t.column("split")[0].as_py(), t.column("cells").to_pylist(), t.column("cell")[0].as_py(),
            ))

    def meet_far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches):
            if t.num_rows > 1:
                for found_here in missed(t.column("rep").to_numpy(), t.column("copies").to_numpy(), _unit(matrix(t.column("embedding"), width)), t.column("side").to_numpy(), t.column("split")[0].as_py(), t.column("cells")):
                    yield _rows(*found_here)

    at_leaves = dealt.repartition("block").sortWithinPartitions("block", "label", "cell", "split").mapInArrow(meet, "u long, v long, n long")
    if depth:  # else one leaf holds all
        # labels of over FAR vectors, of which there are few, so that this join may be a broadcast and does not follow the labels' sizes
        big = nodes.groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") > FAR)
        big = big.select("label", F.greatest(F.ceil(F.col("n") / FAR_MOST), F.least(F.ceil(F.col("n") / FAR), F.lit(MOST_BLOCKS))).cast("int").alias("blocks"))
        far = placed.join(F.broadcast(big), "label", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
        far = far.withColumn("side", F.pmod(F.xxhash64("rep", F.lit(11)), F.col("blocks")).cast("int")).select("*", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        far = far.select(F.xxhash64("label", F.least("side", "other"), F.greatest("side", "other")).alias("block"), "cells", "embedding", "rep", "copies", "side", (F.col("side") != F.col("other")).alias("split"))
        at_leaves = at_leaves.union(far.repartition(shuffle_partitions(vectors.sparkSession), "block").sortWithinPartitions("block").mapInArrow(meet_far, "u long, v long, n long"))
    found = materialize(at_leaves, "forest-links")
    links = found.where("n is not null").groupBy(F.col("u").alias("rep")).agg(F.sum("n").alias("links"))
    parts = connected_components(found.where("v is not null").select("u", "v"))
    known = (
        nodes.join(links.hint("merge"), "rep", "left")
        .join(parts.hint("merge"), nodes["rep"] == parts["node"], "left")
        .select("label", "embedding", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    )
    linked = good.join(known, ["label", "embedding"]).select("vec_id", "n_links", "component_id")
    alone = rows.where(~linkable).select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    result = materialize(linked.union(alone).withColumn("kept", F.col("vec_id") == F.col("component_id")), "forest")
    for spent in (nodes, placed, found, parts):
        drop_materialized(spent)
    return result
