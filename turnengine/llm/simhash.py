"""SimHash near-deduplication by a segment-popcount embedding.

fingerprint: 64 bits, each the majority of that bit over the XXH64 values of a text's word shingles. The embedding
maps a fingerprint to the bit counts of its 32 two-bit segments (they fit one 64-bit word). The Manhattan distance
of two such vectors never exceeds the Hamming distance of the fingerprints, so fingerprints within RADIUS bits lie
within RADIUS in the embedding. The grid cuts the 32 axes into 6 groups: a distance of at most 3 leaves at least 3
groups untouched, so two linked fingerprints share the cell of one of the 20 choices of 3 groups. Within a cell
pairs are first bounded by the Manhattan distance, then verified by the Hamming distance.

Scale: equal fingerprints are one node before anything else, so copies cost nothing. Cells with one member fall
out in a count. Large cells are cut into blocks of about BLOCK members and only pairs of blocks meet in a task, so
no task holds more than two blocks whatever the size of a group. A task does not emit pairs but a spanning forest
of the links it found: at most one edge per member. Tables of ids are joined by merge joins, by hint: none is broadcast,
so the driver's memory does not follow the input.

Defined cases: null and empty texts, and texts of white space, have fingerprint zero and link like any other;
fewer words than a shingle make one shingle; repeated rows are copies; a null doc_id is never a component's name
unless all ids of the component are null; an empty table gives no rows; columns of other names are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnengine.llm.common import drop_materialized, materialize, ship
from turnengine.llm.components import connected_components

WORDS = 3
RADIUS = 3
GROUPS = 6
BLOCK = 256
_LOW = 0x5555555555555555


def shingle_hashes(raw: bytes | None, size: int) -> np.ndarray:
    """XXH64 (seed 42) of every run of size words, repeats included, A-Z lowered; ASCII white space splits words."""
    from xxhash import xxh64_intdigest

    words = (raw or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < size:
        return np.array([xxh64_intdigest(joined, 42)], np.uint64)
    ends = list(accumulate(map(len, words)))
    starts = [0, *(e + i + 1 for i, e in enumerate(ends))]
    return np.array([xxh64_intdigest(joined[a : e + i], 42) for a, (i, e) in zip(starts, list(enumerate(ends))[size - 1 :], strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of a text's shingle hashes: bits set in over half of them."""
    if not len(hashes):
        return 0
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = np.zeros(64, np.int64)
    for at in range(0, len(bits), 255):
        counts += bits[at : at + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed 64-bit integer."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            found = np.array([majority(shingle_hashes(t, size)) for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def popcounts(fp: Column) -> Column:
    """Bit counts of the 32 two-bit segments, each in its segment's place."""
    low, next_bit = F.lit(_LOW), F.shiftrightunsigned(fp, 1)
    return fp.bitwiseXOR(next_bit).bitwiseAND(low).bitwiseOR(F.shiftleft(fp.bitwiseAND(next_bit).bitwiseAND(low), 1))


def grid_cells(fp: Column) -> Column:
    """The keys of the 20 grid cells of a fingerprint."""
    edges = [round(i * 32 / GROUPS) for i in range(GROUPS + 1)]
    masks = [sum(3 << (2 * s) for s in range(edges[g], edges[g + 1])) for g in range(GROUPS)]
    return F.array(*[
        F.xxhash64(F.lit(t), popcounts(fp).bitwiseAND(F.lit(_signed(sum(masks[g] for g in kept)))))
        for t, kept in enumerate(combinations(range(GROUPS), GROUPS - RADIUS))
    ])


_GAP = np.array([abs((b & 15) - 4) + abs((b >> 4) - 4) for b in range(256)], np.uint8)


def manhattan(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Manhattan distance of the segment bit counts of two arrays of fingerprints."""
    low, pair, four = np.uint64(_LOW), np.uint64(0x3333333333333333), np.uint64(0x4444444444444444)
    p, q = ((x & low) + ((x >> np.uint64(1)) & low) for x in (a, b))
    total = np.zeros(len(a), np.int64)
    for shift in (np.uint64(0), np.uint64(2)):
        gap = ((p >> shift) & pair) + four - ((q >> shift) & pair)  # no nibble borrows: each is 4 plus at most 2 either way
        total += _GAP[gap.view(np.uint8).reshape(-1, 8)].sum(axis=1, dtype=np.int64)
    return total


def linked_pairs(keys: np.ndarray, fps: np.ndarray, radius: int | None) -> tuple[np.ndarray, np.ndarray]:
    """Positions i < j of linked rows within runs of equal keys; all pairs of a run if radius is None."""
    left, right = [], []
    at = np.arange(len(keys) - 1)
    for step in range(1, len(keys)):
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        i = at
        if radius is not None:
            a, b = fps[at], fps[at + step]
            near = manhattan(a, b) <= radius
            near[near] = np.bitwise_count(a[near] ^ b[near]) <= radius
            i = at[near]
        left.append(i)
        right.append(i + step)
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *left]), np.concatenate([none, *right])


def forest(pairs: Iterator[tuple[int, int]]) -> list[tuple[int, int]]:
    """(node, smallest node of its tree) of all nodes but the smallest ones."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = parent[p]
            x = p
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [(x, root) for x in list(parent) if (root := find(x)) != x]


def verified(pairs: Iterator[tuple[int, int]], sets: list[np.ndarray]) -> Iterator[tuple[int, int]]:
    """The pairs of positions whose sets (sorted, distinct) are alike at SIMILARITY; pairs already united are passed over."""
    parent = list(range(len(sets)))

    def find(x: int) -> int:
        while (p := parent[x]) != x:
            parent[x] = parent[p]
            x = p
        return x

    top, of = SIMILARITY
    for i, j in pairs:
        a, b = find(i), find(j)
        few, many = sorted((sets[i], sets[j]), key=len)
        if a == b or of * len(few) < top * len(many):
            continue
        places = np.searchsorted(many, few)
        both = int((many[np.minimum(places, len(many) - 1)] == few).sum())
        if of * both >= top * (len(few) + len(many) - both):
            parent[max(a, b)] = min(a, b)
            yield i, j


def cell_links(rows: DataFrame, radius: int | None, sketches: DataFrame | None = None, share: float = 0.0) -> DataFrame:
    """Spanning edges (u, v) of the links among rows (key, fp, rep) that share a key, within radius bits if radius is given.

    sketches (rep, sketch[, shingles]): links must also agree in at least this share of their sketch's bytes, and their
    shingle sets, where they are given, must be alike at SIMILARITY.
    """
    ship(rows.sparkSession)
    sizes = rows.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    own = F.pmod(F.xxhash64("fp", F.lit(7)), blocks).cast("int")
    others = F.transform(F.filter(F.sequence(F.lit(0), blocks - 1), lambda o: o != own), lambda o: F.xxhash64("key", F.least(own, o), F.greatest(own, o)))
    dealt = rows.join(sizes.hint("merge"), "key").select(F.explode(F.when(blocks == 1, F.array("key")).otherwise(others)).alias("cell"), "fp", "rep")
    with_sketch = sketches is not None
    with_sets = with_sketch and "shingles" in sketches.columns
    if with_sketch:
        dealt = dealt.join(sketches.hint("merge"), "rep").select("cell", "fp", *sketches.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(t: pa.Table) -> pa.RecordBatch:
            reps = t.column("rep").to_numpy()
            i, j = linked_pairs(t.column("cell").to_numpy(), t.column("fp").to_numpy().view(np.uint64), radius)
            if with_sketch and len(i):
                marks = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(reps), -1)
                alike = np.concatenate([(marks[i[k : k + 4096]] == marks[j[k : k + 4096]]).mean(axis=1) for k in range(0, len(i), 4096)])
                i, j = i[alike >= share], j[alike >= share]
            if with_sets and len(i):
                sets = [np.frombuffer(b.as_buffer(), "<u8") for b in t.column("shingles")]
                sure = np.array(list(verified(zip(i.tolist(), j.tolist(), strict=True), sets)), np.int64).reshape(-1, 2)
                i, j = sure[:, 0], sure[:, 1]
            found = forest(zip(reps[i].tolist(), reps[j].tolist(), strict=True))
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            cells = table.column("cell").to_numpy()
            other = np.flatnonzero(cells != cells[-1])
            cut = int(other[-1] + 1) if len(other) else 0
            ends = (np.flatnonzero(cells[1:cut] != cells[: max(cut - 1, 0)]) + 1).tolist() + [cut]
            at = 0
            for end in ends:  # a few cells at a time, so that pairs and sets take little memory
                if end - at >= 2 * BLOCK or at < end == cut:
                    yield links(table.slice(at, end - at))
                    at = end
            rest = table.slice(cut)
        if rest is not None and rest.num_rows > 1:
            yield links(rest)

    return dealt.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "u long, v long")


def grid_links(nodes: DataFrame) -> DataFrame:
    """Spanning edges (u, v) of the links at RADIUS among nodes (fp, rep), found by the grid."""
    return cell_links(nodes.select(F.explode(grid_cells(F.col("fp"))).alias("key"), "fp", "rep"), RADIUS)


def fingerprint_links(rows: DataFrame) -> DataFrame:
    """Edges (u, v) that join all reps of rows (fp, rep) whose fingerprints link at RADIUS or fewer differing bits."""
    least = rows.groupBy("fp").agg(F.min("rep").alias("least"))
    equal = rows.join(least.hint("merge"), "fp").where("rep <> least").select(F.col("rep").alias("u"), F.col("least").alias("v"))
    return equal.union(grid_links(least.select("fp", F.col("least").alias("rep"))))


def simhash_components(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row: fingerprints link at RADIUS or fewer differing bits."""
    return fingerprint_components(materialize(fingerprints(docs, size), "simhash"))


def fingerprint_components(fps: DataFrame) -> DataFrame:
    """simhash_components of given fingerprints (doc_id, fp).

    The graph's nodes are fingerprints, so those of rows without doc_id link others too; a component is then named
    by the smallest doc_id among its fingerprints.
    """
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    parts = connected_components(grid_links(nodes.select("fp", F.col("fp").alias("rep"))))
    linked = nodes.join(parts.hint("merge"), nodes["fp"] == parts["node"], "left").select("fp", F.coalesce("component", "fp").alias("part"), "least")
    named = materialize(linked.join(linked.groupBy("part").agg(F.min("least").alias("component_id")).hint("merge"), "part").select("fp", "component_id"), "simhash-named")
    drop_materialized(nodes)
    drop_materialized(parts)
    return fps.join(named.hint("merge"), "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Stage on near copies: words of a shingle, and the least similarity (Jaccard, as a fraction) of two sets that link.
NEAR_WORDS, SIMILARITY = 5, (4, 5)
#: Min-wise sketch: BANDS bands of ROWS permutations. Texts of similarity 0.8 share no band with chance 3e-6.
BANDS, ROWS = 42, 6
#: Agreement of sketches that makes a candidate: 4.7 standard errors (0.025) below 0.8. Candidates are verified exactly.
CANDIDATE = 0.68


def _permutations() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(42)
    return rng.integers(0, 1 << 31, BANDS * ROWS, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint32)


_TIMES, _PLUS = _permutations()


def sketch(hashes: np.ndarray) -> np.ndarray:
    """Least value of a set of shingle hashes under each permutation; 32 bits, which processors multiply many at a time."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint32).max, np.uint32)
    folded = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(folded), 128):
        mixed = folded[at : at + 128, None] ^ _PLUS
        mixed *= _TIMES
        mixed ^= mixed >> np.uint32(15)
        mixed *= np.uint32(0x9E3779B1)
        np.minimum(least, mixed.min(axis=0), out=least)
    return least


def near_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, keeper) of every row: groups of texts whose sets of five-word shingles are alike at 0.8.

    text_key is Spark's hash of the text; keeper (doc_id, text_key) is the smallest row of the group that has a doc_id.

    The method is that of simhash_components: texts whose fingerprints (of WORDS-word shingles) differ in at most RADIUS bits
    are found by the grid, the Manhattan bound and the Hamming distance, and are candidates. Texts that are alike at 0.8 may
    differ in up to 25 bits, and no grid over 64 bits is selective at that radius. So for what the grid cannot reach, cells are
    also bands of a min-wise sketch, and pairs of a cell that agree in CANDIDATE of their sketches (a byte of each of 252
    values) are candidates, too. Then the members of each component of candidates bring their shingle sets, and every pair of
    them that may matter is verified by its exact similarity. Nodes are sets, named by a hash.

    Defined cases: null and empty texts and texts of white space have the empty set and are copies of each other; fewer
    words than a shingle make one shingle; texts whose shingle sets are equal are copies, whatever their order and
    repeats; very long texts are compared whole; of equal rows (ties) the keeper is one; rows without doc_id are in no
    group; an empty table gives no rows; columns of other names are not read.
    """
    ship(docs.sparkSession)

    def parts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return (batch.slice(at, 512) for batch in batches for at in range(0, batch.num_rows, 512))

    def named(hashes: np.ndarray) -> int:
        from xxhash import xxh64_intdigest

        return xxh64_intdigest(hashes.astype("<u8").tobytes(), 42)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            hashes = [np.unique(shingle_hashes(t, NEAR_WORDS)) for t in batch.column(1).cast(pa.binary()).to_pylist()]
            same = np.array([named(h) for h in hashes], np.uint64).view(np.int64)
            found = np.array([majority(shingle_hashes(t, WORDS)) for t in batch.column(1).cast(pa.binary()).to_pylist()], np.uint64)
            marks = np.array([sketch(h) for h in hashes], np.uint32).reshape(len(hashes), BANDS, ROWS)
            odd = np.arange(1, 2 * ROWS, 2, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            bands = (marks * odd).sum(axis=2, dtype=np.uint64) ^ np.arange(BANDS, dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), batch.column(2), pa.array(same), pa.array(found.view(np.int64)), pa.array(list(bands.view(np.int64)), pa.list_(pa.int64())), pa.array([m.astype(np.uint8).tobytes() for m in marks.reshape(len(hashes), -1)], pa.binary())],
                names=["doc_id", "text_key", "same", "fp", "bands", "sketch"],
            )

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in parts_of(batches):
            hashes = [np.unique(shingle_hashes(t, NEAR_WORDS)) for t in batch.column(0).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(np.array([named(h) for h in hashes], np.uint64).view(np.int64)), pa.array([h.astype("<u8").tobytes() for h in hashes], pa.binary())], names=["rep", "shingles"])

    marked = materialize(docs.select("doc_id", "text", F.xxhash64("text").alias("text_key")).mapInArrow(run, "doc_id long, text_key long, same long, fp long, bands array<long>, sketch binary"), "near-marks")
    nodes = marked.where("doc_id is not null").groupBy("same").agg(F.min(F.struct("doc_id", "text_key")).alias("first"), F.min(F.struct("bands", "sketch")).alias("m"))
    nodes = materialize(nodes.select(F.col("same").alias("rep"), "first", "m.*"), "near-nodes")
    rows = nodes.select(F.explode("bands").alias("key"), F.col("rep").alias("fp"), "rep")
    banded = cell_links(rows, None, nodes.select("rep", "sketch"), CANDIDATE)
    cells = connected_components(fingerprint_links(marked.where("doc_id is not null").select("fp", F.col("same").alias("rep"))).union(banded))  # without the components' names
    maybe = materialize(cells.select(F.col("node").alias("rep"), "component").union(cells.select("component", "component").distinct()), "near-maybe")
    drop_materialized(cells)
    asked = nodes.join(maybe.hint("merge"), "rep").select("rep", "first", "sketch")
    texts = docs.select("doc_id", "text").join(asked.select("first.doc_id").distinct().hint("merge"), "doc_id", "left_semi").select("text")
    sets = materialize(asked.select("rep", "sketch").join(texts.mapInArrow(shingles, "rep long, shingles binary").dropDuplicates(["rep"]).hint("merge"), "rep"), "near-sets")
    parts = connected_components(cell_links(maybe.select(F.col("component").alias("key"), F.col("rep").alias("fp"), "rep"), None, sets, CANDIDATE))
    group = nodes.join(parts.hint("merge"), nodes["rep"] == parts["node"], "left").select(F.col("rep").alias("same"), "first", F.coalesce("component", "rep").alias("part"))
    least = group.groupBy("part").agg(F.min("first").alias("keeper"))
    found = materialize(marked.select("doc_id", "text_key", "same").join(group.join(least.hint("merge"), "part").hint("merge"), "same", "left").select("doc_id", "text_key", "keeper"), "near-groups")
    for spent in (marked, nodes, maybe, sets, parts):
        drop_materialized(spent)
    return found


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, component_id) of every row: the smallest doc_id of its group, see near_rows."""
    return near_rows(docs).select("doc_id", F.col("keeper.doc_id").alias("component_id"))


def drop_near_copies(docs: DataFrame) -> DataFrame:
    """docs with one row of each near-duplicate group, that of the smallest doc_id; rows without doc_id all stay.

    Repeated rows (one doc_id, one text) are copies of each other and leave one, that whose other columns come first as JSON.
    Where a doc_id repeats with other texts, each text goes or stays by its own group.
    """
    groups = near_rows(docs).where("doc_id is not null")
    lost = groups.where("doc_id <> keeper.doc_id or text_key <> keeper.text_key").select(F.col("doc_id").alias("lost_id"), F.col("text_key").alias("lost_key")).distinct()
    kept = docs.join(lost.hint("merge"), (docs["doc_id"] == lost["lost_id"]) & (F.xxhash64(docs["text"]) == lost["lost_key"]), "left_anti").select(*docs.columns)
    repeated = groups.groupBy("doc_id", "text_key").count().where("count > 1")
    if repeated.isEmpty():
        return kept
    whole = F.struct(*[kept[c] for c in docs.columns])
    others = F.to_json(F.struct(*[kept[c] for c in docs.columns if c != "text"]), {"ignoreNullFields": "false"})
    one = kept.where("doc_id is not null").groupBy("doc_id", F.xxhash64("text").alias("text_key")).agg(F.min_by(whole, others).alias("whole"))
    return kept.where("doc_id is null").union(one.select(*[F.col("whole").getField(c).alias(c) for c in docs.columns]))
