"""Token-ID store: patched frame-of-reference blocks in an indexed chunk format.

A chunk holds whole documents in ascending doc_id order. Its bytes, all integers little-endian:

    magic "PFR1" | version u32 | n_docs u64 | n_ids u64 | n_blocks u64
    doc ids i64[n_docs] | validity of doc ids u8[n_docs] | ids per document u64[n_docs]
    index: start of each block in the block area u64[n_blocks + 1]
    block area: base u32 | width u8 | n_exceptions u8 | packed u8[16 * width] | positions u8[n] | values u32[n]

A block is 128 ids. Its minimum is subtracted; the rest is packed in the least number of bits that holds at least
PERCENTILE of the block's values; each value above that is an outlier, kept whole in the exception list (its low
bits stay in the packed part). The last block is filled up with its own minimum. The index makes every block, and
so every id, reachable without reading those before it.

write_store() lays chunks out as rows of a Parquet table in the shared folder (columns shard, chunk, shard_start,
n_ids, data): Spark's committer makes the files appear whole or not at all, any store it can write will do, and a
lost executor's shard is written again. Shards are ranges of doc_id in ascending order, chunks run through a shard.

Defined cases: null text is empty and yields the end id alone; a null doc_id sorts first; rows with equal doc_id
are ordered by a hash of the text and then as they come; an empty table gives an empty store; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnengine.llm.common import materialize, ship, shuffle_partitions
from turnengine.llm.tokens import open_tokenizer

MAGIC, BLOCK, PERCENTILE = b"PFR1", 128, 0.9
#: A chunk is closed once it has this many ids; one longer document makes one longer chunk.
CHUNK_IDS = 1 << 17
#: Characters of a shard, beyond spark.sql.shuffle.partitions shards.
SHARD = 1 << 28


def _bits(values: np.ndarray) -> np.ndarray:
    """Bit length of each unsigned value."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 128 values below 2**width as rows of 16 * width bytes."""
    lanes = np.ascontiguousarray(values.astype(np.uint64).reshape(-1, 64).T)
    words = np.zeros((width, lanes.shape[1]), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        words[word] |= lanes[i] << np.uint64(shift)
        if shift + width > 64:
            words[word + 1] |= lanes[i] >> np.uint64(64 - shift)
    return np.ascontiguousarray(words.T).view(np.uint8).reshape(-1, 16 * width)


def _unpack(packed: np.ndarray, width: int) -> np.ndarray:
    words = np.ascontiguousarray(np.ascontiguousarray(packed).view("<u8").reshape(-1, width).T)
    mask = np.uint64((1 << width) - 1)
    lanes = np.empty((64, words.shape[1]), np.uint64)
    for i in range(64):
        word, shift = divmod(i * width, 64)
        value = words[word] >> np.uint64(shift)
        if shift + width > 64:
            value |= words[word + 1] << np.uint64(64 - shift)
        lanes[i] = value & mask
    return lanes.T.reshape(-1, BLOCK).astype(np.uint32)


def encode_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """(index, block area) of a sequence of unsigned 32-bit ids."""
    n = -(-len(ids) // BLOCK)
    if not n:
        return np.zeros(1, "<u8"), b""
    last = ids[(n - 1) * BLOCK :]
    rows = np.concatenate([ids, np.full(n * BLOCK - len(ids), last.min(), np.uint32)]).astype(np.uint32).reshape(n, BLOCK)
    base = rows.min(axis=1)
    rest = rows - base[:, None]
    rank = max(1, int(np.ceil(percentile * BLOCK))) - 1
    width = np.maximum(_bits(np.partition(rest, rank, axis=1)[:, rank]), 1)
    over = rest >> np.minimum(width, 31)[:, None].astype(np.uint32) > 0
    over[width >= 32] = False
    n_over = over.sum(axis=1)
    size = 6 + 16 * width.astype(np.int64) + 5 * n_over
    index = np.concatenate([[0], np.cumsum(size)]).astype("<u8")
    area = np.zeros(int(index[-1]), np.uint8)
    start = index[:-1].astype(np.int64)
    area[start[:, None] + np.arange(4)] = base.astype("<u4").view(np.uint8).reshape(n, 4)
    area[start + 4], area[start + 5] = width, n_over
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        low = rest[own] & np.uint32((1 << int(w)) - 1)
        area[(start[own] + 6)[:, None] + np.arange(16 * int(w))] = _pack(low, int(w))
    if n_over.any():
        row, position = np.nonzero(over)
        lists = start + 6 + 16 * width.astype(np.int64)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        area[lists[row] + nth] = position.astype(np.uint8)
        area[(lists[row] + n_over[row] + 4 * nth)[:, None] + np.arange(4)] = rest[row, position].astype("<u4").view(np.uint8).reshape(-1, 4)
    return index, area.tobytes()


def decode_blocks(index: np.ndarray, area: np.ndarray) -> np.ndarray:
    """All ids of the blocks that index points at, 128 for each."""
    start = index[:-1].astype(np.int64)
    n = len(start)
    out = np.empty((n, BLOCK), np.uint32)
    if not n:
        return out.reshape(-1)
    base = np.ascontiguousarray(area[start[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    width, n_over = area[start + 4], area[start + 5].astype(np.int64)
    for w in np.unique(width):
        own = np.flatnonzero(width == w)
        out[own] = _unpack(area[(start[own] + 6)[:, None] + np.arange(16 * int(w))], int(w))
    if n_over.any():
        row = np.repeat(np.arange(n), n_over)
        lists = start + 6 + 16 * width.astype(np.int64)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n_over) - n_over, n_over)
        values = np.ascontiguousarray(area[(lists[row] + n_over[row] + 4 * nth)[:, None] + np.arange(4)]).view("<u4").reshape(-1)
        out[row, area[lists[row] + nth]] = values
    return (out + base[:, None]).reshape(-1)


def encode_chunk(doc_ids: list[int | None], documents: list[bytes]) -> bytes:
    """documents: each one's ids as little-endian unsigned 32-bit integers."""
    ids = np.frombuffer(b"".join(documents), "<u4")
    index, area = encode_blocks(ids)
    valid = np.array([d is not None for d in doc_ids], np.uint8)
    head = np.array([len(doc_ids), len(ids), len(index) - 1], "<u8")
    return b"".join([
        MAGIC, np.uint32(1).tobytes(), head.tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), valid.tobytes(),
        np.array([len(d) // 4 for d in documents], "<u8").tobytes(), index.tobytes(), area,
    ])


def _head(data: bytes) -> tuple[int, int, int, int]:
    if data[:4] != MAGIC:
        raise ValueError("not a chunk of this format")
    n_docs, n_ids, n_blocks = (int(x) for x in np.frombuffer(data, "<u8", 3, 8))
    return n_docs, n_ids, n_blocks, 32 + 17 * n_docs


def decode_chunk(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """(doc ids, ids per document, all ids) of a chunk."""
    n_docs, n_ids, n_blocks, at = _head(data)
    doc_ids = np.frombuffer(data, "<i8", n_docs, 32).tolist()
    valid = np.frombuffer(data, np.uint8, n_docs, 32 + 8 * n_docs)
    lengths = np.frombuffer(data, "<u8", n_docs, 32 + 9 * n_docs).astype(np.int64)
    index = np.frombuffer(data, "<u8", n_blocks + 1, at)
    area = np.frombuffer(data, np.uint8, -1, at + 8 * (n_blocks + 1))
    return [d if v else None for d, v in zip(doc_ids, valid, strict=True)], lengths, decode_blocks(index, area)[:n_ids]


def read_range(data: bytes, start: int, stop: int) -> np.ndarray:
    """Ids [start, stop) of a chunk; only the blocks that hold them are decoded."""
    _, n_ids, n_blocks, at = _head(data)
    start, stop = max(0, start), min(stop, n_ids)
    if start >= stop:
        return np.zeros(0, np.uint32)
    first, last = start // BLOCK, -(-stop // BLOCK)
    index = np.frombuffer(data, "<u8", n_blocks + 1, at)[first : last + 1]
    area = np.frombuffer(data, np.uint8, int(index[-1] - index[0]), at + 8 * (n_blocks + 1) + int(index[0]))
    return decode_blocks(index - index[0], area)[start - first * BLOCK : stop - first * BLOCK]


STORE_SCHEMA = "shard long, chunk long, shard_start long, n_ids long, data binary"


def shards(docs: DataFrame) -> int:
    """How many shards texts are dealt to: by their size, so that a task's share of the sort does not grow."""
    chars = docs.agg(F.sum(F.char_length("text")).alias("n")).first()["n"] or 0
    return max(shuffle_partitions(docs.sparkSession), -(-chars // SHARD))


def write_store(docs: DataFrame, tokenizer_path: str, kind: str = "spaced", end_id: int = 0) -> DataFrame:
    """Encode every whole text, append end_id, write the store, and return it as read back."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = open_tokenizer(tokenizer_path, kind), np.uint32(end_id).tobytes()
        shard, chunk, before = TaskContext.get().partitionId(), 0, 0
        doc_ids: list[int | None] = []
        documents: list[bytes] = []

        def close() -> pa.RecordBatch:
            nonlocal chunk, before
            n = sum(map(len, documents)) // 4
            row = pa.RecordBatch.from_pylist([{"shard": shard, "chunk": chunk, "shard_start": before, "n_ids": n, "data": encode_chunk(doc_ids, documents)}], schema=schema)
            chunk, before = chunk + 1, before + n
            doc_ids.clear()
            documents.clear()
            return row

        schema = pa.schema([("shard", pa.int64()), ("chunk", pa.int64()), ("shard_start", pa.int64()), ("n_ids", pa.int64()), ("data", pa.binary())])
        held = 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                for doc_id, ids in zip(part.column(0).to_pylist(), tokenizer.encode(part.column(1).to_pylist()), strict=True):
                    doc_ids.append(doc_id)
                    documents.append(ids + end)
                    held += len(ids) // 4 + 1
                    if held >= CHUNK_IDS:
                        held = 0
                        yield close()
        if doc_ids:
            yield close()

    # ties are told apart, so that many rows without doc_id, or of one text, do not fall into one shard
    order = ["doc_id", "tie", "place"]
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"))
    ordered = rows.repartitionByRange(shards(docs), *order).sortWithinPartitions(*order).select("doc_id", "text")
    return materialize(ordered.mapInArrow(run, STORE_SCHEMA), "pfor")


def read_store(store: DataFrame) -> DataFrame:
    """One row per document of a store: doc_id, start, n_tokens, ids_crc32, all from the stored bytes."""
    ship(store.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, shard_start, data in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                doc_ids, lengths, ids = decode_chunk(data)
                stops = np.cumsum(lengths)
                raw = memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(raw[4 * (b - n) : 4 * b]) for b, n in zip(stops.tolist(), lengths.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard] * len(doc_ids), pa.int64()), pa.array(doc_ids, pa.int64()), pa.array(shard_start + stops - lengths), pa.array(lengths), pa.array(crc, pa.int64())],
                    names=["shard", "doc_id", "own_start", "n_tokens", "ids_crc32"],
                )

    rows = store.select("shard", "shard_start", "data").mapInArrow(run, "shard long, doc_id long, own_start long, n_tokens long, ids_crc32 long")
    # one row per shard, of which there is one per SHARD characters: that bounds both the driver's list and the broadcast
    totals = sorted((r["shard"], r["n"]) for r in store.groupBy("shard").agg(F.sum("n_ids").alias("n")).collect())
    bases, before = [], 0
    for shard, n in totals:
        bases.append((shard, before))
        before += n
    known = store.sparkSession.createDataFrame(bases, "shard long, base long")
    return rows.join(F.broadcast(known), "shard").select("doc_id", (F.col("base") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32")
