"""Stupid-backoff language-model scores from n-gram count tables partitioned by hash.

    S(w | context of k words) = c(context w) / c(context)          if c(context w) > 0
                                ALPHA * S(w | context of k - 1)    otherwise
    S(w) = c(w) / N, and 1 / (N + 1) for a word that is not counted; N: tokens counted

The score of a document is the sum of the natural logs over its tokens (words by ASCII white space, A-Z lowered).
By default every document is scored by the counts of all other documents: an n-gram's count is its count in the
whole corpus less that in the document itself, so that a text does not vouch for itself and backing off is not idle.
With leave_out=False the counts are those of the whole corpus.

As a relation: the exploded n-grams (chunk, key, n) are aggregated to a count table (key, sum of n) and joined back to
it, and the scores are summed per document; relational_scores() is written so. score_corpus() runs the same plan with
the rows of one chunk and one partition of the count table packed into one: a row of the relation costs some 16 bytes
in a shuffle, and nearly every n-gram of a chunk is one row, which makes seven times the input; packed it is four bytes.

1. Documents are dealt into chunks of about CHUNK characters by a hash of the row and its place, so repeated rows and
   rows without doc_id spread. The texts cross the network once; both uses share that exchange.
2. A chunk explodes its n-grams of all orders and sends each distinct one once, with its count in the chunk, to the
   bucket that the first bits of its hash name. Buckets are the partitions of the count table, of about BUCKET n-grams
   each. A frequent n-gram is one entry per chunk, so no bucket is hot. The empty n-gram is counted like any other: its
   count is N. There are never more rows than distinct n-grams of chunks, however many buckets there are.
3. A bucket adds up the counts and joins them back to the requests; the answers return to the chunk, which looks every
   n-gram up and sums per document.

Requests are sorted, so they travel as gaps of about 30 bits, and counts deflate to a fraction of a byte. They hold 40
bits of a hash below those that name the bucket (fewer once the bucket takes more than 24): the chance that two n-grams
share a key is about 2e-6. The number of partitions follows the size of the texts, so a task's share does not grow.

Defined cases: null and empty texts have no tokens and score 0; with no other document every word is unseen; a
repeated row is a document of its own; a null doc_id stays null; an empty table gives no rows; very long texts are
scored whole; extra columns are not read.
"""

from __future__ import annotations

import zlib
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from turnengine.llm.common import materialize, ship, shuffle_partitions

ALPHA, ORDER = 0.4, 3
#: Characters of a chunk, n-grams of a bucket (64 buckets at least).
CHUNK, BUCKET = 3_000_000, 2_000_000
#: Characters of a partition's chunks, while there are no more partitions than this or spark.sql.shuffle.partitions.
PARTITION, PARTITIONS = 4_000_000, 4096
_EMPTY = np.uint64(0x9E3779B97F4A7C15)
SCORED = "doc_id long, n_tokens long, mean_log_score double, log_score double"


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the finaliser of MurmurHash3)."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def ngrams(texts: list[bytes | None], order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(document of each token, position in it, hashes): hashes[n - 1][i] is the n-gram that ends at token i.

    Where a document has fewer than n words up to i, the hash is of those there are.
    """
    from xxhash import xxh64_intdigest

    split = [(t or b"").lower().split() for t in texts]
    sizes = np.array([len(w) for w in split], np.int64)
    total = int(sizes.sum())
    doc = np.repeat(np.arange(len(split)), sizes)
    place = np.arange(total) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    seen: dict[bytes, int] = {}
    first = np.fromiter(map(seen.setdefault, (w for words in split for w in words), range(total)), np.int64, total)
    word = np.zeros(total, np.uint64)
    word[np.fromiter(seen.values(), np.int64, len(seen))] = np.fromiter((xxh64_intdigest(w, 11) for w in seen), np.uint64, len(seen))
    word = word[first]
    hashes = [_mix(word + np.uint64(1))]
    for n in range(2, order + 1):
        longer = hashes[-1].copy()
        if total >= n:
            ok = place[n - 1 :] >= n - 1
            longer[n - 1 :][ok] = _mix(hashes[-1][n - 2 : -1][ok] * np.uint64(0x9DDFEA08EB382D69) ^ (word[n - 1 :][ok] + np.uint64(n)))
        hashes.append(longer)
    return doc, place, hashes


def distinct(hashes: list[np.ndarray], place: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(keys, counts, ranks): the distinct n-grams of a chunk in ascending order, the empty one included, how often each
    occurs, and for each order the rank of the n-gram that ends at each token."""
    if not len(place):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), [np.zeros(0, np.int64) for _ in hashes]
    keys, inverse = np.unique(np.concatenate([*hashes, [_EMPTY]]), return_inverse=True)
    ranks = np.split(inverse[:-1], len(hashes))
    counts = np.bincount(np.concatenate([rank[place >= n] for n, rank in enumerate(ranks)]), minlength=len(keys))
    counts[inverse[-1]] = len(place)
    return keys, counts, ranks


def bucket_runs(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket of each run, start of each run and the end, low bits of each key) of ascending keys."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(keys) else np.zeros(0, np.int64)
    width = min(40, 64 - bits)
    low = (keys >> np.uint64(64 - bits - width)) & np.uint64((1 << width) - 1)
    return bucket[starts], np.append(starts, len(keys)), low


def pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys of up to 40 bits as gaps: their low 24 bits as they are, the 16 above them deflated."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    return np.uint32(len(keys)).tobytes() + np.ascontiguousarray(gaps[:, :3]).tobytes() + zlib.compress(np.ascontiguousarray(gaps[:, 3:5]).tobytes(), 1)


def unpack_keys(raw: bytes) -> np.ndarray:
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    gaps = np.zeros((n, 8), np.uint8)
    gaps[:, :3] = np.frombuffer(raw, np.uint8, 3 * n, 4).reshape(n, 3)
    gaps[:, 3:5] = np.frombuffer(zlib.decompress(raw[4 + 3 * n :]), np.uint8).reshape(n, 2)
    return np.cumsum(gaps.view("<u8").reshape(n), dtype=np.uint64)


def pack_counts(counts: np.ndarray) -> bytes:
    """Counts as one byte each, deflated; those of 255 and more follow as 64-bit integers."""
    large = counts[counts >= 255].astype("<u8")
    return zlib.compress(np.minimum(counts, 255).astype(np.uint8).tobytes() + large.tobytes() + np.uint64(len(large)).tobytes(), 1)


def unpack_counts(raw: bytes) -> np.ndarray:
    raw = zlib.decompress(raw)
    n_large = int(np.frombuffer(raw, "<u8", 1, len(raw) - 8)[0])
    n = len(raw) - 8 - 8 * n_large
    counts = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    counts[counts == 255] = np.frombuffer(raw[n:-8], "<u8").astype(np.int64)
    return counts


def backoff(doc: np.ndarray, place: np.ndarray, ranks: list[np.ndarray], sizes: np.ndarray, counts: list[np.ndarray], total: int, alpha: float = ALPHA, leave_out: bool = True) -> np.ndarray:
    """Score of each document; counts[n - 1][i]: the corpus's count of the n-gram that ends at token i; ranks: distinct()."""
    order = len(ranks)
    if not len(doc):
        return np.zeros(len(sizes))
    others = []
    for rank, c in zip(ranks, counts, strict=True):
        if leave_out:
            _, inverse, own = np.unique(rank * len(sizes) + doc, return_inverse=True, return_counts=True)
            c = c - own[inverse]
        others.append(c)
    rest = (total - sizes * leave_out)[doc]
    seen = others[0] > 0
    score = np.where(seen, np.log(np.maximum(others[0], 1)) - np.log(np.maximum(rest, 1)), -np.log(rest + 1.0))
    for n in range(2, order + 1):
        own, context = others[n - 1], np.empty_like(others[n - 2])
        context[1:], context[0] = others[n - 2][:-1], 1
        better = (place >= n - 1) & (own > 0)
        score = np.where(place >= n - 1, score + np.log(alpha), score)
        score[better] = np.log(own[better]) - np.log(context[better])
    return np.bincount(doc, score, minlength=len(sizes))


def score_corpus(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, leave_out: bool = True) -> DataFrame:
    """doc_id, n_tokens, mean_log_score (0 without tokens), log_score of every row."""
    ship(docs.sparkSession)
    chars = docs.agg(F.coalesce(F.sum(F.char_length("text")), F.lit(0)).alias("chars")).first()["chars"]
    n_chunks = max(1, -(-chars // CHUNK))
    bits = max(6, (chars * order // (6 * BUCKET)).bit_length())
    parts = max(1, min(-(-chars // PARTITION), max(shuffle_partitions(docs.sparkSession), PARTITIONS)))
    chunk = F.pmod(F.xxhash64("doc_id", "text", F.monotonically_increasing_id()), F.lit(n_chunks)).alias("chunk")
    chunked = docs.select("doc_id", F.col("text").cast("binary").alias("text"), chunk).repartition(parts, "chunk")

    def ask(block: pa.Table) -> pa.Table:
        _, place, hashes = ngrams(block.column("text").to_pylist(), order)
        keys, counts, _ = distinct(hashes, place)
        buckets, cuts, low = bucket_runs(keys, bits)
        runs = list(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)) if len(keys) else []
        return pa.table({
            "chunk": pa.array([block.column("chunk")[0].as_py()] * len(runs), pa.int64()), "bucket": pa.array(buckets[: len(runs)], pa.int64()),
            "keys": pa.array([pack_keys(low[a:b]) for a, b in runs], pa.binary()), "counts": pa.array([pack_counts(counts[a:b]) for a, b in runs], pa.binary()),
        })

    def answer(block: pa.Table) -> pa.Table:
        keys = [unpack_keys(k) for k in block.column("keys").to_pylist()]
        counts = np.concatenate([unpack_counts(c) for c in block.column("counts").to_pylist()])
        _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        totals = np.bincount(inverse, counts).astype(np.int64)[inverse]
        cuts = np.cumsum([0, *map(len, keys)]).tolist()
        return pa.table({"chunk": block.column("chunk"), "bucket": block.column("bucket"), "totals": pa.array([pack_counts(totals[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())})

    def look_up(block: pa.Table, answers: pa.Table) -> pa.Table:
        doc, place, hashes = ngrams(block.column("text").to_pylist(), order)
        keys, _, ranks = distinct(hashes, place)
        by_bucket = sorted(zip(answers.column("bucket").to_pylist(), answers.column("totals").to_pylist(), strict=True))
        totals = np.concatenate([np.zeros(0, np.int64), *(unpack_counts(t) for _, t in by_bucket)])
        if len(totals) != len(keys):
            raise RuntimeError("a chunk's answers do not match its requests")
        n = int(totals[np.searchsorted(keys, _EMPTY)]) if len(keys) else 0
        sizes = np.bincount(doc, minlength=block.num_rows)
        score = backoff(doc, place, ranks, sizes, [totals[r] for r in ranks], n, alpha, leave_out)
        return pa.table({"doc_id": block.column("doc_id").cast(pa.int64()), "n_tokens": pa.array(sizes.astype(np.int64)), "mean_log_score": pa.array(score / np.maximum(sizes, 1)), "log_score": pa.array(score)})

    asked = chunked.groupBy("chunk").applyInArrow(ask, "chunk long, bucket long, keys binary, counts binary")
    answered = asked.repartition(parts, "bucket").groupBy("bucket").applyInArrow(answer, "chunk long, bucket long, totals binary")
    answered = answered.repartition(parts, "chunk")
    return chunked.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInArrow(look_up, SCORED)


def relational_scores(docs: DataFrame, order: int = ORDER, alpha: float = ALPHA, leave_out: bool = True) -> DataFrame:
    """The same rows from DataFrame joins alone: exploded n-grams, a count table per order, and a sum per document.

    Plain and linear in rows, but it shuffles every n-gram of every document for every join; for corpora of which a
    shuffle of some fifty times the size is affordable.
    """
    white = r"[ \t\n\x0b\f\r]+"
    words = F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), ascii_uppercase, ascii_lowercase), white), lambda w: w != "")
    rows = materialize(docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), words.alias("words")), "lm-rows")
    tokens = rows.select("row", F.posexplode("words").alias("at", "w"), "words")
    total = rows.agg(F.coalesce(F.sum(F.size("words")), F.lit(0)).alias("n")).first()["n"]
    score = None
    own = F.lit(1 if leave_out else 0)
    for n in range(1, order + 1):
        gram = tokens.where(F.col("at") >= n - 1).select("row", "at", F.slice("words", F.col("at") - n + 2, F.lit(n)).alias("g"))
        table = gram.groupBy("g").agg(F.count("*").alias("c"))
        mine = gram.groupBy("row", "g").agg(F.count("*").alias("m"))
        gram = gram.join(table, "g").join(mine, ["row", "g"]).select("row", "at", (F.col("c") - F.col("m") * own).alias(f"c{n}"))
        score = gram if score is None else score.join(gram, ["row", "at"], "left").join(gram.select("row", (F.col("at") + 1).alias("at"), F.col(f"c{n}").alias(f"x{n}")), ["row", "at"], "left")
        if n == 1:
            score = score.join(gram.select("row", (F.col("at") + 1).alias("at"), F.col("c1").alias("x1")), ["row", "at"], "left")
    rest = F.lit(total) - F.col("size") * own
    value = F.when(F.col("c1") > 0, F.log("c1") - F.log(rest)).otherwise(-F.log(rest + 1.0))
    for n in range(2, order + 1):
        value = F.when(F.col(f"c{n}") > 0, F.log(f"c{n}") - F.log(f"x{n - 1}")).when(F.col("at") >= n - 1, value + F.log(F.lit(alpha))).otherwise(value)
    sized = rows.select("row", "doc_id", F.size("words").cast("bigint").alias("size"))
    summed = sized.join(score, "row", "left").groupBy("row", "doc_id", "size").agg(F.coalesce(F.sum(F.when(F.col("at").isNotNull(), value)), F.lit(0.0)).alias("log_score"))
    return summed.select("doc_id", F.col("size").alias("n_tokens"), (F.col("log_score") / F.greatest("size", F.lit(1))).alias("mean_log_score"), "log_score")
