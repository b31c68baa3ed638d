"""Text-similarity scores: chrF, BLEU, ROUGE-L, the BERTScore kernel, and their composite.

A score has two steps. The counts of a pair come from an Arrow UDF that reads its two texts and returns a short
array: no n-gram ever becomes a row, so scoring needs no shuffle and its memory is one batch (exploding makes
thousands of rows a pair and shuffles them). The score is a native expression over the counts, the same for a
sentence and for sums over a corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from turnengine.functions.text import tokens_13a, words, words_chrf
from turnengine.storage import measured

CHAR_ORDER, BLEU_ORDER, BETA = 6, 4, 2.0
#: Weights of the composite, in the order they are added up (fixed values).
WEIGHTS = {"chrf": 0.40, "bertscore": 0.30, "bleu": 0.15, "rouge": 0.15}
#: Least similarity of a draft that is kept, and the similarity from which two texts count as identical (fixed values).
THRESHOLD, IDENTICAL = 85.0, 99.995


def _keys(codes: np.ndarray, sizes: np.ndarray, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order up to order: (keys, owners) of the n-grams of all texts; a key tells n-grams and owners apart.

    codes: the numbers of all characters or words, text after text; sizes: how many each text has.
    """
    codes = codes.astype(np.uint64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(codes)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    salt = (owner.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    rolled = np.zeros(len(codes), np.uint64)
    for n in range(1, order + 1):
        rolled[1:] = rolled[:-1].copy()
        rolled[:1] = 0
        rolled = (rolled + codes + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        rolled ^= rolled >> np.uint64(32)
        own = place >= n - 1
        yield (rolled ^ salt)[own], owner[own]


Side = tuple[np.ndarray, np.ndarray]


def _overlaps(hyp: Side, ref: Side, order: int) -> np.ndarray:
    """n-gram counts of hyp, of ref, and of both, for orders 1 to order, of every pair of a batch, by sorting the 64-bit hashes
    of their n-grams. A side is (codes, sizes)."""
    pairs = len(hyp[1])
    out = np.zeros((pairs, 3 * order), np.int64)
    for n, ((a, of_a), (b, of_b)) in enumerate(zip(_keys(*hyp, order), _keys(*ref, order), strict=True)):
        keys, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
        least = np.minimum(np.bincount(inverse[: len(a)], minlength=len(keys)), np.bincount(inverse[len(a) :], minlength=len(keys)))
        owner = np.zeros(len(keys), np.int64)
        owner[inverse] = np.concatenate([of_a, of_b])
        for k, found in enumerate((np.bincount(of_a, minlength=pairs), np.bincount(of_b, minlength=pairs), np.bincount(owner, least, minlength=pairs))):
            out[:, n + k * order] = found
    return out


def _characters(texts: list[str]) -> Side:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32), np.array([len(t) for t in texts], np.int64)


def _words(*sides: pa.Array) -> list[Side]:
    """Lists of words as numbers, the same for the same word on every side."""
    flat = pa.concat_arrays([s.flatten() for s in sides]).dictionary_encode()
    codes = flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    out = []
    for s in sides:
        sizes = pc.fill_null(pc.list_value_length(s), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        out.append((codes[: sizes.sum()], sizes))
        codes = codes[sizes.sum() :]
    return out


_LONGS = T.ArrayType(T.LongType())
#: Bytes or words of the texts that are counted at once; a batch's pairs are counted part by part, a larger pair alone.
PART = 1 << 20


def _rows(counts: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(counts) + 1, dtype=np.int32) * counts.shape[1]), pa.array(counts.ravel()))


def _by_parts(hyp: pa.Array, ref: pa.Array, count: Callable[[pa.Array, pa.Array], np.ndarray]) -> pa.Array:
    """Counts of all pairs of a batch, of about PART of their texts at a time: memory follows neither batch nor table."""
    length = pc.list_value_length if pa.types.is_list(hyp.type) else pc.binary_length
    size = sum(pc.fill_null(length(side), 0).to_numpy(zero_copy_only=False).astype(np.int64) for side in (hyp, ref))
    part = (np.cumsum(size) - size) // PART
    cuts = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), len(part)]
    return _rows(np.concatenate([count(hyp.slice(a, b - a), ref.slice(a, b - a)) for a, b in zip(cuts, cuts[1:], strict=False)]))


@F.arrow_udf(_LONGS)
def char_counts(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    """Character n-grams without white space: 6 counts of hyp, 6 of ref, 6 matches."""

    def count(hyp: pa.Array, ref: pa.Array) -> np.ndarray:
        return _overlaps(*[_characters(["".join((t or "").split()) for t in side.to_pylist()]) for side in (hyp, ref)], CHAR_ORDER)

    return _by_parts(hyp, ref, count)


@F.arrow_udf(_LONGS)
def word_counts_2(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    return _by_parts(hyp, ref, lambda a, b: _overlaps(*_words(a, b), 2))


@F.arrow_udf(_LONGS)
def word_counts_4(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    """Words up to four in a row, and the lengths."""

    def count(hyp: pa.Array, ref: pa.Array) -> np.ndarray:
        sides = _words(hyp, ref)
        return np.column_stack([_overlaps(*sides, BLEU_ORDER), sides[0][1], sides[1][1]])

    return _by_parts(hyp, ref, count)


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bit-parallel rows: one big-integer step per element of b."""
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        hit = row & where.get(w, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


@F.arrow_udf(_LONGS)
def lcs_counts(hyp: pa.Array, ref: pa.Array) -> pa.Array:
    """Words of hyp, of ref, and of their longest common subsequence."""

    def count(hyp: pa.Array, ref: pa.Array) -> np.ndarray:
        sides = _words(hyp, ref)
        pieces = [np.split(codes, np.cumsum(sizes))[:-1] for codes, sizes in sides]
        common = [lcs(a.tolist(), b.tolist()) for a, b in zip(*pieces, strict=True)]
        return np.column_stack([sides[0][1], sides[1][1], np.array(common, np.int64)])

    return _by_parts(hyp, ref, count)


def chrf_counts(hyp: Column, ref: Column, word_order: int = 0) -> list[Column]:
    """Columns of n-gram count arrays: characters, and words of chrF++ if word_order is 2."""
    return [char_counts(hyp, ref), *([word_counts_2(words_chrf(hyp), words_chrf(ref))] if word_order == 2 else [])]


def chrf_score(*counts: Column) -> Column:
    """chrF of count arrays [hyp..., ref..., match...]; orders that either side lacks are left out."""
    precision, recall, n = F.lit(0.0), F.lit(0.0), F.lit(0)
    for c, order in zip(counts, (CHAR_ORDER, 2), strict=False):
        for i in range(order):
            hyp, ref, both = (c[i + k * order] for k in range(3))
            has = (hyp > 0) & (ref > 0)
            precision += F.when(has, F.try_divide(both, hyp)).otherwise(0.0)
            recall += F.when(has, F.try_divide(both, ref)).otherwise(0.0)
            n += F.when(has, 1).otherwise(0)
    p, r = F.try_divide(precision, n), F.try_divide(recall, n)
    return F.coalesce(F.try_divide((1 + BETA**2) * p * r, BETA**2 * p + r), F.lit(0.0)) * 100.0


def bleu_counts(hyp: Column, ref: Column) -> Column:
    return word_counts_4(tokens_13a(hyp), tokens_13a(ref))


def bleu_score(c: Column, effective_order: bool) -> Column:
    """BLEU with exponential smoothing. effective_order: orders the hypothesis is too short for are left out."""
    logs, zeros, orders, matches = F.lit(0.0), F.lit(0), F.lit(0), F.lit(0).cast("bigint")
    open_ = F.lit(True)
    for i in range(BLEU_ORDER):
        total, both = c[i], c[i + 2 * BLEU_ORDER]
        open_ = open_ & (total > 0)
        zeros = zeros + F.when(open_ & (both == 0), 1).otherwise(0)
        chance = F.when(both > 0, F.try_divide(100.0 * both, total)).otherwise(F.try_divide(F.lit(100.0), F.pow(F.lit(2.0), zeros) * total))
        logs = logs + F.when(open_, F.log(chance)).otherwise(0.0 if effective_order else -1e10)
        orders = orders + F.when(open_, 1).otherwise(0 if effective_order else 1)
        matches = matches + both
    hyp, ref = c[3 * BLEU_ORDER], c[3 * BLEU_ORDER + 1]
    brevity = F.when(hyp >= ref, 1.0).otherwise(F.exp(1 - F.try_divide(ref, hyp)))
    return F.when((matches > 0) & (hyp > 0), brevity * F.exp(F.try_divide(logs, orders))).otherwise(0.0)


def rouge_score(c: Column) -> Column:
    """ROUGE-L F1 of [hyp, ref, lcs]."""
    p, r = F.try_divide(c[2], c[0]), F.try_divide(c[2], c[1])
    return F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)) * 100.0


def similarity(chrf: Column, bleu: Column, rouge: Column, bertscore: Column | None = None) -> Column:
    """Weighted composite in [0, 100]; without BERTScore the other weights are scaled up."""
    found = {"chrf": chrf, "bertscore": bertscore, "bleu": bleu, "rouge": rouge}
    mass = 1.0 if bertscore is not None else 1.0 - WEIGHTS["bertscore"]
    total = None
    for name, weight in WEIGHTS.items():
        if found[name] is not None:
            term = F.lit(weight / mass) * found[name]
            total = term if total is None else total + term
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), total))


def score_pairs(pairs: DataFrame, word_order: int = 0) -> DataFrame:
    """pairs with count arrays c_chrf, c_words (chrF++ only), c_bleu, c_rouge; no shuffle: pairs stay where they are."""
    hyp, ref = F.col("gemma"), F.col("golden")
    counts = chrf_counts(hyp, ref, word_order)
    out = pairs.withColumn("c_chrf", counts[0])
    if word_order == 2:
        out = out.withColumn("c_words", counts[1])
    return out.withColumn("c_bleu", bleu_counts(hyp, ref)).withColumn("c_rouge", lcs_counts(words(hyp), words(ref)))


def sentence_scores(pairs: DataFrame, word_order: int = 0, keep_counts: bool = False) -> DataFrame:
    """pairs with chrf, bleu, rouge; 0 where either side is empty. keep_counts: and the count arrays."""
    scored = score_pairs(pairs, word_order)
    both = (F.col("gemma") != "") & (F.col("golden") != "")
    chrf = chrf_score(F.col("c_chrf"), *([F.col("c_words")] if word_order == 2 else []))
    values = {"chrf": chrf, "bleu": bleu_score(F.col("c_bleu"), True), "rouge": rouge_score(F.col("c_rouge"))}
    out = scored.withColumns({k: F.when(both, v).otherwise(0.0) for k, v in values.items()})
    return out if keep_counts else out.drop("c_chrf", "c_words", "c_bleu", "c_rouge")


def decisions(pairs: DataFrame, threshold: float = THRESHOLD, word_order: int = 0, bertscore: Column | None = None, keep_counts: bool = False) -> DataFrame:
    """sentence_scores with similarita and sostituire (similarity below threshold, not rounded)."""
    scored = sentence_scores(pairs, word_order, keep_counts)
    scored = scored.withColumn("bertscore", bertscore if bertscore is not None else F.lit(0.0))
    value = similarity(F.col("chrf"), F.col("bleu"), F.col("rouge"), F.col("bertscore") if bertscore is not None else None)
    return scored.withColumn("similarita", value).withColumn("sostituire", F.col("similarita") < F.lit(float(threshold)))


def _sizes(word_order: int) -> dict[str, int]:
    return {"c_chrf": 3 * CHAR_ORDER, "c_bleu": 3 * BLEU_ORDER + 2} | ({"c_words": 6} if word_order == 2 else {})


def _corpus_of(total: DataFrame, word_order: int) -> DataFrame:
    return total.select(chrf_score(F.col("c_chrf"), *([F.col("c_words")] if word_order == 2 else [])).alias("corpus_chrf"), bleu_score(F.col("c_bleu"), False).alias("corpus_bleu"))


def corpus_scores(pairs: DataFrame, word_order: int = 0) -> DataFrame:
    """One row: corpus chrF and BLEU of counts summed over all pairs, empty ones included."""
    total = score_pairs(pairs, word_order).agg(*[F.array(*[F.coalesce(F.sum(F.col(c)[i]), F.lit(0)) for i in range(n)]).alias(c) for c, n in _sizes(word_order).items()])
    return _corpus_of(total, word_order)


_MEANS = ("chrf", "bleu", "rouge", "similarita", "bertscore")


def _summary() -> dict[str, Column]:
    counts = {"pairs": F.count("*"), "to_replace": F.count_if("sostituire"), "identical": F.count_if(F.col("similarita") >= IDENTICAL)}
    return counts | {f"mean_{c}": F.avg(c) for c in _MEANS}


def score_summary(scored: DataFrame) -> DataFrame:
    """One row: pairs, to_replace, identical, and the mean of every score (zeros included)."""
    return scored.agg(*[c.alias(n) for n, c in _summary().items()])


def written_scores(scored: DataFrame, word_order: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(table, score_summary, corpus_scores) of decisions with keep_counts: both summaries are observed in the pass that
    scores the pairs and writes them, so nothing is scored or read again for them."""
    sizes = _sizes(word_order)
    sums = {f"{c}_{i}": F.sum(F.col(c)[i]) for c, n in sizes.items() for i in range(n)}
    table, seen = measured(scored, "scores", **_summary(), **sums)
    spark = scored.sparkSession
    head = spark.createDataFrame([tuple(seen[n] for n in _summary())], ", ".join(f"{n} {'long' if not n.startswith('mean') else 'double'}" for n in _summary()))
    total = spark.createDataFrame([tuple([seen[f"{c}_{i}"] or 0 for i in range(n)] for c, n in sizes.items())], ", ".join(f"{c} array<long>" for c in sizes))
    return table.drop("c_chrf", "c_words", "c_bleu", "c_rouge"), head, _corpus_of(total, word_order)


def greedy_match(vectors: DataFrame) -> DataFrame:
    """The BERTScore kernel: precision, recall, f1 (x 100) per pair of greedy cosine matching.

    vectors: pair_id, side (hyp or ref), pos, embedding. Tokens meet only tokens of their own pair, so the join is
    as large as the product of two sentence lengths.
    """
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))
    unit = vectors.select("pair_id", "side", "pos", F.transform("embedding", lambda x: x.cast("double")).alias("v"), norm.alias("norm"))
    hyp = unit.where("side = 'hyp'").select("pair_id", F.col("pos").alias("i"), F.col("v").alias("hv"), F.col("norm").alias("hn"))
    ref = unit.where("side = 'ref'").select("pair_id", F.col("pos").alias("j"), F.col("v").alias("rv"), F.col("norm").alias("rn"))
    dot = F.aggregate(F.zip_with("hv", "rv", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    pairs = hyp.join(ref, "pair_id").select("pair_id", "i", "j", F.coalesce(F.try_divide(dot, F.col("hn") * F.col("rn")), F.lit(0.0)).alias("cos"))
    p = pairs.groupBy("pair_id", "i").agg(F.max("cos").alias("m")).groupBy("pair_id").agg(F.avg("m").alias("p"))
    r = pairs.groupBy("pair_id", "j").agg(F.max("cos").alias("m")).groupBy("pair_id").agg(F.avg("m").alias("r"))
    return p.join(r, "pair_id").select("pair_id", (F.col("p") * 100).alias("precision"), (F.col("r") * 100).alias("recall"), (F.coalesce(F.try_divide(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r")), F.lit(0.0)) * 100).alias("f1"))
