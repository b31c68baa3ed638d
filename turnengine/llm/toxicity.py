"""Toxicity by weak supervision: voters, a generative label model, a linear classifier on its posterior labels.

1. Sample: at most SAMPLE_ROWS labelled training rows, dealt by a hash of the document id (rows whose
   crc32(doc_id) mod 4 is 2 are held out and never learned from). Only the fit is bounded; scoring covers all.
2. Lexicon: words that mark toxic rows of the sample, counted relationally. A word's support is the number of its
   toxic rows, or of distinct words it was found after in them if that is less, so that copies of one text do not
   count again and again.
3. Voters: one per lexicon word, and patterns over the whole text (any hit, several, dense or sparse hits, two in a
   row, no hit at all). A voter says toxic, clean or nothing.
4. Label model: a generative model of the votes, fitted by EM without labels but for the share of toxic rows, which
   the posteriors are held to: each voter's chances of each vote under either class (its accuracies), and the
   correlations of the voters' residuals given the class, first under the majority vote, then under the fit; a voter
   that repeats what others say counts for less, and EM runs again.
5. Classifier: logistic regression on the voters' features, trained on the posterior labels and on nothing else. The
   labels themselves choose the words of step 2 and give the share of step 4; no weight is fitted to them.

Rows with the same features are one row with a count before they reach the driver, and every sum of the fit is over
those counts. The fit is bounded by its labelled rows alone: SAMPLE_ROWS for the lexicon, and for what follows SAMPLE_CELLS, rows
times features; the lexicon holds every word with enough evidence.

The score reads the text alone: not labels, lang, source or doc_id. Defined cases: null and empty texts score as
texts without words; a null doc_id is not held out; labels that are null or of unknown documents are ignored;
repeated label rows count once, a document labelled both ways as toxic; without any usable label every score is
the share that smoothing gives; an empty table gives no rows; extra columns are not read by the query and are kept
by the filter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnengine.llm.common import drop_materialized, materialize, ship

#: Bounds of the fit: labelled rows taken, and of these times features where the label model and the classifier see them.
SAMPLE_ROWS, SAMPLE_CELLS = 40_000, 12_000_000
#: A lexicon word has at least this support, and support times the log of how much likelier it is in
#: toxic rows; and it is at least so many times likelier there.
MIN_SUPPORT, MIN_EVIDENCE, MIN_ODDS = 3, 14.0, 8.0
THRESHOLD = 0.3
#: Hits are dense from one in so many words on.
DENSE = 150
_WORD = re.compile(r"[^\W_]+")
#: Names of the features that follow those of the words.
PATTERNS = ("any", "several", "dense", "in_a_row", "none", "sparse", "rate")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def features(text: str | None, lexicon: dict[str, int]) -> np.ndarray:
    """Word features log(1 + count), then the patterns as 0 or 1."""
    text = text or ""
    words = _WORD.findall(text.lower())
    out = np.zeros(len(lexicon) + len(PATTERNS), np.float32)
    hits, row, before = 0, False, -9
    for i, w in enumerate(words):
        k = lexicon.get(w)
        if k is not None:
            out[k] += 1
            hits += 1
            row |= i - before == 1
            before = i
    n = len(lexicon)
    np.log1p(out[:n], out=out[:n])
    out[n:] = (hits > 0, hits >= 3, hits * DENSE >= len(words) > 0, row, not hits, 0 < hits * DENSE < len(words), np.log1p(100 * hits / max(len(words), 1)))
    return out


def votes(x: np.ndarray, n_words: int) -> np.ndarray:
    """Votes (1 toxic, -1 clean, 0 nothing) of all voters from rows of features."""
    v = (x[:, : n_words + 6] > 0).astype(np.int8)  # the rate is a feature, not a voter
    v[:, n_words + 4 : n_words + 6] *= -1
    return v


def held_to(log_odds: np.ndarray, counts: np.ndarray, share: float) -> np.ndarray:
    """Posteriors of rows by their log odds plus an offset that makes their mean, over counts, the share."""
    low, high = -100.0, 100.0
    for _ in range(60):
        mid = (low + high) / 2
        post = 1 / (1 + np.exp(-np.clip(log_odds + mid, -40, 40)))
        low, high = (mid, high) if post @ counts < share * counts.sum() else (low, mid)
    return post


def label_model(v: np.ndarray, counts: np.ndarray, share: float, rounds: int = 25) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posterior of toxic per row, accuracy table [voter, class, vote + 1], correlation matrix) from votes, how often
    each row of votes occurs, and the share of toxic rows."""
    counts = counts.astype(np.float64)
    share = float(np.clip(share, 0.005, 0.995))
    said = [(v == vote).astype(np.float32) for vote in (-1, 0, 1)]
    weight = np.ones(v.shape[1])

    def accuracies(post: np.ndarray) -> np.ndarray:
        mass = np.stack([(1 - post) * counts, post * counts]).astype(np.float32)
        table = np.stack([mass @ s for s in said], axis=2).transpose(1, 0, 2) + 0.1
        return table / table.sum(axis=2, keepdims=True)

    for stage in range(3):
        post = np.where(v @ weight > 0, 0.9, 0.02)  # weighted majority vote
        for _ in range(rounds if stage else 0):
            log = np.log(accuracies(post))
            odds = (log[:, 1] - log[:, 0]) * weight[:, None]
            post = held_to(sum(s @ odds[:, k] for k, s in enumerate(said)), counts, share)
        table = accuracies(post)
        mean = table @ np.array([-1.0, 0.0, 1.0])
        rest = v - (np.outer(1 - post, mean[:, 0]) + np.outer(post, mean[:, 1]))
        rest -= counts @ rest / max(counts.sum(), 1)
        cross = (rest * counts[:, None]).T @ rest / max(counts.sum(), 1)
        spread = np.maximum(np.sqrt(np.diag(cross)), 1e-6)
        corr = cross / np.outer(spread, spread)
        np.fill_diagonal(corr, 1.0)
        # voters that always agree count as one together; the cube lets weak correlations of many voters pass
        weight = 1 / np.maximum((np.clip(corr, 0, 1) ** 3).sum(axis=1), 1.0)
    return post, table, corr


def logistic(x: np.ndarray, y: np.ndarray, counts: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Weights (the last is the offset) of a logistic regression on soft labels of rows that occur counts times, by Newton's method."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-3
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * ((p * (1 - p) + 1e-6) * counts)[:, None]).T @ x + np.diag(penalty), x.T @ ((p - y) * counts) + penalty * w)
        w -= np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-6:
            break
    return w


@dataclass(frozen=True)
class ToxicityModel:
    lexicon: tuple[str, ...]
    weights: tuple[float, ...]

    def score(self, texts: list[str | None]) -> np.ndarray:
        index = {w: i for i, w in enumerate(self.lexicon)}
        w = np.array(self.weights)
        raw = np.array([features(t, index) @ w[:-1] + w[-1] for t in texts])
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def training_sample(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of at most about SAMPLE_ROWS labelled rows that are not held out."""
    usable = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    usable = materialize(usable, "tox-labels")
    n = usable.count()
    share = min(1.0, SAMPLE_ROWS / max(n, 1))
    sample = usable.where(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 20)) < int(share * (1 << 20)))
    sample._turnengine_path = usable._turnengine_path
    return sample


def learn_lexicon(train: DataFrame) -> list[str]:
    """Words of train (text, toxic) that mark toxic rows, the strongest first: as many as have the evidence."""
    words = F.filter(F.split(F.lower(F.coalesce("text", F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: F.length(w) > 1)
    toxic = F.col("toxic") > 0
    size = F.greatest(F.size("words") - 1, F.lit(0))
    after = F.arrays_zip(F.slice("words", 2, size).alias("w"), F.transform(F.slice("words", 1, size), lambda p: F.xxhash64(p)).alias("c"))
    once = F.transform(F.array_distinct("words"), lambda w: F.struct(w.alias("w"), F.lit(0).cast("bigint").alias("c")))
    in_toxic, per_row = F.col("toxic"), F.col("c") == 0
    found = (
        train.select(words.alias("words"), "toxic")
        .select(F.explode(F.when(toxic, F.concat(once, F.array_distinct(after))).otherwise(once)).alias("x"), toxic.alias("toxic"))
        .groupBy("x.w", "x.c", "toxic")
        .agg(F.count("*").alias("n"))
        .groupBy("w")
        .agg(*[F.coalesce(F.sum(F.when(rows, n)), F.lit(0)).alias(name) for name, rows, n in (("pos", in_toxic & per_row, F.col("n")), ("contexts", in_toxic & ~per_row, F.lit(1)), ("neg", ~in_toxic, F.col("n")))])
        .withColumn("support", F.least("pos", "contexts"))
        .where(F.col("support") >= MIN_SUPPORT)
    )
    seen = train.agg(F.count_if(toxic).alias("tox"), F.count_if(~toxic).alias("clean")).first()
    odds = ((F.col("pos") + 0.5) / float(seen["tox"] + 1)) / ((F.col("neg") + 0.5) / float(seen["clean"] + 1))
    best = found.withColumn("evidence", F.col("support") * F.log(odds)).where(F.col("evidence") >= MIN_EVIDENCE).where(odds >= MIN_ODDS).orderBy(F.col("evidence").desc(), "w")
    return [r["w"] for r in best.collect()]  # words of SAMPLE_ROWS rows at most, each with its evidence in them


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    ship(docs.sparkSession)
    sample = training_sample(labels)
    # the sample's rows are bounded by SAMPLE_ROWS, so its broadcast is too
    train = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("text", "toxic").dropDuplicates()
    # what follows explodes words, so the few rows are dealt to all cores
    train = materialize(train.repartition(4 * docs.sparkSession.sparkContext.defaultParallelism, "text"), "tox-train")
    lexicon = learn_lexicon(train)
    index = {w: i for i, w in enumerate(lexicon)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(features(t, index).tobytes(), 1) for t in batch.column(0).to_pylist()], pa.binary()), batch.column(1).cast(pa.int32())], names=["x", "toxic"])

    n = train.count()
    if n * (len(lexicon) + len(PATTERNS)) > SAMPLE_CELLS:
        train_share = SAMPLE_CELLS / (n * (len(lexicon) + len(PATTERNS)))
        some = train.where(F.pmod(F.xxhash64("text", F.lit("cells")), F.lit(1 << 20)) < int(train_share * (1 << 20)))
    else:
        some = train
    rows = some.mapInArrow(run, "x binary, toxic int").groupBy("x").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).toArrow()  # SAMPLE_ROWS rows at most, mostly zeros
    drop_materialized(train)
    drop_materialized(sample)
    x = np.frombuffer(b"".join(map(zlib.decompress, rows.column(0).to_pylist())), np.float32).reshape(-1, len(lexicon) + len(PATTERNS))
    counts = rows.column(1).to_numpy().astype(np.float64)
    if not len(x):
        return ToxicityModel(tuple(lexicon), (0.0,) * (len(lexicon) + len(PATTERNS)) + (-2.0,))
    post, _, _ = label_model(votes(x, len(lexicon)), counts, float(rows.column(2).to_numpy().sum() / counts.sum()))
    return ToxicityModel(tuple(lexicon), tuple(logistic(x, post, counts).tolist()))


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = model.score(batch.column(2).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), batch.column(1), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The rows of docs, all columns, whose score is below THRESHOLD."""
    ship(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(model.score(batch.column(at).to_pylist()) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
