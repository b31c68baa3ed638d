"""A training-corpus pipeline: toxic documents go, one of each near-duplicate group stays, secrets are masked,
sources are mixed to target weights, and the result is packed into sequences.

run() writes every stage's result as Parquet in the shared folder and reads it back as the next stage's documents.
All stages but the last return the columns of documents; whatever else a stage writes is deleted once its result is
there. The mixed corpus repeats documents, so packing sees repeated rows; each is packed as a document of its own.

Defined cases: null and empty texts are not toxic, are copies of each other (one stays), hold no secrets, have no
characters to weigh and pack as the end id alone; rows without doc_id pass the near-copy stage, all of them; rows that
repeat leave one; of equal texts the smallest doc_id stays; a null source is a source of its own; without labels no
document is toxic; empty documents give no pieces; very long texts are read, compared and packed whole; further columns
of documents are kept up to the packing stage, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from turnengine.llm import mixing, packing, secret_scan, simhash, toxicity
from turnengine.llm.common import drop_materialized, materialize, scratch, table
from turnengine.llm.tokens import public_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit_toxicity(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.drop_near_copies(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secret_scan.redact_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.poisson_mix(docs).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs, public_path("word_bpe_49k.json"), "bare", end_id=1)


STAGES: list[tuple[str, Stage]] = [("toxicity", drop_toxic), ("near_dedup", drop_near_copies), ("secrets", mask_secrets), ("mixing", mix_sources), ("packing", pack)]

#: SimHash, a fitted classifier and a tokenizer are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch() as made:
            done = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
            made[:] = [t for t in made if t is not done]
        drop_materialized(docs)
        docs = done
    return docs
