"""A training corpus from raw documents: five stages, each one operator of ``sluice.llm``.

Each stage takes the documents that its predecessor kept, written as Parquet and read
again, and works on all of them.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from sluice.llm import exact_dedup, language_id, mixing, near_dedup, sentencepiece_fst
from sluice.llm.shared import dropped, recorded, removed, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language (null text or no letter); learns from the stage's own labelled rows."""
    model = language_id.train(docs.where(~language_id.held_out()))
    found, score = (f"language_{uuid.uuid4().hex}" for _ in range(2))  # no input column has these names
    named = language_id.identify(docs, model, found, score)
    return named.where(named[found] != language_id.UNDETERMINED).select(*[f"`{c}`" for c in docs.columns])


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops all but the first of equal texts."""
    return exact_dedup.deduplicated(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops all but one document of each group of near copies (similarity 0.80 or more)."""
    return near_dedup.without_near_copies(docs, percent=80)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes from each source what its weight asks for: a row for each document and epoch, with the drawn words."""
    return mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds ``piece_ids``, the SentencePiece encoding of the text."""
    return sentencepiece_fst.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("sentencepiece", tokens)]

#: SQL can't express near duplicates by banding, keyed permutations or SentencePiece.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages, each written and read again; what a stage wrote on its way goes once its result is there."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with recorded() as made:
            out = stage(spark, docs, sf_dir)
        docs = written(out, f"pipeline-{name}")
        removed(spark, *made)
        if before is not None:
            dropped(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
