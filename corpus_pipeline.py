"""A corpus pipeline over ``documents``: each stage works on all that the stage before it kept.

Cases: a null or empty text has no letter and goes in the first stage; rows without lang are judged, but not learned
from; without labels of both classes nothing is toxic; rows that repeat a doc_id are one document to the third stage;
rows without a doc_id stay through all stages; texts of any length are worked on whole; ties between languages go to the
first by name, and of near-duplicates the least doc_id stays; empty tables give an empty result; further columns of any
name go along up to the last stage, which returns its own four.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sillon.llm import bpe_codec, decontaminate, langid, minhash, toxicity
from sillon.llm.common import fold, fresh, materialize
from sillon.sources.tables import table


#: Entries of the codec's caches, and bytes of text that it works on together: executors still hold what the stages before
#: have grown.
CODEC_ENTRIES, CODEC_BLOCK = 60_000, 1 << 18


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that a learned language explains; those without letters or in no such language go."""
    model = langid.train(langid.sample(docs, "text", "lang"))
    own = fresh(docs.columns)
    found = langid.identify(docs, model, prefix=own)
    gone = langid.rejected(model, F.col(f"{own}lang_pred"), F.col(f"{own}phrase_letters"), F.col(f"{own}letters"))
    return found.filter(~gone).select(*docs.columns)


def toxic_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that aren't predicted to be toxic, by what the labels of four folds of five teach."""
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), fold(F.col("doc_id"), 5) != 0)
    own = fresh(docs.columns)
    return toxicity.score(docs, model, prefix=own).filter(F.col(f"{own}predicted") == 0).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-duplicates."""
    return minhash.deduplicate(docs)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents without a passage of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Number of tokens and digests of ids and decoded bytes of each document."""
    return bpe_codec.round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), entries=CODEC_ENTRIES, block=CODEC_BLOCK)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("toxicity", toxic_text),
    ("near_dedup", near_duplicates),
    ("decontamination", benchmark_passages),
    ("bpe_codec", tokens),
]

#: SQL can't express the trained models or the merges; tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each but the last is written to the shared folder and read back."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
