"""A corpus pipeline of five of the training-data operators, each stage working on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from queuelens.llm import langid, mixing, packing, perplexity, simhash
from queuelens.llm.common import materialize, read_table
from queuelens.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie within the perplexity band of their language."""
    return perplexity.keep_good(docs)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told with a score of one half or more and whose code is no longer than held-out texts
    of that language need; all labelled documents may teach."""
    return langid.keep_known(docs, langid.fit(docs, F.lit(True), limits=True))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the smallest id's, of each class of SimHash fingerprints (4-word shingles, at most 4 bits apart)."""
    return simhash.first_of_each_class(docs, shingle=4, budget=4)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated so that all sources have the same share of the text, globally shuffled."""
    return mixing.replicated(docs).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their ids, placed into sequences of 2048 ids."""
    pieces, assignment = packing.packed(docs, tokenizer_path(), end_id=1, length=2048)
    return pieces.join(assignment, "piece_id").select(
        F.col("id").alias("doc_id"), "piece_id", "start", "length", "doc_tokens", "sequence_id", "offset", "tokens")


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", quality_rules),
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]

#: SQL can express neither the models nor the classes of the stages; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is stored in the shared work folder and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
