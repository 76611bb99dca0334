"""The corpus pipeline: five stages, each on all rows that the one before it kept.

Learned stages learn from the rows they are given (language, toxicity with the labels table beside them), outside the held-out part, and then judge every
row. Rows go only where a stage rejects them: text without letters or far from every language, text scored as toxic, all but one text
of each near-duplicate component, text with a benchmark window. Every stage but the last returns the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from facewave.llm import bpe, jaccard_join, langid, suffix_arrays, toxicity
from facewave.llm._shared import stored


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what language identification rejects."""
    model = langid.fit(docs.where(~langid.held_out()))
    return langid.accepted(docs, model)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what scores as toxic."""
    model = toxicity.fit(docs.where(~langid.held_out()), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accepted(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each component; rows that share an id are judged each by its text."""
    return jaccard_join.keep_one(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark text."""
    return suffix_arrays.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes every text and decodes it again: (doc_id, n_tokens, ids_sha256, decoded_sha256)."""
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("language", language),
    ("toxicity", toxic),
    ("near_duplicates", near_duplicates),
    ("benchmark", benchmark),
    ("bpe", tokens),
]

#: SQL cannot express the learned stages. The tests compare near duplicates and benchmark with brute force, and the learned stages with what was planted.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
