"""A training-corpus pipeline over ``documents``.

STAGES in order, each taking (spark, docs, sf_dir) and returning the rows it keeps: low-quality
documents go, then exact copies, then all but one of each group of near copies, then documents
that hold a benchmark item; what is left is encoded and decoded.  Every stage's rows are
written as Parquet and reread as the next one's docs.  All stages but the last return the
columns of documents; the last returns the documents' token ids and digests.

Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns are handled
as the operators' modules state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from airshed.llm import decontaminate, exact_dedup, jaccard_join, piece_bpe, quality
from airshed.llm.common import Scratch, read


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier doesn't reject."""
    return quality.keep_good(docs, quality.train(docs, read(spark, sf_dir, "labels")))


def unique(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first of equal documents."""
    return exact_dedup.keep_first(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return jaccard_join.keep_one(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark items."""
    return decontaminate.keep_clean(docs, read(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of the ids and of what they decode to, and the ids, joined by commas."""
    return piece_bpe.encode_documents(docs, piece_bpe.tokenizer_path(), texts=True).drop("decoded")


STAGES = [
    ("quality classifier", good),
    ("exact dedup", unique),
    ("n-gram Jaccard join", distinct),
    ("benchmark decontamination", clean),
    ("SentencePiece encoding and decoding", encoded),
]
#: SQL can express neither the network nor the edit distances; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), f"stage{k + 1}")
    return docs
