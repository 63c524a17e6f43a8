"""A training-data pipeline over documents: clean, deduplicate, mix and pack.

Each stage takes (spark, docs, sf_dir), with docs what the stage before it kept, and returns a DataFrame; all
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fieldloom.llm import chaining, convnet, jaccardjoin, mixing, packing
from fieldloom.llm.common import documents, labels
from fieldloom.session import settled


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the convolutional classifier rejects go."""
    return convnet.accepted(docs, labels(spark, sf_dir))


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of copies and near copies stays."""
    return jaccardjoin.one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that another document holds as well are cut out of all but one; emptied documents go."""
    return chaining.without_repeats(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are brought to their target weights: documents are left out, cut at the budget or repeated."""
    return mixing.mix_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of 1024 tokens."""
    return packing.pack(packing.pieces(docs))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("substring_dedup", substring_dedup),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: The classifier, the dedup stages and the tokenizer are beyond SQL; tests/llm holds each stage's operator against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's own folders go once its result is stored, and so does the table that it read."""
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), docs)
    return docs
