"""A training corpus in five stages over documents: run(spark, sf_dir), or STAGES one by one.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from hueweave.llm.common import documents, small_batches, table
from hueweave.llm.jaccard import one_of_each
from hueweave.llm.language import known_language
from hueweave.llm.mixing import mixed_corpus
from hueweave.llm.pii import sanitised_corpus
from hueweave.llm.queries import vocabulary
from hueweave.llm.tokens import packed


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language; those without a letter, or of no clear language, go."""
    return known_language(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group linked by similar sets of shingles."""
    return one_of_each(docs)


def personal_data_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and terms that disclose it are generalised in the texts; every document stays."""
    return sanitised_corpus(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their target weights: a document comes as often as the mix takes it."""
    return mixed_corpus(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Training sequences: pieces whose lengths are powers of two, with their ids."""
    return small_batches(packed(docs, vocabulary(), with_ids=True))


STAGES = [("language", language_stage), ("near duplicates", near_duplicate_stage), ("personal data", personal_data_stage), ("mixing", mixing_stage), ("packing", packing_stage)]

#: Language models, similarity joins and tokenizers are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else table(docs), sf_dir)
    return docs
