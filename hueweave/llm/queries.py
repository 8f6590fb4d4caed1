"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hueweave.llm import graph, hamming, jaccard, language, mixing, pii, sharding, tokens, urls
from hueweave.llm.common import documents
from hueweave.llm.sql import oracle

RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def vocabulary() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op1_url_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


def op2_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hamming.nearest_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op3_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op4_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shards(documents(spark, sf_dir))


def op5_graph_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.nearest_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(documents(spark, sf_dir), vocabulary())


def op7_binary_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.packed(documents(spark, sf_dir), vocabulary())


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_components(documents(spark, sf_dir))


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(documents(spark, sf_dir))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_url_templates, op2_hamming_topk, op3_source_mix, op4_minimax_shards, op5_graph_neighbours, op6_token_counts, op7_binary_packing, op8_ngram_jaccard, op9_personal_data, op10_language)}


def oracle_sql() -> dict[str, str]:
    return oracle(RULES)
