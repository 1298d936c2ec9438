"""The queries of this subpackage, each over the whole of its table, and SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, host_rules, langid, line_dedup, packing, pivot_index, quality_mil, simhash_trie, token_store, toxicity
from .common import read_documents

Query = Callable[[SparkSession, str], DataFrame]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_documents(spark, sf_dir))


def op2_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.store_digest(read_documents(spark, sf_dir))


def op3_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pivot_index.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op4_attention_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.quality(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_rules.apply_rules(read_documents(spark, sf_dir)).drop("host_rate")


def op6_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(read_documents(spark, sf_dir), wide=True).select("doc_id", "text")


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_documents(spark, sf_dir), ids=False)


def op8_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_trie.digest(simhash_trie.near_duplicates(read_documents(spark, sf_dir)))


def op9_language_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.languages(read_documents(spark, sf_dir)).drop("lang_set")


def op10_nbsvm_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Query] = {
    "op1_bpe": op1_bpe,
    "op2_token_orc": op2_token_orc,
    "op3_pivot_permutation": op3_pivot_permutation,
    "op4_attention_mil": op4_attention_mil,
    "op5_host_rules": op5_host_rules,
    "op6_fuzzy_lines": op6_fuzzy_lines,
    "op7_harmonic_packing": op7_harmonic_packing,
    "op8_simhash_trie": op8_simhash_trie,
    "op9_language_mixture": op9_language_mixture,
    "op10_nbsvm_toxicity": op10_nbsvm_toxicity,
}

ORACLE_SQL: dict[str, str] = {"op5_host_rules": host_rules.SQL}
