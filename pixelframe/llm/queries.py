"""The queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pixelframe.llm.common import table
from pixelframe.llm.classifier import quality_scores
from pixelframe.llm.collocations import collocations
from pixelframe.llm.grammar import token_files_roundtrip
from pixelframe.llm.lexical import ranked_search
from pixelframe.llm.lexicon import bpe_digests
from pixelframe.llm.line_rules import line_verdicts
from pixelframe.llm.mixing import mix_sources
from pixelframe.llm.neardup import near_duplicates
from pixelframe.llm.packing import pack_documents
from pixelframe.llm.passages import repeated_passages
from pixelframe.llm.secrets import secret_spans
from pixelframe.llm.sharding import hilbert_shards
from pixelframe.llm.topk import exact_top_k


def op1_linear_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), capacity=2048, tokenizer="word_bpe_49k.json")


def op2_repair_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files_roundtrip(table(spark, sf_dir, "documents"), tokenizer="byte_bpe_50k.json")


def op3_nb_svm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_collinear_chaining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents"))


def op5_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards(table(spark, sf_dir, "documents"), n_shards=16)


def op6_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_texts", "class_links", "links")


def op7_entropy_balancing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op8_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_verdicts(table(spark, sf_dir, "documents")).drop("doc_key", "cut_lines")


def op9_histogram_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_top_k(table(spark, sf_dir, "embeddings"))


def op10_trigram_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans(table(spark, sf_dir, "documents"))


def op11_transducer_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), tokenizer="word_bpe_49k.json")


def op12_pair_bound_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_rabin_karp_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op")}


def oracle_sql() -> dict[str, str]:
    from pixelframe.llm.oracles import ORACLES

    return dict(ORACLES)
