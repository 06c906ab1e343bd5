"""The queries over the operators of this subpackage, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import bpe_table, embed_dedup, huffman, packing, quality, secret_scan, sharding, simhash, suffix, token_counts
from .runtime import checkpoint, table


def op1_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_scores(table(spark, sf_dir, "documents"))


def op2_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_dedup(table(spark, sf_dir, "documents"))


def op3_suffix_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.suffix_dedup(table(spark, sf_dir, "documents"))


def op4_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_table.encode_decode(table(spark, sf_dir, "documents"))


def op5_prefix_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.counts_of(checkpoint(token_counts.prefix_tables(table(spark, sf_dir, "documents"))))


def op6_stratified_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.stratified_shards(table(spark, sf_dir, "documents"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_pack(table(spark, sf_dir, "documents"))


def op8_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan(table(spark, sf_dir, "documents"))


def op9_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.embedding_dedup(table(spark, sf_dir, "embeddings"))


def op10_huffman_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return huffman.huffman_round_trip(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_weak_supervision, op2_simhash_pivots, op3_suffix_cover, op4_distinct_word_bpe, op5_prefix_token_counts, op6_stratified_shards, op7_best_fit_packing, op8_secret_ownership, op9_cross_polytope, op10_huffman_token_ids)}
