"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from reelframe.llm import bpe, embeddings, licences, merkle, mixing, nearcopies, negatives, oracles, orc_tokens, packing, quality, quotations, separators, substrings
from reelframe.llm.shared import table

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")

#: ``<|endoftext|>`` of that vocabulary.
SEPARATOR = 50256


def op1_p_stable_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


def op2_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_digest(table(spark, sf_dir, "documents"))


def op3_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.link_quotations(table(spark, sf_dir, "conversations"))


def op4_minimum_bin_slack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), TOKENIZER)


def op5_rare_word_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licences.scan_licences(table(spark, sf_dir, "documents"))


def op6_count_min_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digest_repeats(table(spark, sf_dir, "documents"))


def op7_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_orc_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orc_tokens.token_files(table(spark, sf_dir, "documents"), TOKENIZER)


def op9_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return separators.token_counts(table(spark, sf_dir, "documents"), TOKENIZER, SEPARATOR)


def op10_bag_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearcopies.near_copies(table(spark, sf_dir, "documents")).drop("digest")


def op11_two_tier_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), RANKS)


def op12_bond_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seventh of all labels are moved on first, so that labels and vectors disagree there."""
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings").withColumn("label", label))


def op13_merkle_descent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_p_stable_vectors, op2_pivotal_mixing, op3_quotation_linking, op4_minimum_bin_slack, op5_rare_word_licences, op6_count_min_substrings, op7_crf_quality, op8_orc_token_files, op9_separator_scan, op10_bag_minhash, op11_two_tier_bpe, op12_bond_negatives, op13_merkle_descent]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        op1_p_stable_vectors.__name__: oracles.NEAR_VECTORS,
        op3_quotation_linking.__name__: quotations.SQL,
        op6_count_min_substrings.__name__: oracles.SUBSTRINGS,
        op10_bag_minhash.__name__: oracles.NEAR_COPIES,
        op12_bond_negatives.__name__: oracles.NEGATIVES,
        op13_merkle_descent.__name__: oracles.MERKLE,
    }
