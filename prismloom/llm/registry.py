"""The queries opN_<name> of this subpackage, each over its whole intended table, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from prismloom.llm import alignment, divergence, language, media, minhash, mixing, pages, pii, quality, scoring, simhash, substrings, tokens
from prismloom.llm.common import table


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


#: The vocabulary file of the byte-level tokenizer; other files of plain byte-level merges do as well.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.digests(table(spark, sf_dir, "documents"), tokens.read_vocabulary(VOCABULARY))


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No table holds recordings: each vector of `embeddings` becomes one, a tune of its 64 numbers."""
    recordings = media.vector_recordings(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return media.align(recordings).withColumnRenamed("rec_id", "vec_id")


def op7_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(table(spark, sf_dir, "documents"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.pseudo_likelihood(table(spark, sf_dir, "documents"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


#: The model of the sentencepiece tokenizer that op11 aligns with VOCABULARY.
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), alignment.read_vocabularies(VOCABULARY, PIECES))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(table(spark, sf_dir, "documents"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality_rules": op1_quality_rules,
        "op2_pii": op2_pii,
        "op3_bpe": op3_bpe,
        "op4_language_id": op4_language_id,
        "op5_mixing": op5_mixing,
        "op6_media": op6_media,
        "op7_substrings": op7_substrings,
        "op8_simhash": op8_simhash,
        "op9_lm_scoring": op9_lm_scoring,
        "op10_html": op10_html,
        "op11_alignment": op11_alignment,
        "op12_divergence": op12_divergence,
        "op13_minhash": op13_minhash,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_mixing": mixing.ORACLE, "op12_divergence": divergence.ORACLE}
