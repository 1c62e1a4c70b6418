"""A training corpus from raw documents: language, near-duplicates, personal data, mixture, tokens.

Every stage takes (spark, docs, sf_dir) and works on all rows of docs; run() writes each stage's rows as Parquet in the
shared folder and reads them back for the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prismloom.llm import language, mixing, pii, simhash, tokens
from prismloom.llm.common import materialize, table
from prismloom.llm.registry import VOCABULARY


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is determined stay as they are; the others go.

    A null text, one without letters and, where no row can be learned from, every text is undetermined and goes. Very
    long texts are read whole; repeated rows are judged alike; languages that tie go by name, which keeps the document
    only if its posterior is at least one half. An empty table stays empty. Further columns, however named, stay.
    """
    return language.accepted(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, the one with the smallest doc_id.

    Null, empty and wordless texts are near-duplicates of each other; very long texts are read whole. Ties of doc_id go
    by the hash of the text; repeated rows are one document; rows that share a doc_id but not a group all stay; a row
    without doc_id stays only where its group has none with one. An empty table stays empty. Further columns,
    however named, stay.
    """
    return simhash.one_of_each(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each span of personal data replaced by its kind, and n_chars, where there is one, counted anew.

    A null text stays null with n_chars null; empty texts, and texts without spans, stay; very long texts are searched
    whole; repeated rows are masked alike; overlapping spans are masked together under the kind that starts first, of
    ties the one that ends first. An empty table stays empty. Further columns, however named, stay.
    """
    masked = pii.masked(docs)
    return masked.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns) if "n_chars" in docs.columns else masked


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to twice.

    Null, empty and wordless texts take no share and go; a null source is a source of its own; very long texts count
    whole; repeated rows stand in the queue each on its own, and as many of them stay as it takes; finish times that tie
    go by source. An empty table stays empty. Further columns, however named, stay.
    """
    return mixing.mixed_documents(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with token_ids (little-endian unsigned 32-bit) and n_tokens in place of text; the ids decode to the text.

    A null or empty text has no tokens; very long texts are read whole; repeated rows are encoded alike; nothing ties, as
    a text has one encoding. An empty table stays empty. Columns named token_ids or n_tokens are replaced, others stay.
    """
    return tokens.encode(docs, tokens.read_vocabulary(VOCABULARY)).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", known_language),
    ("near_dedup", near_dedup),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("tokens", tokenize),
]

#: SQL can't express the learned language model, fingerprints or tokens; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
