"""The corpus pipeline: from raw documents to packed sequences. Every stage reads what the one before kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from marginalia.llm import mixing, near_duplicates, packing, pseudonyms, quality
from marginalia.llm.common import materialize


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised rules keep. Null, empty and short texts (fewer than 50 words) and those that repeat
    themselves go; repeated rows vote and stay as often as they occur; a table without rows gives none."""
    return quality.good_rows(docs)


def near_duplicate_removal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the first by doc_id, of each group that shares five-word shingles at a similarity of 0.8 or more. Rows with a
    null doc_id stay; rows that repeat a doc_id are one document and stay or go together; texts without words are like no other."""
    return near_duplicates.deduplicated(docs, k=5, percent=80)


def pii_pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents with pseudonyms for personal data; the key is a fixture, a real run gets its own from a secret store. A null
    text stays null, all other columns and repeated rows stay as they are."""
    return pseudonyms.pseudonymize(docs, key="fixture", spans="_pii_spans").select(*docs.columns)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's repetition rate asks for. A null source is a source of its own; rows with one doc_id, or
    none, share a draw; a source without words is taken 0 times."""
    return mixing.mix(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The training sequences: one row a piece of at most 1024 tokens, with its token ids and where it stands in which sequence. Copies of
    a document are pieces of their own under its doc_id; a null text is the end token alone."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [(f.__name__, f) for f in (quality_rules, near_duplicate_removal, pii_pseudonyms, source_mixing, best_fit_packing)]

#: Expectation-maximisation, MinHash, Feistel networks and tokenizers have no SQL; tests/llm hold each against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what each returns is written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
