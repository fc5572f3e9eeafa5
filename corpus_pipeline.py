"""Corpus preparation: language ID, near-duplicates, decontamination, secrets, token pieces.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; `run` writes each result as Parquet into the shared
folder and gives it to the next stage. All stages but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lotwise.llm import language_codes, piece_codec, pivot_simhash, secret_crf, suffix_automaton
from lotwise.llm.queries import labelled_documents, table, tokenizer_path
from lotwise.session import cut_lineage


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a recognisable language (null, or no letter) go."""
    model = language_codes.train_language_codes(labelled_documents(docs))
    return language_codes.keep_identified(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked fingerprints stays, the one with the least id."""
    return pivot_simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with one word in twenty, or more, inside benchmark passages go."""
    return suffix_automaton.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark in the text; no document goes."""
    return secret_crf.redact_secrets(docs, secret_crf.train_secret_field(docs), length_col="n_chars")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document, checked by decoding them."""
    return piece_codec.checked_pieces(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [
    ("language_id", identify_languages),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secret_scan", redact_secrets),
    ("sentencepiece", encode_pieces),
]

# The trained models, the components and the split into pieces are not sayable in SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = cut_lineage(stage(spark, docs, sf_dir), name)
    return docs
