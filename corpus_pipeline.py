"""From raw documents to token ids: language filter, near-duplicates, personal data, source mix, byte-level BPE.

All stages but the last return the columns of documents, also where a table has
more of them or calls them like a stage's own; empty tables give empty results;
texts are read whole, however long.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loamgraph.llm import bpe, langid, mixing, pii, shingles
from loamgraph.session import materialise


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with letters and one language that holds half of them at least; learned from the labels among docs.

    Null and empty texts go, null labels teach nothing; repeated rows stay or go together.
    """
    return langid.keep_identified(docs, langid.fit(docs, F.lit(True)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each component at Jaccard 0.75 on five-word shingles.

    Texts without words, null ones among them, and rows without an id all stay; of rows that repeat an id one stays.
    """
    return shingles.keep_one(docs)


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data and the terms that disclose it replaced in the text, and n_chars counted anew.

    Null and empty texts stay as they are, repeated rows stay repeated and are changed alike.
    """
    return pii.sanitise(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Texts without words, null ones among them, are never taken; a null source is a source; each repeated row counts for itself.
    """
    return mixing.mixed_documents(docs)


def encode_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, ids and n_tokens of each document: a row per row. A null text has no ids."""
    return bpe.encode_documents(docs, public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_languages),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", remove_personal_data),
    ("source_mix", mix_sources),
    ("byte_bpe", encode_bytes),
]

#: SQL has neither the language model nor BPE; tests/llm/test_pipeline.py compares run() with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
