"""A corpus pipeline: quality rules, exact dedup, near-dedup, secret scans, packing; each stage's output is written and read again.

Cases: null, empty and blank texts fail the quality rules and go there; a null source is the host ''; a null doc_id counts as smaller than any other in exact
dedup and is packed like any; repeated rows are copies of each other; very long texts are read whole; an empty table gives an empty result of every
stage; all stages but the last keep all columns, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from leadloom.llm import exact_dedup, packing, quality, secrets, simhash
from leadloom.llm.common import cut


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are not depleted, without the lines above their host's limit.

    Exact copies are still in the table here and are the next stage's task, so a line counts once for copies: a clean text stays, however often it was copied.
    """
    return quality.clean(docs, count="texts")


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest doc_id."""
    return exact_dedup.keep_one(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, the document with the smallest doc_id."""
    return simhash.keep_one_similar(docs)


def remove_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("secret scans", remove_secrets),
    ("best-fit packing", pack_sequences),
]

#: The stages hash, learn and tokenise; SQL can't say the same. tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
