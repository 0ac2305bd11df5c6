"""The corpus pipeline: toxic documents go, near copies go, secrets are masked, sources are mixed to their
target weights, and what is left is packed into training sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from corpusmill.llm import mixing, packing, secrets, simhash, toxicity
from corpusmill.llm.common import materialize, table
from corpusmill.llm.queries import vocabulary
from corpusmill.session import ship


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold, whole rows as they came; null and wordless texts score
    low and stay, repeated rows stay or go together, an empty table stays empty."""
    ship(spark)
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that of the smallest doc_id, null last. Rows that repeat in
    doc_id and text become one; texts without words are copies of one another."""
    ship(spark)
    return simhash.drop_near_duplicates(docs)


def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with each secret in a text replaced by a marker and n_chars brought in line; null texts stay null."""
    return secrets.redact(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, up to three times, dealt to shards in local order; sources with a
    target below their size lose documents, null is a source of its own."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of 2048 tokens; a null or empty text is its separator alone."""
    ship(spark)
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", simhash_stage),
    ("secret scan", secrets_stage),
    ("source mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: No SQL: the first, second and last stages can't be expressed in it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
