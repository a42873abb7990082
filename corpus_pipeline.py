"""A training-data pipeline over documents: quality rules, near-duplicates, secrets,
source mixing, packing. Each stage takes (spark, docs, sf_dir) and works on all rows
that the one before it kept; all but the last return the columns of documents.

Defined cases: null and empty texts fail the quality rules; ids may be null or repeated, as
documents are told apart by their texts; of equal rows one stays; long texts are whole
until they are packed; columns of any name stay up to the mix; an empty table gives no rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cmdlake.llm import dedup, mixing, packing, quality, secrets
from cmdlake.llm._shared import new_path
from cmdlake.llm.tokens import tokenizer_path

Docs = DataFrame


def quality_rules(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Documents that a base rule or a rule of the cascade rejects go."""
    return docs.filter(quality.rejection(docs).isNull())


def near_duplicates(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """One document of each class of copies stays: that with the smallest id."""
    return dedup.deduplicated(docs)


def secret_scans(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Secrets in the texts give way to a mark."""
    return secrets.redacted(docs)


def source_mixing(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """Each document as often as the mix takes it."""
    return mixing.mixed_documents(docs)


def best_fit_packing(spark: SparkSession, docs: Docs, sf_dir: str) -> Docs:
    """The pieces of all documents with their sequences and places."""
    return packing.pack_documents(docs, tokenizer=tokenizer_path(packing.TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("secret scans", secret_scans),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: Alignment and tokenization cannot be said in SQL: tests follow a small table through all stages by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = new_path(spark, "stage-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
