"""The corpus pipeline: quality classifier, near-duplicates, secrets, mixing, packing.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
it kept; ``run`` writes each result as Parquet and reads it for the next. All
stages but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pagequery.llm.mixing import mix_documents
from pagequery.llm.order_minhash import keep_one_of_each
from pagequery.llm.packing import pack_documents
from pagequery.llm.scratch import quoted, stored
from pagequery.llm.secret_forest import redact_secrets
from pagequery.llm.weak_quality import keep_good
from pagequery.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, null, empty and blank texts among them. All columns stay, whatever their names; repeated rows share their fate; an empty table stays empty."""
    ship(spark)
    return keep_good(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of least doc_id; all null texts stay. Rows alike in every column are one; ties go by row. All columns stay; an empty table stays empty."""
    ship(spark)
    return keep_one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; secrets in it are replaced by a mark, whatever the length of the text or the secret. Null texts stay null; all columns stay; an empty table stays empty."""
    ship(spark)
    return redact_secrets(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample whose tokens come near the target shares. A null text is one token, null sources and languages are categories; repeated rows share their fate. All columns stay; an empty table stays empty."""
    ship(spark)
    return mix_documents(docs).select(*[quoted(c) for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document in the training sequences. Null and empty texts are one end token, very long ones several pieces; other columns are not read; an empty table gives no pieces."""
    ship(spark)
    return pack_documents(docs, with_ids=False)


STAGES = [("quality_classifier", quality), ("minhash_near_dedup", near_duplicates), ("secret_scans", secrets), ("source_mixing", mixing), ("best_fit_packing", packing)]

#: The stages' hashing, tokenizing and training are not SQL; tests/llm/test_pipeline.py follows every document in plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name, docs)  # what the stage before it left goes
    return docs
