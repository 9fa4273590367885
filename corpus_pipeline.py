"""From raw documents to packed windows: quality, near duplicates, source mix, packing.

Each stage works on all that its predecessor kept, written as Parquet in the
shared folder and read again; ``run`` then deletes the stage's intermediate
tables. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from facetmill.llm.common import scratch, table
from facetmill.llm.mixing import repeat_documents
from facetmill.llm.neardup import drop_near_duplicates
from facetmill.llm.packing import pack_documents
from facetmill.llm.quality import keep_quality
from facetmill.llm.queries import TOKENIZER


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents with a quality score below 0.3, as learned from the labels that are not held out."""
    return keep_quality(docs, table(spark, sf_dir, "labels"), threshold=0.3)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves one document of each group that shares four fifths of its five-word shingles."""
    return drop_near_duplicates(docs, k=5, percent=80)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and samples documents so that the sources meet their target weights."""
    return repeat_documents(docs, weights=(3, 1, 2), budget_ratio=1.5, max_epochs=2.0)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into windows of 2048."""
    return pack_documents(docs, TOKENIZER, capacity=2048)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: Learned scores and tokenisation cannot be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(spark) as keep:
            docs = keep(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
