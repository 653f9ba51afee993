"""A training corpus from raw documents: quality rules, near-duplicates, personal data, source mix, packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; all but the last return the columns
of documents. The pipeline has no SQL form: fingerprints, trees and packing are beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marlstone.llm import curriculum, packing, pii, rules, similar
from marlstone.llm.common import file_order

ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the corpus policy doesn't reject. Null and empty texts go; repeated rows are judged alike; an empty table stays empty."""
    return rules.keep(docs, "corpus")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest doc_id of each group of near-duplicates: five-word shingles, Jaccard of 0.8 or more.

    Null and empty texts are one group, repeated rows another; an empty table stays empty.
    """
    return similar.drop_near_duplicates(docs)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind. Null and empty texts stay; repeated rows change alike."""
    return pii.redact(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, in the order of training. Null sources are one source; repeated rows count each."""
    return curriculum.mix(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed; sequences keep the order of the files that ``docs`` is read from, a task's pieces at a time.

    Null texts are an end id alone; documents longer than a sequence are cut; no documents give no pieces.
    """
    return packing.pack(packing.pieces(docs, order=file_order(docs)))


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("mixing", mixing), ("packing", sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over documents, each written to the shared folder and reread."""
    from marlstone.llm.common import shared_dir, table
    from uuid import uuid4

    docs = table(spark, sf_dir, "documents")
    at = f"{shared_dir(spark)}/pipeline-{uuid4().hex}"
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
