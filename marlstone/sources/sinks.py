"""Writers. Spark's commit protocol makes an overwrite all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(rows: DataFrame, path: str, append: bool = False) -> None:
    rows.write.mode("append" if append else "overwrite").json(path)


def write_table(rows: DataFrame, path: str, partition_by: list[str] | None = None, sort_by: list[str] | None = None, append: bool = False) -> None:
    """Parquet, optionally partitioned; sorting is within files, which keeps their statistics narrow."""
    if partition_by:
        rows = rows.repartition(*partition_by)
    if sort_by:
        rows = rows.sortWithinPartitions(*(partition_by or []), *sort_by)
    writer = rows.write.mode("append" if append else "overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_document(nodes: DataFrame, links: DataFrame, path: str, parents: list[str]) -> None:
    """A document graph: nodes, links, and the nodes that are parents or can be retrieved, each a table by document."""
    write_table(nodes, f"{path}/nodes", ["document_id"], ["node_id"])
    write_table(links, f"{path}/links")
    write_table(nodes.where(F.col("node_type").isin(parents)), f"{path}/parent_nodes", ["document_id"])
    write_table(nodes.where(~F.col("node_type").isin(parents)), f"{path}/retrieval_nodes", ["document_id"])


def write_index(postings: DataFrame, vocabulary: DataFrame, statistics: DataFrame, path: str) -> None:
    """BM25 tables; postings lie together by term, so a search reads few files."""
    postings.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    vocabulary.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/vocabulary")
    statistics.write.mode("overwrite").parquet(f"{path}/statistics")
