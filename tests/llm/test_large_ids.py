"""Identifiers above 2^53 beside nulls come back unchanged from every operator; packing exchanges on many tasks."""

from collections import Counter

import numpy as np
import pytest

from marlstone.llm import packing, page_diff, quality_model, queries

IDS = [2**53 + 1, None, 2**53 + 3, 2**62 + 1, None, 7]
TEXTS = ["The first text is about rivers, and of boats on them.\nIt ends here.", "Another one", None, "a b c d e f", "", "Four score and seven years ago " * 30]


@pytest.fixture(scope="module")
def large(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("large"))
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(IDS, TEXTS, strict=True)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{at}/documents.parquet")
    pages = spark.createDataFrame([(i, f"https://h.org/{k}", f"<p>{t}</p>") for k, (i, t) in enumerate(zip(IDS, TEXTS, strict=True))], "page_id long, url string, html string")
    pages.coalesce(1).write.parquet(f"{at}/pages.parquet")
    vectors = spark.createDataFrame([(i, [1.0, float(k), -2.0], 1) for k, i in enumerate(IDS)], "vec_id long, embedding array<float>, label int")
    vectors.coalesce(1).write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.mark.parametrize("name", ["op1_simhash", "op2_kd_shards", "op5_sstable", "op6_pii", "op7_rules", "op10_curriculum", "op4_packing", "op13_merkle"])
def test_documents(spark, large, name):
    assert Counter(r["doc_id"] for r in queries.QUERIES[name](spark, large).collect()) == Counter(IDS)


def test_pages_vectors_and_scores(spark, large):
    assert Counter(r["page_id"] for r in page_diff.extract(spark.read.parquet(f"{large}/pages.parquet")).collect()) == Counter(IDS)
    assert Counter(r["vec_id"] for r in queries.op8_cross_polytope(spark, large).collect()) == Counter(IDS)
    docs = spark.read.parquet(f"{large}/documents.parquet")
    labels = spark.createDataFrame([(7, 1), (2**53 + 1, 0)], "doc_id long, quality int")
    assert Counter(r["doc_id"] for r in quality_model.score(docs, quality_model.train(docs, labels)).collect()) == Counter(IDS)


def test_packing_on_many_tasks(spark):
    """Five hundred tasks of forty pieces: exchange ends no worse than one best-fit of all pieces, ids tell all sequences apart, and no piece is lost."""
    rng = np.random.default_rng(11)
    sizes = np.minimum(2048, np.exp(rng.normal(6.3, 0.8, 20_000)).astype(int) + 1)
    parts = spark.createDataFrame([(2**53 + i, 0, 0, int(s), i) for i, s in enumerate(sizes)], "doc_id long, piece int, start long, length long, ids_crc32 long").repartition(8)
    rows = packing.pack(parts, per_task=40).collect()
    assert sorted(r["doc_id"] for r in rows) == [2**53 + i for i in range(20_000)]
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in by.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:k]) for k in range(len(held))] and sum(n for _, n in held) <= 2048
    assert packing.bound_of(np.bincount(sizes, minlength=2049), 2048) <= len(by) <= packing.best_fit(sizes, 2048)[1]


def test_sequence_numbers_of_late_turns():
    """The last turn's last task and bin still fit a long, whatever comes before."""
    last = ((1 << 63 - packing.TASK_BITS - packing.BIN_BITS) - 1 << packing.TASK_BITS) + (1 << packing.TASK_BITS) - 1
    assert (last << packing.BIN_BITS) + (1 << packing.BIN_BITS) - 1 == 2**63 - 1
