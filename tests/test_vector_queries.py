"""Searches that ask several vectors at once."""

import pytest

from marlstone.operators import search
from marlstone.plans import QUERIES


def test_each_query_has_its_own_ranks(spark):
    rows = spark.createDataFrame([(i, [float(i % 7), float(i % 5)]) for i in range(50)], "id long, v array<double>")
    asked = rows.where("id IN (3, 8, 11)").selectExpr("id AS query", "v AS _query")
    got = {(r["query"], r["rank"]): r["id"] for r in search.top_k_each(search.similar(rows, asked, "v", many=True), "query", "score", 4, "id").collect()}
    for q in (3, 8, 11):
        best = sorted(range(50), key=lambda i: (-((i % 7) * (q % 7) + (i % 5) * (q % 5)), i))[:4]
        assert [got[q, k] for k in (1, 2, 3, 4)] == best
    assert len(got) == 12


@pytest.mark.parametrize("name", ["dense_topk", "cosine_minscore", "channel_argmax", "exact_gate", "prune_outliers"])
def test_every_hundredth_vector_asks(spark, sf, name):
    """All queries ask, and query 0 gets what the search of one query gets."""
    asked = {r[0] for r in spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 100 = 0").select("vec_id").collect()}
    rows, one = QUERIES[f"q_{name}_all"][0](spark, sf).collect(), QUERIES[f"q_{name}"][0](spark, sf)
    assert {r["query"] for r in rows} == asked and len(asked) > 1
    assert sorted(tuple(r[c] for c in one.columns) for r in rows if r["query"] == 0) == sorted(map(tuple, one.collect()))


def test_pairs_are_scored_in_blocks(spark):
    """Only what is kept becomes a row; null vectors, nulls within and other lengths have no score, a zero vector's cosine is what is asked."""
    import numpy as np

    vectors = spark.createDataFrame([(0, [3.0, 4.0]), (1, [4.0, 3.0]), (2, None), (3, [1.0, None]), (4, [1.0]), (5, [0.0, 0.0])], "id long, embedding array<double>")
    asked = spark.createDataFrame([(7, [3.0, 4.0]), (8, [2.0])], "query long, _query array<double>")

    def keep(asked, own, scores):
        q, d = np.nonzero(np.isfinite(scores))
        return {"query": asked["query"].to_numpy()[q], "id": own["id"].to_numpy()[d], "score": scores[q, d]}

    got = {(r["query"], r["id"]): round(r["score"], 9) for r in search.meet(vectors, asked, keep, "query long, id long, score double", cosine=True, zero=0.0).collect()}
    assert got == {(7, 0): 1.0, (7, 1): 0.96, (7, 5): 0.0, (8, 4): 1.0}
