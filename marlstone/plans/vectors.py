"""Registered vector searches that ask every vector whose id is divisible by 100, each with its SQL."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evidence as E
from ..operators import search
from ..operators import visual as V
from ..sources.tables import table
from .retrieval import _DOT, _NORM


def _asked(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """All vectors, and the queries among them."""
    vectors = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    return vectors, vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query"), F.col("embedding").alias("_query"))


_HIT = "query long, vec_id long, label int, score double"


def _rows(asked, own, scores: np.ndarray, q: np.ndarray, d: np.ndarray) -> dict:
    found = scores[q, d]
    return {"query": asked["query"].take(pa.array(q)), "vec_id": own["vec_id"].take(pa.array(d)), "label": own["label"].take(pa.array(d)), "score": pa.array(found, mask=np.isneginf(found))}


def _best(k: int, labels: bool = False, others: bool = False):
    """Keeps of a block the k best of each query, or of each query and label; with ``others`` a query isn't among its own."""

    def keep(asked, own, scores: np.ndarray) -> dict:
        ids, scores = own["vec_id"].to_numpy(), np.round(scores, 6)
        kinds = own["label"].fill_null(-1 << 31).to_numpy() if labels else np.zeros(len(ids))
        found = []
        for kind in np.unique(kinds):
            at = np.flatnonzero(kinds == kind)
            q, d = search.first_each(scores[:, at], ids[at], k + others)
            found.append((q, at[d]))
        q, d = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        if others:
            fit = asked["query"].to_numpy()[q] != ids[d]
            q, d = q[fit], d[fit]
        return _rows(asked, own, scores, q, d)

    return keep


_PAIRS = "embeddings e, (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0) q"
_SCORED = f"(SELECT q.vec_id AS query, e.label, e.vec_id, round({_DOT}, 6) AS score FROM {_PAIRS})"


def dense_topk_all(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.top_k_each(search.meet(*_asked(spark, sf), _best(10), _HIT), "query", "score", 10, "vec_id")
    return hits.select("query", "vec_id", "label", "score", F.col("rank").cast("long").alias("rank"))


DENSE_TOPK_ALL = f"SELECT query, vec_id, label, score, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM {_SCORED} QUALIFY rank <= 10"


def cosine_minscore_all(spark: SparkSession, sf: str) -> DataFrame:
    def near(asked, own, scores: np.ndarray) -> dict:
        return _rows(asked, own, scores, *np.nonzero(~(scores < 0.2) & (asked["query"].to_numpy()[:, None] != own["vec_id"].to_numpy())))

    return search.meet(*_asked(spark, sf), near, _HIT, cosine=True).select("query", "vec_id", F.round("score", 6).alias("score"))


COSINE_MINSCORE_ALL = f"""SELECT query, vec_id, round(score, 6) AS score FROM (SELECT q.vec_id AS query, e.vec_id, {_DOT} / ({_NORM.format('e')} * {_NORM.format('q')}) AS score FROM {_PAIRS})
    WHERE score >= 0.2 AND vec_id <> query"""


def _strong(asked, own, scores: np.ndarray) -> dict:
    """The best of each query and label in a block but the query itself, and how many are strong."""
    rows = _best(1, labels=True, others=True)(asked, own, scores)
    kinds, ids = own["label"].fill_null(-1 << 31).to_numpy(), own["vec_id"].to_numpy()
    strong = ~(scores < 0.5) & (asked["query"].to_numpy()[:, None] != ids)
    values, of = np.unique(kinds, return_inverse=True)
    counts = np.stack([strong[:, of == i].sum(axis=1) for i in range(len(values))], axis=1)
    place = {q: i for i, q in enumerate(asked["query"].to_pylist())}
    own_kind = np.searchsorted(values, rows["label"].fill_null(-1 << 31).to_numpy())
    pairs = np.array([place[q] for q in rows["query"].to_pylist()], dtype=np.int64)
    # Up to two rows of a query and label are left: the count goes with the first of them.
    first = np.zeros(len(pairs), dtype=bool)
    first[np.unique(pairs * len(values) + own_kind, return_index=True)[1]] = True
    return rows | {"n_strong": np.where(first, counts[pairs, own_kind], 0)}


def channel_argmax_all(spark: SparkSession, sf: str) -> DataFrame:
    strong = lambda asked, own, scores: _strong(asked, own, np.round(scores, 6))
    vectors, queries = _asked(spark, sf)
    hits = search.meet(vectors, queries, strong, _HIT + ", n_strong long")
    best = hits.groupBy("query", "label").agg(F.min_by(F.struct("vec_id", "score"), F.when(F.col("vec_id").isNotNull(), F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("b"), F.sum("n_strong").alias("n_strong"))
    return best.select("query", "label", F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"), "n_strong")


CHANNEL_ARGMAX_ALL = f"""SELECT query, label, vec_id, score, n_strong FROM (SELECT *, CAST(count(*) FILTER (score >= 0.5) OVER (PARTITION BY query, label) AS BIGINT) AS n_strong,
      row_number() OVER (PARTITION BY query, label ORDER BY score DESC, vec_id) AS rn FROM {_SCORED} WHERE vec_id <> query) WHERE rn = 1"""


def exact_gate_all(spark: SparkSession, sf: str) -> DataFrame:
    """Within each query and family."""
    # Four are enough for the ranks up to three and what follows each.
    hits = search.meet(*_asked(spark, sf), _best(4, labels=True), _HIT).withColumn("_q", F.struct("query", "label")).drop("query", "label")
    gated = E.exact_match_gate(hits, "_q", "score", "vec_id").where("rank <= 3")
    return gated.select("_q.query", F.col("_q.label").alias("family"), "vec_id", "score", F.col("rank").cast("long").alias("rank"), F.col("label").alias("decision"))


EXACT_GATE_ALL = f"""WITH r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS nxt FROM {_SCORED} WINDOW w AS (PARTITION BY query, label ORDER BY score DESC, vec_id))
    SELECT query, label AS family, vec_id, score, rank, CASE WHEN rank = 1 AND score >= 0.9 THEN CASE WHEN coalesce(score - nxt >= 0.04, true) THEN 'confirmed_exact' ELSE 'likely_same_design' END ELSE 'similar' END AS decision FROM r WHERE rank <= 3"""


def prune_outliers_all(spark: SparkSession, sf: str) -> DataFrame:
    vectors, queries = _asked(spark, sf)
    best = search.top_k_each(search.meet(vectors, queries, _best(1), _HIT), "query", "score", 1, "vec_id").select("query", F.col("score").alias("s"), F.col("label").alias("c"))

    def near(asked, own, scores: np.ndarray) -> dict:
        scores = np.round(scores, 6)
        s, c = asked["s"].to_numpy()[:, None], asked["c"]
        same = c.fill_null(-1 << 31).to_numpy()[:, None] == own["label"].fill_null(-1 << 31).to_numpy()
        return _rows(asked, own, scores, *np.nonzero((s < E.STRONG) | c.is_null().to_numpy()[:, None] | same | (scores >= s - E.NEAR_TOP)))

    hits = search.meet(vectors, queries.join(best, "query"), near, _HIT)
    return hits.select("query", "vec_id", F.col("label").alias("family"), "score")


PRUNE_OUTLIERS_ALL = f"""WITH b AS (SELECT query, score AS s, label AS c FROM {_SCORED} QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) = 1)
    SELECT query, vec_id, label AS family, score FROM {_SCORED} JOIN b USING (query) WHERE s < 0.85 OR c IS NULL OR label IS NOT DISTINCT FROM c OR score >= s - 0.18"""

CHANNELS = ("full_visual", "pattern_visual", "text_visual_tags")


def visual_match(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors of a label, forty ways parted, as the pictures of products: each hundredth asked in all channels, eight products decided on."""
    vectors = table(spark, sf, "embeddings")
    own = vectors.select(F.concat(F.lit("p"), F.coalesce("label", F.lit(-1)), F.lit("-"), F.col("vec_id") % 40).alias("product"), F.element_at(F.array(*[F.lit(c) for c in CHANNELS]), (F.col("vec_id") % 3 + 1).cast("int")).alias("channel"), "embedding", "vec_id", "label")
    first = F.min("vec_id")
    products = own.groupBy("product").agg((first % 5).alias("stock"), F.min("label").cast("string").alias("category"), F.when(first % 3 > 0, "product_photo").otherwise("design").alias("kind"), (first % 7 == 0).alias("is_reference"))
    queries = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("question"), F.explode(F.array(*[F.lit(c) for c in CHANNELS])).alias("channel"), "embedding")
    return V.decide(V.best_vectors(own, queries, products), 8)


_PLACE = "CASE {0} WHEN 'confirmed_exact' THEN 5 WHEN 'likely_same_design' THEN 3 WHEN 'similar_style' THEN 2 ELSE 0 END"
VISUAL_MATCH = f"""WITH v AS (SELECT *, 'p' || coalesce(label, -1) || '-' || vec_id % 40 AS product, ['full_visual', 'pattern_visual', 'text_visual_tags'][vec_id % 3 + 1] AS channel FROM embeddings),
    p AS (SELECT product, min(vec_id) % 5 AS stock, CAST(min(label) AS VARCHAR) AS category, min(vec_id) % 3 > 0 AS photo, min(vec_id) % 7 = 0 AS ref FROM v GROUP BY product),
    s AS (SELECT q.vec_id AS question, product, channel, round({_DOT} / ({_NORM.format('e')} * {_NORM.format('q')}), 6) AS raw, stock FROM v e JOIN p USING (product), (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 100 = 0) q),
    w AS (SELECT *, raw * CASE WHEN stock = 0 THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END AS worth FROM s),
    b AS (SELECT question, product, round(max(worth), 4) AS score, coalesce(list(DISTINCT channel) FILTER (raw >= 0.5), [first(channel ORDER BY worth DESC, channel DESC)]) AS ch FROM w GROUP BY question, product),
    t AS (SELECT * FROM b JOIN p USING (product) QUALIFY row_number() OVER (PARTITION BY question ORDER BY score DESC, product) <= 8),
    l AS (SELECT *, CASE WHEN NOT ref AND photo AND score >= 0.9 THEN 'confirmed_exact' WHEN NOT ref AND photo AND score >= 0.82 THEN 'likely_same_design' WHEN score >= 0.18 THEN 'similar_style' ELSE 'no_confident_match' END AS label FROM t),
    c AS (SELECT *, round(score + CASE label WHEN 'confirmed_exact' THEN 0.08 WHEN 'likely_same_design' THEN 0.035 WHEN 'similar_style' THEN 0.0 ELSE -0.2 END + CASE WHEN ref THEN -0.02 WHEN photo THEN 0.03 ELSE 0.0 END + CASE WHEN stock > 0 THEN 0.01 ELSE 0.0 END, 6) AS chosen FROM l),
    f AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY chosen DESC, score DESC, product) = 1 AS prim FROM c),
    x AS (SELECT *, max(score) FILTER (prim) OVER q AS top, max(category) FILTER (prim) OVER q AS topcat, max(score) FILTER (NOT prim) OVER q AS nxt FROM f WINDOW q AS (PARTITION BY question)),
    g AS (SELECT *, CASE WHEN prim AND label = 'confirmed_exact' THEN CASE WHEN ch = ['text_visual_tags'] THEN 'no_visual_channel' WHEN ch = ['pattern_visual'] THEN 'pattern_only' WHEN round(top - nxt, 6) < 0.04 THEN 'thin_top_margin' END END AS gate FROM x),
    h AS (SELECT question, product, score, CASE WHEN gate IS NOT NULL THEN 'likely_same_design' ELSE label END AS label, gate, prim, stock, ref FROM g
      WHERE prim OR NOT (top >= 0.85 AND coalesce(topcat, '') <> '' AND category IS DISTINCT FROM topcat AND score < round(top - 0.18, 6)))
    SELECT question, product, score, label, gate, CAST(row_number() OVER (PARTITION BY question ORDER BY prim DESC, {_PLACE.format('label')} DESC, CAST(stock > 0 AS INTEGER) + CAST(NOT ref AS INTEGER) DESC, score DESC, product) AS INTEGER) AS place FROM h"""

_NAMES = "visual_match dense_topk_all cosine_minscore_all channel_argmax_all exact_gate_all prune_outliers_all".split()
QUERIES = {f"q_{n}": (globals()[n], globals()[n.upper()]) for n in _NAMES}
