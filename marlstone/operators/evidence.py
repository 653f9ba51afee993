"""Choosing and checking evidence: gates on ranked hits, sentences, claims, links, verified prices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.questions import salient_terms
from ..functions.text import sentences

EXACT_MARGIN, STRONG, NEAR_TOP = 0.04, 0.85, 0.18


def exact_match_gate(hits: DataFrame, query: str, score: str, key: str, exact: float = 0.9) -> DataFrame:
    """``hits`` with ``rank`` and ``label``: the best of a query is exact if its score is and the next is well behind; else it is only likely."""
    w = Window.partitionBy(query).orderBy(F.desc(score), key)
    rows = hits.withColumn("rank", F.row_number().over(w)).withColumn("_next", F.lead(score).over(w))
    clear = F.coalesce(F.col(score) - F.col("_next") >= EXACT_MARGIN, F.lit(True))
    label = F.when((F.col("rank") == 1) & (F.col(score) >= exact), F.when(clear, "confirmed_exact").otherwise("likely_same_design")).otherwise("similar")
    return rows.withColumn("label", label).drop("_next")


def prune_outliers(hits: DataFrame, query: str, score: str, category: str, key: str) -> DataFrame:
    """Below a very strong best hit, hits of another category stay only if they are near it. The best is an aggregate, joined back."""
    best = hits.groupBy(query).agg(F.min_by(F.struct(F.col(score).alias("s"), F.col(category).alias("c")), F.struct((-F.col(score)).alias("n"), key)).alias("_b"))
    rows = hits.join(best, query)
    keep = (F.col("_b.s") < STRONG) | F.col("_b.c").isNull() | F.col(category).eqNullSafe(F.col("_b.c")) | (F.col(score) >= F.col("_b.s") - NEAR_TOP)
    return rows.where(keep).drop("_b")


def merge_hits(lists: list[DataFrame], key: str, order: list[Column]) -> DataFrame:
    """The union of lists with each key's best row by ``order``."""
    rows = lists[0]
    for more in lists[1:]:
        rows = rows.unionByName(more)
    return rows.groupBy(key).agg(F.max_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("_r")).select(key, "_r.*")


def best_sentences(docs: DataFrame, key: str, text: str, question: str, k: int) -> DataFrame:
    """The k sentences that share most terms with a question; then the longer, then by place."""
    asked = salient_terms(F.lit(question))
    rows = docs.select(key, F.posexplode(sentences(F.col(text))).alias("at", "sentence"))
    scored = rows.withColumn("overlap", F.size(F.array_intersect(salient_terms(F.col("sentence")), asked))).where("overlap > 0")
    return scored.orderBy(F.desc("overlap"), F.desc(F.length("sentence")), key, "at").limit(k)


def verify_claims(claims: DataFrame, key: str, text: str, evidence: str, least: float = 0.35) -> DataFrame:
    """(key, at, claim, support, supported): each sentence of ``text`` against ``evidence`` of the same row.

    A claim holds if its numbers all occur in the evidence and enough of its terms do.
    """
    rows = claims.select(key, F.posexplode(sentences(F.col(text))).alias("at", "claim"), F.lower(F.coalesce(evidence, F.lit(""))).alias("_e"))
    own = salient_terms(F.col("claim"))
    support = F.when(F.size(own) == 0, 1.0).otherwise(F.size(F.array_intersect(own, salient_terms(F.col("_e")))) / F.size(own))
    numbers = F.regexp_extract_all("claim", F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))
    grounded = F.forall(numbers, lambda n: F.contains(F.col("_e"), n))
    return rows.select(key, "at", "claim", F.round(support, 3).alias("support"), (grounded & (support >= least)).alias("supported"))


def link_faults(links: DataFrame, source: str, target: str, nodes: DataFrame, node: str) -> DataFrame:
    """(fault, n): links to unknown ends, and links found twice. Nodes are joined once for each end."""
    known = nodes.select(F.col(node).alias("_k")).distinct()
    ends = [links.join(known, links[end] == known["_k"], "left_anti").select(F.lit(f"unknown_{name}").alias("fault"), F.lit(1).cast("long").alias("n")) for end, name in ((source, "source"), (target, "target"))]
    twice = links.groupBy(source, target).count().where("count > 1").select(F.lit("duplicate").alias("fault"), (F.col("count") - 1).alias("n"))
    return ends[0].unionByName(ends[1]).unionByName(twice).groupBy("fault").agg(F.sum("n").alias("n"))


def expand(hits: DataFrame, key: str, links: DataFrame, source: str, target: str, most: int) -> DataFrame:
    """(key, target, place): for each hit up to ``most`` linked nodes, in their order."""
    met = links.join(hits.select(F.col(key).alias(source)).distinct(), source, "left_semi")
    ranked = met.withColumn("place", F.row_number().over(Window.partitionBy(source).orderBy(target)))
    return ranked.where(F.col("place") <= most).select(F.col(source).alias(key), target, "place")


def prices_verified(answers: DataFrame, key: str, mentioned: str, prices: str) -> DataFrame:
    """(key, n_mentioned, n_supported): mentioned prices that are a given price, or the difference or sum of two.

    The arrays belong to one answer and hold few prices.
    """
    pairs = F.flatten(F.transform(prices, lambda a: F.flatten(F.transform(prices, lambda b: F.array(F.round(F.abs(a - b), 2), F.round(a + b, 2))))))
    backed = F.array_union(F.transform(prices, lambda p: F.round(p, 2)), pairs)
    given = F.transform(mentioned, lambda m: F.round(m, 2))
    return answers.select(key, F.size(given).alias("n_mentioned"), F.size(F.filter(given, lambda m: F.array_contains(backed, m))).alias("n_supported"))


def compare_sides(rows: DataFrame, side: str, sides: list[str], stock: str, price: str, key: str) -> DataFrame:
    """(side, in_stock, best, best_price, cheaper): each side's rows in stock and its best by stock, then price."""
    per = rows.where(F.col(side).isin(sides) & (F.col(stock) > 0)).groupBy(side).agg(F.count("*").alias("in_stock"), F.min_by(F.struct(key, price), F.struct((-F.col(stock)).alias("s"), price, key)).alias("_b"))
    flat = per.select(side, "in_stock", F.col(f"_b.{key}").alias("best"), F.col(f"_b.{price}").alias("best_price"))
    least = flat.agg(F.min("best_price").alias("_least"))
    return flat.crossJoin(F.broadcast(least)).withColumn("cheaper", F.col("best_price") == F.col("_least")).drop("_least")


def restock_triggers(changes: DataFrame, key: str, order: list[str], stock: str) -> DataFrame:
    """The changes at which a key's stock rises from none to some."""
    w = Window.partitionBy(key).orderBy(*order)
    return changes.withColumn("_old", F.lag(stock).over(w)).where((F.col("_old") <= 0) & (F.col(stock) > 0)).drop("_old")


def islands(rows: DataFrame, group: str, order: list[str], same: Column) -> DataFrame:
    """``rows`` with ``island``: runs of neighbours for which ``same`` is equal."""
    w = Window.partitionBy(group).orderBy(*order)
    marked = rows.withColumn("_s", same).withColumn("_new", F.when(F.col("_s").eqNullSafe(F.lag("_s").over(w)), 0).otherwise(1))
    return marked.withColumn("island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_s", "_new")
