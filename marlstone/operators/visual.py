"""Products by their pictures: several vectors a product in several channels, the best of them, and what may be said of the match."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .search import meet

# What a sold-out product's score is multiplied by, and from which score a channel agrees.
SOLD_OUT, AGREES = 0.3, 0.5
# Scores from which a product's own photo is the same product, or likely the same design, and from which anything is similar.
EXACT, LIKELY, SIMILAR = 0.9, 0.82, 0.18
# By how much the best must lead to be called the same; from which score it is strong, and how far behind it another category falls away.
MARGIN, STRONG, BEHIND = 0.04, 0.85, 0.18
# What a label adds where the primary is chosen, and how labels are ordered.
BONUS = {"confirmed_exact": 0.08, "confirmed_same_design_variant": 0.06, "likely_same_design": 0.035, "similar_style": 0.0, "no_confident_match": -0.2}
ORDER = {"confirmed_exact": 5.0, "confirmed_same_design_variant": 4.0, "likely_same_design": 3.0, "similar_style": 2.0, "no_confident_match": 0.0}


def best_vectors(vectors: DataFrame, queries: DataFrame, products: DataFrame, agrees: float = AGREES) -> DataFrame:
    """(question, product, score, channels and the columns of ``products``): each product by the best of its vectors in any channel.

    ``vectors`` are (product, channel, embedding), ``queries`` (question, channel, embedding): a picture in each channel in
    which it is asked; ``products`` (product, stock, category, kind, is_reference). A vector is met by the questions of its
    channel only, in blocks by channel and product; of each of these a block passes on the highest cosine.
    """
    kinds = dict(queries.dtypes)["question"], dict(vectors.dtypes)["product"]

    def highest(asked, own, scores: np.ndarray) -> dict:
        group = own.to_pandas().groupby(["channel", "product"], dropna=False, sort=False).ngroup().to_numpy()
        order = np.argsort(group, kind="stable")
        starts = np.flatnonzero(np.r_[True, np.diff(group[order]) > 0])
        most, first = np.maximum.reduceat(scores[:, order], starts, axis=1), order[starts]
        channel = own["channel"].take(pa.array(first))
        same = asked["channel"].to_numpy()[:, None] == channel.to_numpy()
        q, g = np.nonzero(same)
        return {"question": asked["question"].take(pa.array(q)), "product": own["product"].take(pa.array(first[g])), "channel": channel.take(pa.array(g)), "_raw": pa.array(most[q, g], mask=np.isneginf(most[q, g]))}

    held = vectors.where("channel IS NOT NULL").select("product", "channel", "embedding")
    asked = queries.where("channel IS NOT NULL").select("question", "channel", F.col("embedding").alias("_query"))
    met = meet(held, asked, highest, f"question {kinds[0]}, product {kinds[1]}, channel string, _raw double", cosine=True, zero=0.0, near=["channel", "product"])
    scores = met.groupBy("question", "product", "channel").agg(F.round(F.max("_raw"), 6).alias("_raw")).join(products.select("product", "stock"), "product")
    worth = F.col("_raw") * F.when(F.coalesce(F.col("stock"), F.lit(1)) == 0, SOLD_OUT).otherwise(1.0)
    best = scores.groupBy("question", "product").agg(
        F.round(F.max(worth), 4).alias("score"), F.array_sort(F.collect_set(F.when(F.col("_raw") >= agrees, F.col("channel")))).alias("channels"), F.max_by("channel", F.struct(worth, "channel")).alias("_best")
    )
    channels = F.when(F.size("channels") > 0, F.col("channels")).otherwise(F.array("_best"))
    return best.withColumn("channels", channels).drop("_best").join(products, "product")


def label(score: Column, kind: Column, is_reference: Column) -> Column:
    """What a single hit may be called."""
    own = ~F.coalesce(is_reference, F.lit(False)) & F.coalesce(kind == "product_photo", F.lit(False))
    return F.when(own & (score >= EXACT), "confirmed_exact").when(own & (score >= LIKELY), "likely_same_design").when(score >= SIMILAR, "similar_style").otherwise("no_confident_match")


def _by_label(values: dict[str, float], name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for item in values.items() for x in item]), name)


def decide(hits: DataFrame, k: int) -> DataFrame:
    """(question, product, score, label, gate, place): of the k best of each question the primary first, then the others by label, stock, truth and score.

    The primary is the best with a little for its label, its being a product's photo and in stock. It isn't called the same
    product if only text or only pattern agrees, or if the runner-up is near. Behind a strong primary, products of other
    categories that are much weaker are left out. Windows go over a question's k rows.
    """
    first = Window.partitionBy("question").orderBy(F.desc("score"), "product")
    rows = hits.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= k)
    rows = rows.withColumn("label", label(F.col("score"), F.col("kind"), F.col("is_reference")))
    reference, stocked = F.coalesce(F.col("is_reference"), F.lit(False)), F.coalesce(F.col("stock"), F.lit(0)) > 0
    truth = F.when(reference, -0.02).when(F.col("kind") == "product_photo", 0.03).otherwise(0.0)
    chosen = F.round(F.col("score") + _by_label(BONUS, F.col("label")) + truth + F.when(stocked, 0.01).otherwise(0.0), 6)
    rows = rows.withColumn("_chosen", chosen)
    by_choice = Window.partitionBy("question").orderBy(F.desc("_chosen"), F.desc("score"), "product")
    rows = rows.withColumn("_primary", F.row_number().over(by_choice) == 1)
    whole = Window.partitionBy("question")
    of_primary = lambda c: F.max(F.when(F.col("_primary"), F.col(c))).over(whole)
    rows = rows.withColumns({"_top": of_primary("score"), "_category": of_primary("category"), "_next": F.max(F.when(~F.col("_primary"), F.col("score"))).over(whole)})
    alone = lambda name: (F.size("channels") == 1) & F.array_contains("channels", name)
    exact = F.col("_primary") & (F.col("label") == "confirmed_exact")
    gate = F.when(exact & alone("text_visual_tags"), "no_visual_channel").when(exact & alone("pattern_visual"), "pattern_only").when(exact & (F.round(F.col("_top") - F.col("_next"), 6) < MARGIN), "thin_top_margin")
    rows = rows.withColumn("gate", gate).withColumn("label", F.when(F.col("gate").isNotNull(), "likely_same_design").otherwise(F.col("label")))
    same = F.coalesce(F.lower("category") == F.lower("_category"), F.lit(False))
    weak = (F.col("_top") >= STRONG) & (F.coalesce(F.col("_category"), F.lit("")) != "") & ~same & (F.col("score") < F.round(F.col("_top") - BEHIND, 6))
    rows = rows.where(F.col("_primary") | ~weak)
    order = [F.desc("_primary"), F.desc(_by_label(ORDER, F.col("label"))), F.desc(F.when(stocked, 1).otherwise(0) + F.when(reference, 0).otherwise(1)), F.desc("score"), F.col("product")]
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("question").orderBy(*order))).select("question", "product", "score", "label", "gate", "place")
