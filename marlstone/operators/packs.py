"""Rule-scored retrieval and evidence packs: what a question's kind adds to a hit, and which passages answer it together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import logical_unit

# How much body, heading and structure count for a question of each kind.
PROFILES = {
    "definition": {"body": 0.4, "heading": 0.35, "structure": 0.25},
    "amount_lookup": {"body": 0.55, "heading": 0.15, "structure": 0.3},
    "duration_lookup": {"body": 0.55, "heading": 0.15, "structure": 0.3},
    "date_lookup": {"body": 0.55, "heading": 0.15, "structure": 0.3},
    "count_lookup": {"body": 0.4, "heading": 0.25, "structure": 0.35},
    "list_lookup": {"body": 0.4, "heading": 0.25, "structure": 0.35},
    "comparison": {"body": 0.45, "heading": 0.2, "structure": 0.35},
    "eligibility": {"body": 0.5, "heading": 0.15, "structure": 0.35},
    "section": {"body": 0.35, "heading": 0.25, "structure": 0.4},
    "mention_lookup": {"body": 0.65, "heading": 0.25, "structure": 0.1},
    "general": {"body": 0.55, "heading": 0.25, "structure": 0.2},
}
# For a kind, what a passage gains that speaks its language and loses that doesn't; what each shared term of the
# question adds, up to how much; what a passage without any loses.
KIND_RULES = {
    "eligibility": (1.9, -1.4, 1.1, 3.8, -3.0),
    "amount_lookup": (1.9, -1.5, 1.2, 4.0, -3.5),
    "count_lookup": (1.6, 0.0, 1.1, 3.5, -3.2),
    "duration_lookup": (1.8, -1.4, 1.2, 4.0, -3.5),
    "date_lookup": (1.7, -1.3, 1.1, 3.5, -3.0),
    "list_lookup": (1.7, -1.0, 1.0, 3.0, -2.8),
    "comparison": (2.4, -2.6, 1.1, 3.8, -3.8),
}
# What quality, authority and each heading term add, and the most that heading terms add.
QUALITY, AUTHORITY, HEADING, HEADING_MOST = 1.2, 0.15, 0.3, 1.2


def kind_rules(kind: str, speaks: Column, shared: Column) -> Column:
    """What a question's kind adds to a passage: ``speaks`` its language, ``shared`` terms with the question."""
    if kind not in KIND_RULES:
        return F.lit(0.0)
    gain, loss, each, most, none = KIND_RULES[kind]
    return F.when(speaks, gain).otherwise(loss) + F.least(shared * each, F.lit(most)) + F.when(shared == 0, none).otherwise(0.0)


def section_rules(section: Column, subsection: Column, heading: Column, wanted: str) -> Column:
    """What a reference adds: a section or subsection of that number, more under its heading, less elsewhere."""
    own = F.when(subsection == wanted, F.when(heading, 6.5).otherwise(3.0)).when(section == wanted, F.when(heading, 4.5).otherwise(1.3))
    return own.otherwise(-2.5 if "." in wanted else F.when(section.isNotNull(), -1.5).otherwise(0.0))


def boosted(base: Column, quality: Column, authority: Column, heading_shared: Column, rules: Column) -> Column:
    """A hit's score with its quality, its source's authority, the question's terms in its heading and the rules of the kind."""
    return base + quality * QUALITY + authority * AUTHORITY + F.least(heading_shared * HEADING, F.lit(HEADING_MOST)) + rules


# For each pack how many anchors it has, and how many passages at most beside the number asked.
ANCHORS = {"definition": 1, "context": 1, "list": 2, "section": 1, "comparison": 1}


def evidence_pack(kind: str, hits: DataFrame, pool: DataFrame, doc: str, heading: str, page: str, key: str, score: str, supports: str, exact: str, k: int) -> DataFrame:
    """(key, place): the passages that answer a question of a kind together.

    Anchors are the best of ``hits`` (those that are ``exact`` first, where the kind looks for them). Around them passages of
    ``pool`` of the same document and heading and near pages come in. Definitions keep two, exact and supporting ones first;
    contexts and lists keep the order of the document, behind the anchor or throughout; sections put the anchor and exact
    headings first; comparisons put what covers most first. Only anchors, and the few passages near them, are ever ranked.
    """
    first = [F.desc(exact)] if kind in ("definition", "section", "comparison") else []
    anchors = hits.orderBy(*first, F.desc(score), key).limit(ANCHORS[kind])
    near = logical_unit(anchors, pool, doc, heading, page, key).select(F.col("member").alias(key)).distinct()
    members = near.join(anchors.select(F.col(key), F.lit(True).alias("_anchor")), key, "full_outer").withColumn("_anchor", F.coalesce("_anchor", F.lit(False)))
    scores = hits.select(key, F.col(score).alias("_score"))
    rows = members.join(pool.select(key, page, supports, exact), key).join(scores, key, "left").withColumn("_score", F.coalesce("_score", F.lit(0.0)))
    place = F.asc(page)
    order = {
        "definition": [F.desc(exact), F.desc(supports), F.desc("_score"), place],
        "context": [F.desc("_anchor"), place],
        "list": [place],
        "section": [F.desc("_anchor"), F.desc(exact), F.desc("_score"), place],
        "comparison": [F.desc("_anchor"), F.desc(exact), F.desc(supports), place],
    }[kind]
    if kind == "definition":
        rows = rows.where(F.col(exact) | F.col(supports))
    most = {"definition": min(k, 2), "list": max(k, 4)}.get(kind, k)
    return rows.withColumn("place", F.row_number().over(Window.orderBy(*order, F.asc(key)))).where(F.col("place") <= most).select(key, "place")
