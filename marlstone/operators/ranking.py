"""Orders, boosts and selections of ranked hits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.questions import looks_list_like, salient_terms
from ..functions.text import tokens

# Language by which a passage can support a question of each kind.
SUPPORT = {
    "amount": r"taka|crore|lakh|percent|%|threshold|limit|not more than|no more than|exceeds?|minimum|maximum",
    "duration": r"\b[0-9]+\s*\([^)]*\)\s*(?:successive\s+)?(?:assessment\s+)?(?:years?|months?|days?)|\b[0-9]+\s+(?:successive\s+)?(?:assessment\s+)?years?\b|carry(?:ied)?\s+forward|period of|from .* to .*",
    "date": r"\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\b|\b[0-9]{1,2}(?:st|nd|rd|th)\b|effective from|deadline|due date",
    "list": r"\([a-z]\)|\([ivx]+\)|namely|following classes|following items|following incomes|first year|second year",
    "count": r"\([a-z]\)|\([ivx]+\)|namely|\b[0-9]+\b",
    "definition": r"\bdefinitions?\b|\bmeans\b|defined as",
}
# What a passage of a question's kind gains.
KIND_BOOSTS = {
    "date": (r"date|day|january|february|march|april|may|june|july|august|september|october|november|december", 1.2),
    "duration": (r"years?|months?|days?|successive", 1.2),
    "amount": (r"taka|lakh|crore|percent|%", 1.2),
    "definition": (r" means ", 1.2),
}
#: Phrase in the question: the order it asks for.
ORDERS = (
    ("low_stock", ("low stock", "running low", "below threshold", "limited stock")), ("sold_out", ("out of stock", "stockout", "stock out")),
    ("dearest", ("most expensive", "highest price", "expensive")), ("cheapest", ("cheapest", "lowest price", "least expensive")),
)


def supports(text: Column, kind: str, question: str) -> Column:
    """Whether a passage speaks of what the question asks: a term in common, and the kind's language."""
    common = F.size(F.array_intersect(salient_terms(text), salient_terms(F.lit(question)))) > 0
    return common & F.rlike(F.lower(F.coalesce(text, F.lit(""))), F.lit(SUPPORT[kind]))


def section_boost(section: Column, subsection: Column, variant: Column, text: Column, wanted: str) -> Column:
    """What a reference to a section adds: 3.2 for it, 1.6 more for its heading, 2.2 for its anchor, 2.1 for a subsection of that number."""
    heading = F.rlike(F.lower(text), F.lit(r"(?:^|\s)" + wanted.replace(".", r"\.") + r"(?:[.)]|\s*[—:-])"))
    own = F.when(section == wanted, 3.2 + F.when(heading, 1.6).otherwise(0.0)).when(subsection == wanted, 2.1).otherwise(0.0)
    return own + F.when((variant == "anchor") & (section == wanted), 2.2).otherwise(0.0)


def kind_boost(text: Column, kind: str) -> Column:
    """What a passage gains if its language is that of the question's kind."""
    if kind in ("count", "list"):
        return F.when(looks_list_like(text), 1.6).otherwise(0.0)
    if kind not in KIND_BOOSTS:
        return F.lit(0.0)
    pattern, gain = KIND_BOOSTS[kind]
    return F.when(F.rlike(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), F.lit(pattern)), gain).otherwise(0.0)


def overlap_boost(text: Column, terms: list[str]) -> Column:
    asked = F.array(*[F.lit(t) for t in sorted(set(terms))])
    return F.least(F.size(F.array_intersect(F.array_distinct(tokens(text)), asked)) * 0.18, F.lit(1.5))


def rules_score(rules: list[tuple[Column, float]], base: Column | None = None) -> Column:
    """A base score with what each rule that holds adds; a null condition adds nothing."""
    return reduce(lambda total, r: total + F.when(r[0], r[1]).otherwise(0.0), rules, base if base is not None else F.lit(0.0))


def completeness(name: Column, category: Column, brand: Column, snippet: Column, price: Column, stock: Column) -> Column:
    """How complete a product's record is, as a small whole number; fields of one or two characters take away."""
    size = lambda c: F.length(F.trim(F.coalesce(c, F.lit(""))))
    gains = [(size(name) >= 4, 2), (size(category) >= 3, 1), (size(brand) >= 3, 1), (size(snippet) >= 18, 2), (price.isNotNull(), 1), (stock.isNotNull(), 1), *[(size(c).between(1, 2), -1) for c in (category, brand, snippet)]]
    return sum((F.when(c, v).otherwise(0) for c, v in gains), F.lit(0))


def order_asked(question: str) -> str:
    lower = question.lower()
    return next((name for name, phrases in ORDERS if any(p in lower for p in phrases)), "default")


def support_order(question: str, stock: str, price: str, quality: str, score: str, name: str) -> list[Column]:
    """Sort columns for the order that a question's words ask for; nulls where the reference puts missing values."""
    rest = [F.desc(quality), F.desc(score), F.lower(name)]
    first = {"low_stock": [F.asc_nulls_last(stock)], "sold_out": [F.when(F.coalesce(stock, F.lit(0)) == 0, 0).otherwise(1)], "dearest": [F.desc_nulls_last(price)], "cheapest": [F.asc_nulls_last(price)]}
    asked = order_asked(question)
    if asked != "default":
        return [*first[asked], *rest]
    return [F.coalesce(stock, F.lit(0)) <= 0, F.desc(quality), F.desc(score), F.asc_nulls_last(price), F.desc(F.coalesce(stock, F.lit(0))), F.lower(name)]


def step_up(rows: DataFrame, group: str, price: str, key: str) -> DataFrame:
    """(key, upsell): for each row the next dearer one of its group. A neighbour in the price's order, never a pair list."""
    w = Window.partitionBy(group).orderBy(price)
    dearer = rows.groupBy(group, price).agg(F.min(key).alias("_k"))
    steps = dearer.select(group, price, F.lead("_k").over(w).alias("upsell"))
    return rows.join(steps, [group, price]).select(key, "upsell")


def bundle(candidates: DataFrame, kinds: list[str], kind: str, price: str, score: str, key: str, budget: float | None) -> DataFrame:
    """One item of each kind in turn: the best score that leaves enough for the cheapest of the kinds after it.

    The kinds of a question are few; each turn is a distributed top-1, and only its price reaches the driver.
    """
    floor = {r[kind]: r["p"] for r in candidates.where(F.col(kind).isin(kinds)).groupBy(kind).agg(F.min(price).alias("p")).collect()}
    left, chosen = budget, []
    for i, k in enumerate(kinds):
        pool = candidates.where(F.col(kind) == k)
        if left is not None:
            most = max(0.0, left - sum(floor.get(x, 0.0) for x in kinds[i + 1 :]))
            affordable = pool.where(F.col(price) <= most)
            pool = affordable if affordable.take(1) else pool
        best = pool.orderBy(F.desc(score), price, key).limit(1)
        row = best.first()
        if row is None:
            continue
        chosen.append(row[key])
        left = left if left is None else left - row[price]
    return candidates.where(F.col(key).isin(chosen))


def groups_in_order(hits: DataFrame, group: str, rank: str, key: str, most: int) -> DataFrame:
    """(group, first_rank, members): groups in the order in which they first appear, ``most`` of them, members by rank."""
    per = hits.groupBy(group).agg(F.min(rank).alias("first_rank"), F.array_sort(F.collect_list(F.struct(rank, key))).alias("_m"))
    return per.orderBy("first_rank", group).limit(most).select(group, "first_rank", F.transform("_m", lambda m: m[key]).alias("members"))


def logical_unit(anchors: DataFrame, pool: DataFrame, doc: str, heading: str, page: str, key: str, far: int = 2, most: int = 5) -> DataFrame:
    """(anchor, member, distance): passages of an anchor's document and heading at most ``far`` pages from it, nearest first.

    An equal join on document and heading and page band, so a long document meets its anchor only around its page.
    """
    band = lambda c: F.floor(c / (far + 1))
    a = anchors.select(F.col(doc).alias("_d"), F.col(heading).alias("_h"), F.col(page).alias("_p"), F.col(key).alias("anchor"), F.explode(F.array(*[band(F.col(page)) + k for k in (-1, 0, 1)])).alias("_b"))
    b = pool.select(F.col(doc).alias("_d"), F.col(heading).alias("_h"), F.col(page).alias("_q"), F.col(key).alias("member"), band(F.col(page)).alias("_b"))
    met = a.join(b, ["_d", "_h", "_b"]).withColumn("distance", F.abs(F.col("_p") - F.col("_q"))).where(F.col("distance") <= far)
    place = F.row_number().over(Window.partitionBy("anchor").orderBy("distance", "member"))
    return met.withColumn("_n", place).where(F.col("_n") <= most).select("anchor", "member", "distance")
