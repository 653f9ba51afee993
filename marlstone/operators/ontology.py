"""An ontology of product types: which type a product's words tell, how products of types relate, and what is sold with what."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.specs import product_text

#: What a phrase of n words counts, and what it counts more in the name, the category, the brand or a tag; what a tag of the type's name counts, and a category that is the type's own.
WORDS, NAME, CATEGORY, BRAND, TAG, TYPE_TAG, OWN_CATEGORY = 3, 2, 2, 1, 3, 3, 2


@dataclass(frozen=True)
class Ontology:
    """``synonyms``: the phrases of each type, in the order of preference; ``families`` and ``categories`` of types; ``sold_with``: what goes with a type; ``signals``: (type, tag, other tags, points), tags that together tell a type."""

    synonyms: dict[str, tuple[str, ...]]
    families: dict[str, str] = field(default_factory=dict)
    categories: dict[str, str] = field(default_factory=dict)
    sold_with: dict[str, tuple[str, ...]] = field(default_factory=dict)
    signals: tuple[tuple[str, str, tuple[str, ...], int], ...] = ()

    def compatible(self) -> set[tuple[str, str]]:
        """Both orders of every pair of different types of which one is sold with the other."""
        pairs = {(a, b) for a, others in self.sold_with.items() for b in others if a != b}
        return pairs | {(b, a) for a, b in pairs}

    def map(self, values: dict[str, str], kind: Column) -> Column:
        """What ``values`` says of a type; null for types that it doesn't have."""
        return F.try_element_at(F.create_map(*[F.lit(x) for item in values.items() for x in item]), kind) if values else F.lit(None).cast("string")


class Automaton:
    """All phrases at once: one pass over a text finds those that it holds. Phrases of one word must stand as words, longer ones anywhere."""

    def __init__(self, phrases: Iterable[str]):
        import ahocorasick

        self.trie = ahocorasick.Automaton()
        for phrase in phrases:
            self.trie.add_word(phrase, phrase)
        if len(self.trie):
            self.trie.make_automaton()

    def found(self, text: str) -> set[str]:
        if not text or not len(self.trie):
            return set()
        out = set()
        for end, phrase in self.trie.iter(text):
            if phrase not in out and (" " in phrase or _alone(text, end - len(phrase) + 1, end + 1)):
                out.add(phrase)
        return out


def _alone(text: str, start: int, end: int) -> bool:
    """Between a letter or digit and none there is a word's edge, at both ends."""
    before, after = start > 0 and text[start - 1].isalnum(), end < len(text) and text[end].isalnum()
    return before != text[start].isalnum() and after != text[end - 1].isalnum()


def _plain(text: str) -> str:
    kept = "".join(c if c.isascii() and (c.isalnum() or c in "+-") else " " for c in text.lower())
    return " ".join(kept.split())


@lru_cache(maxsize=4)
def _automaton(phrases: tuple[str, ...]) -> Automaton:
    """One for all batches of a worker."""
    return Automaton(phrases)


def detect(rows: DataFrame, ontology: Ontology, name: str, category: str, brand: str, tags: str, more: list[str], into: str = "product_type") -> DataFrame:
    """``rows`` with the type that a product's words tell best, null if none; ``more`` are further columns to be searched.

    A type counts its longest phrase that occurs anywhere, more for a phrase that stands in the name, the category, the
    brand or a tag, for a tag of its own name, for tags that together tell it, and for its own category. The first of
    types that count the same is taken. Nulls are empty; tags are a list of texts.
    """
    synonyms = tuple((t, tuple(s for s in map(_plain, phrases) if s)) for t, phrases in ontology.synonyms.items())
    own = {t: _plain(ontology.categories.get(t, "")) for t, _ in synonyms}
    plain_type = {t: _plain(t) for t, _ in synonyms}
    phrases = tuple(sorted({s for _, listed in synonyms for s in listed}))
    by_phrase: dict[str, list[str]] = {}
    for t, listed in synonyms:
        for s in listed:
            by_phrase.setdefault(s, []).append(t)
    rank, listed_of = {t: i for i, (t, _) in enumerate(synonyms)}, dict(synonyms)
    signals = ontology.signals

    @F.pandas_udf("string")
    def best(searched: pd.Series, named: pd.Series, kind: pd.Series, maker: pd.Series, tagged: pd.Series) -> pd.Series:
        automaton, out = _automaton(phrases), []
        for text, n, c, b, listed in zip(searched, named, kind, maker, tagged, strict=True):
            held = set(listed)
            found, in_name, in_category, in_brand = (automaton.found(x) for x in (text, n, c, b))
            in_tags = set().union(*(automaton.found(t) for t in held)) if held else set()
            points: dict[str, int] = {}
            for t in {t for s in found for t in by_phrase[s]}:
                score = 0
                for s in listed_of[t]:
                    if s in found:
                        score = max(score, len(s.split()) * WORDS) + NAME * (s in in_name) + CATEGORY * (s in in_category) + BRAND * (s in in_brand) + TAG * (s in in_tags)
                points[t] = score
            for t in rank:
                extra = TYPE_TAG * (plain_type[t] in held) + OWN_CATEGORY * bool(own[t] and c == own[t])
                extra += sum(p for which, tag, others, p in signals if which == t and tag in held and held.intersection(others))
                if extra:
                    points[t] = points.get(t, 0) + extra
            out.append(min(points, key=lambda t: (-points[t], rank[t])) if points else None)
        return pd.Series(out, dtype=object)

    texts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (name, category, brand, *more)]
    listed = F.coalesce(F.col(tags), F.array().cast("array<string>"))
    searched = product_text(F.concat_ws(" ", *texts, F.array_join(listed, " ")))
    clean = F.filter(F.transform(listed, product_text), lambda t: t != "")
    return rows.withColumn(into, best(searched, product_text(F.col(name)), product_text(F.col(category)), product_text(F.col(brand)), clean))


def relation_score(ontology: Ontology, asked: str | None, kind: Column, category: Column) -> Column:
    """How near a product is to the type asked: 3 of it, 2 of its family, 1 of its category, else 0."""
    if not asked:
        return F.lit(0)
    family, own = ontology.families.get(asked), ontology.categories.get(asked)
    score = F.when(kind == asked, 3)
    score = score.when(ontology.map(ontology.families, kind) == family, 2) if family else score
    return (score.when(F.lower(category) == own.lower(), 1) if own else score).otherwise(0)


def valid_alternative(ontology: Ontology, family: str, a: Column, b: Column) -> Column:
    """Of one type, or of two types of that ``family`` whose products stand in for each other."""
    of = lambda kind: F.coalesce(ontology.map(ontology.families, kind) == family, F.lit(False))
    return F.coalesce(a == b, F.lit(False)) | (of(a) & of(b))


def valid_cross_sell(ontology: Ontology, a: Column, b: Column) -> Column:
    """Of two different types of which one is sold with the other."""
    pairs = F.array(*[F.lit(f"{x}\t{y}") for x, y in sorted(ontology.compatible())]).cast("array<string>")
    return F.coalesce(F.array_contains(pairs, F.concat(a, F.lit("\t"), b)), F.lit(False))


def cross_sells(rows: DataFrame, ontology: Ontology, kind: str, order: list[Column], key: str, k: int) -> DataFrame:
    """(key, n_cross_sell, cross_sell): for every product how many others are sold with it, and the k best keys in ``order``.

    Products are counted and ranked by type, and types are joined to types: no pair of products is ever made.
    """
    ranked = rows.where(F.col(kind).isNotNull()).withColumn("_place", F.row_number().over(Window.partitionBy(kind).orderBy(*order, key)))
    best = ranked.where(F.col("_place") <= k).groupBy(kind).agg(F.array_sort(F.collect_list(F.struct("_place", F.col(key).alias("_key")))).alias("_best"))
    counts = rows.where(F.col(kind).isNotNull()).groupBy(kind).agg(F.count("*").alias("_n")).join(best, kind)
    spark = rows.sparkSession
    pairs = spark.createDataFrame(sorted(ontology.compatible()), "_type string, _other string")
    met = pairs.join(counts.withColumnRenamed(kind, "_other"), "_other").groupBy("_type").agg(F.sum("_n").alias("n_cross_sell"), F.flatten(F.collect_list(F.transform("_best", lambda b: F.struct(b["_place"].alias("_place"), F.col("_other").alias("_of"), b["_key"].alias("_key"))))).alias("_all"))
    # The places within a type interleave: the best of each type first, types in the order of their names.
    chosen = met.select(F.col("_type").alias(kind), "n_cross_sell", F.transform(F.slice(F.array_sort("_all"), 1, k), lambda b: b["_key"]).alias("cross_sell"))
    return rows.join(chosen, kind, "left").select(key, F.coalesce("n_cross_sell", F.lit(0)).cast("long").alias("n_cross_sell"), "cross_sell")
