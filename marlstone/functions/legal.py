"""References and signals in questions and passages of law: sections, appendices, gazette orders, tax years, definitions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .questions import normalize_space, question_kind, salient_terms
from .text import normalize_digits, section_references, tokens

# The words before a reference, in Bengali and English.
SECTION_WORDS = "ধারা|উপ-ধারা|উপধারা|পরিশিষ্ট|অনুচ্ছেদ"
REFERENCE_WORDS = "ধারা|উপ-ধারা|উপধারা|পরিশিষ্ট|তফসিল"
APPENDIX_WORDS = "পরিশিষ্ট|appendix|annex"
ORDER_WORDS = r"এস\.?\s*আর\.?\s*ও\.?|s\.?\s*r\.?\s*o\.?"
# Questions that ask for a definition; the first that fits gives the term.
DEFINITIONS = (r"(?i)what is (?:the\s+)?definition of\s+(.+?)(?:\?|$)", r"(?i)definition of\s+(.+?)(?:\?|$)", r"(.+?)\s+মানে\s+কী(?:\?|$)", r"(.+?)\s+এর\s+সংজ্ঞা\s+কী(?:\?|$)")
_DEFINED = ("definition", "definition", "মানে", "সংজ্ঞা")
# Terms that a question of a kind gains; with words, only a question that holds one of them.
EXPANSIONS = (
    ("eligibility", (), ("taxable", "chargeable to tax", "tax exemption", "individual", "resident", "assessee", "income", "employee", "employment", "income from employment")),
    ("eligibility", ("labour", "labor", "worker", "day labourer", "day laborer"), ("day labourer", "worker", "employee")),
    ("eligibility", ("salary", "salaried", "employee", "employment"), ("salary", "employee", "income from employment")),
    ("eligibility", ("resident", "individual"), ("resident", "individual assessee")),
    ("amount_lookup", (), ("threshold", "amount", "limit", "taka", "lakh", "crore", "not more than", "exceeds")),
    ("count_lookup", (), ("count", "number", "classes", "items", "listed", "namely")),
    ("duration_lookup", (), ("years", "months", "days", "period", "carry forward", "successive")),
    ("date_lookup", (), ("date", "deadline", "due date", "effective date", "day", "month", "year")),
    ("rate_lookup", ("software",), ("software", "service")),
    ("rate_lookup", ("company", "কোম্পানি"), ("company", "company tax", "tax rate")),
    ("rate_lookup", ("what tax", "tax payable", "pay tax"), ("tax rate", "rate of tax", "tax payable")),
    ("rate_lookup", ("করহার",), ("করহার", "কর হার")),
    ("mention_lookup", (), ("mentioned", "included", "listed")),
    ("mention_lookup", ("software",), ("software", "service", "software service", "software test lab service", "website development service", "software maintenance service")),
    ("mention_lookup", ("act",), ("act", "income tax act")),
    ("definition", ("commissioner",), ("definition", "definitions", "commissioner", "means")),
    ("definition", (), ("definition", "definitions", "means")),
    ("list_lookup", (), ("list", "listed", "namely", "following", "classes")),
    ("comparison", (), ("compare", "versus", "difference", "company", "other than company")),
)


def normalized(text: Column) -> Column:
    return normalize_space(normalize_digits(F.coalesce(text, F.lit(""))))


def _each_once(text: Column, pattern: str, group: int = 0, clean: bool = False) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text if clean else normalized(text), F.lit(pattern), F.lit(group)), lambda m: F.trim(m)))


def tax_years(text: Column, clean: bool = False) -> Column:
    """Spans of two years of this century, without spaces, each once. ``clean``, here and below: the text is normalized."""
    return F.array_distinct(F.transform(_each_once(text, r"\b(20[0-9]{2}\s*[-–]\s*20[0-9]{2})\b", 1, clean), lambda y: F.replace(y, F.lit(" "), F.lit(""))))


def order_ids(text: Column, clean: bool = False) -> Column:
    """Gazette orders with their numbers; one that another contains is left out."""
    found = _each_once(text, rf"(?i)(?:^|[^A-Za-z])((?:{ORDER_WORDS})(?:\s+(?:নং|no\.?)?\s*[-:()]?\s*|\s*[-:()]\s*)?[0-9/-][A-Za-z0-9/-]*)", 1, clean)
    return F.filter(found, lambda x: ~F.exists(found, lambda y: (x != y) & F.contains(y, x)))


def cross_references(text: Column) -> Column:
    """Numbers after a word of reference, and dotted numbers, each once."""
    return F.array_distinct(F.concat(_each_once(text, rf"(?:{REFERENCE_WORDS})\s*[0-9]+(?:\.[0-9]+)*"), _each_once(text, r"\b[0-9]+(?:\.[0-9]+)+\b")))


def appendix_ids(text: Column, clean: bool = False) -> Column:
    return _each_once(text, rf"(?i)(?:{APPENDIX_WORDS})\s*[A-Za-z0-9.-]+", clean=clean)


def definition_target(text: Column, clean: bool = False) -> Column:
    """What a question asks the definition of; null if it asks for none."""
    text = text if clean else normalized(text)
    # Without its own word a pattern isn't tried: it would be from each place to the end.
    held = F.lower(text)
    terms = [F.when(F.contains(held, F.lit(w)), F.nullif(F.btrim(F.regexp_extract(text, p, 1), F.lit(" \"'`.,:;-")), F.lit(""))) for p, w in zip(DEFINITIONS, _DEFINED, strict=True)]
    return F.coalesce(*terms)


def section_marker(text: Column) -> Column:
    """A marker without the word before it and the punctuation around it."""
    return F.btrim(F.regexp_replace(normalized(text), rf"(?i)^(?:{SECTION_WORDS}|section|article)\s*", ""), F.lit(" .):;-"))


def question_parts(text: Column) -> list[dict[str, Column]]:
    """What several signals of a question are read from, by name and in steps: later parts use the columns of those names."""
    clean = F.col("_clean")
    return [
        {"_clean": normalized(text), "_kind": question_kind(text), "_tokens": tokens(text)},
        {"_lower": F.lower(clean), "_defined": definition_target(clean, True), "_sections": section_references(clean), "_salient": salient_terms(clean, F.col("_tokens"))},
    ]


def rewritten(text: Column, parts: dict[str, Column] | None = None) -> Column:
    """The question's tokens, and the terms that its kind adds, each once. ``parts``, here and below: those of ``question_parts``, if they are at hand."""
    kind, lower = (parts["_kind"], parts["_lower"]) if parts else (question_kind(text), F.lower(normalized(text)))
    words, target = (parts["_tokens"], parts["_defined"]) if parts else (tokens(text), definition_target(text))
    more = []
    for name, asked_words, terms in EXPANSIONS:
        asked = kind == name
        for k, w in enumerate(asked_words):
            held = F.contains(lower, F.lit(w)) if k == 0 else held | F.contains(lower, F.lit(w))
        more.append(F.when(asked & held if asked_words else asked, F.array(*[F.lit(t) for t in terms])).otherwise(F.array().cast("array<string>")))
    focus = F.when(kind == "definition", tokens(F.coalesce(target, F.lit("")))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.concat(words, *more, focus))


def query_signals(text: Column, parts: dict[str, Column] | None = None) -> Column:
    """All that is read from a question: kind, rewritten terms, section and subsection, tax year, appendix, order, definition.

    Without ``parts`` each signal reads the question anew; ``scoring.with_signals`` reads it once.
    """
    if parts:
        sections, kind, target, salient, read = parts["_sections"], parts["_kind"], parts["_defined"], parts["_salient"], lambda f: f(parts["_clean"], True)
    else:
        sections, kind, target, salient, read = section_references(normalized(text)), question_kind(text), definition_target(text), salient_terms(text), lambda f: f(text)
    first = lambda xs: F.try_element_at(xs, F.lit(1))
    sub = first(F.filter(sections, lambda s: F.contains(s, F.lit("."))))
    return F.struct(
        kind.alias("kind"), F.array_join(rewritten(text, parts), " ").alias("rewritten"), F.coalesce(F.substring_index(sub, ".", 1), first(sections)).alias("section"), sub.alias("subsection"), first(sections).alias("reference"),
        first(read(tax_years)).alias("tax_year"), first(read(appendix_ids)).alias("appendix"), first(read(order_ids)).alias("order_id"), target.alias("definition"), F.size(salient).alias("n_salient"),
    )
