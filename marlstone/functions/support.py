"""Whether a passage speaks of what a question asks, for every kind of question. Passages are lower-cased, headings first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .legal import definition_target, normalized
from .questions import salient_terms
from .text import meets, tokens

# Words of questions that are too common to tell a subject.
GENERIC = (
    "act", "amount", "assessment", "clause", "count", "date", "day", "days", "definition", "due", "effective", "how", "include", "included", "list", "listed", "many", "mean", "meaning",
    "month", "months", "number", "question", "rate", "section", "tax", "threshold", "under", "what", "when", "which", "year", "years",
)
# Phrases of a question about one's own case that count as terms.
ELIGIBILITY_TERMS = (
    "day labourer", "day laborer", "labour", "labor", "worker", "employee", "employment", "salary", "salaried", "individual", "resident", "assessee", "chargeable to tax", "tax exemption",
)
# The language of amounts, times, dates, lists and of one's own case.
AMOUNT = r"taka|crore|lakh|percent|%|threshold|limit|not more than|no more than|exceeds?|minimum|maximum"
DURATION = (
    r"\b[0-9]+\s*\([^)]*\)\s*(?:successive\s+)?(?:assessment\s+)?(?:years?|months?|days?)|\b[0-9]+\s+(?:successive\s+)?(?:assessment\s+)?years?\b|carry(?:ied)?\s+forward|period of|from .* to .*"
)
DATE = (
    r"\b(?:january|february|march|april|may|june|july|august|september|october|november|december)\b|\b[0-9]{1,2}(?:st|nd|rd|th)\b|effective from|deadline|due date|tax day|by june|by july|by september|by november"
)
LIST = r"\([a-z]\)|\([ivx]+\)|namely|following classes|following items|following incomes|first year|second year"
ELIGIBILITY = (
    r"chargeable to tax|taxable income|tax exemption|employee|employment|income from employment|salary|salaried|individual|resident|assessee|day labourer|day laborer|worker|labour|labor|wage|wages"
)
# Phrases that a passage must share with a question that has them.
REQUIRED = ("tax day", "charitable purpose", "income tax authorities", "startup")
# Phrases on which a comparison turns.
COMPARED = ("company", "other than a company", "assessee", "startup", "dividend")
# What a passage must say to a question in a role, unless it speaks of being taxable at all.
_WORKER = ("day labourer", "day laborer", "worker", "employee", "employment")
ROLES = {
    "labour": _WORKER,
    "labor": _WORKER,
    "worker": _WORKER,
    "salary": ("salary", "employee", "employment", "income from employment"),
    "salaried": ("salary", "employee", "employment", "income from employment"),
    "employee": ("employee", "employment", "income from employment"),
    "resident": ("resident", "individual", "assessee"),
    "individual": ("individual", "resident", "assessee"),
}
TAXABLE = ("chargeable to tax", "tax exemption", "taxable income")
ANCHORS = ("chargeable to tax", "day labourer", "day laborer", "income from employment", "tax exemption")


def any_of(text: Column, phrases: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(p)) for p in phrases])


def lowered(headings: Column, text: Column) -> Column:
    """What a passage is searched by: its headings and its text, normalized."""
    return F.lower(normalized(F.concat(F.array_join(F.coalesce(headings, F.array().cast("array<string>")), " "), F.lit(" "), F.coalesce(text, F.lit("")))))


def informative_terms(text: Column, kind: Column) -> Column:
    """A question's terms that tell its subject, with those of one's own case or of what is to be defined where its kind asks for them."""
    none = F.array().cast("array<string>")
    lower = F.lower(normalized(text))
    own = F.flatten(F.array(*[F.when(F.contains(lower, F.lit(p)), tokens(F.lit(p))).otherwise(none) for p in ELIGIBILITY_TERMS]))
    focus = tokens(F.coalesce(definition_target(text), F.lit("")))
    terms = F.concat(salient_terms(text), F.when(kind == "eligibility", own).otherwise(none), F.when(kind == "definition", focus).otherwise(none))
    return F.array_distinct(F.filter(terms, lambda t: ~t.isin(*GENERIC)))


def shares_phrases(asked: Column, passage: Column) -> Column:
    """A phrase that a question can't do without stands in the passage too."""
    each = [~F.contains(asked, F.lit(p)) | F.contains(passage, F.lit(p)) for p in REQUIRED]
    each.append(~F.contains(asked, F.lit("carried forward")) | any_of(passage, ("carried forward", "set off")))
    return reduce(lambda a, b: a & b, each)


def says(passage: Column) -> dict[str, Column]:
    """Of which things a passage speaks."""
    return {k: meets(passage, p) for k, p in (("amount", AMOUNT), ("duration", DURATION), ("date", DATE), ("list", LIST), ("eligibility", ELIGIBILITY), ("number", r"\b[0-9]+\b"))}


def supports(asked: Column, passage: Column, overlap: Column, told: dict[str, Column] | None = None) -> dict[str, Column]:
    """For each kind whether a passage supports the question; ``overlap`` is how many informative terms they share, ``told`` what ``says`` gave."""
    related = shares_phrases(asked, passage) & (overlap > 0)
    told = told or says(passage)
    roles = reduce(lambda a, b: a & b, [~F.contains(asked, F.lit(r)) | any_of(passage, terms) | any_of(passage, TAXABLE) for r, terms in ROLES.items()])
    focus = reduce(lambda a, b: a | b, [F.contains(asked, F.lit(p)) & F.contains(passage, F.lit(p)) for p in COMPARED])
    return {
        "amount_lookup": related & told["amount"],
        "count_lookup": related & (told["list"] | told["number"]),
        "duration_lookup": related & told["duration"],
        "date_lookup": related & told["date"],
        "list_lookup": related & told["list"],
        "comparison": shares_phrases(asked, passage) & (~F.contains(asked, F.lit("tax day")) | told["date"]) & ((overlap > 0) | focus),
        "eligibility": told["eligibility"] & roles & shares_phrases(asked, passage) & ((overlap > 0) | any_of(passage, ANCHORS)),
    }


def means_target(target: Column, passage: Column) -> Column:
    """The passage says what the term means, with or without quotes; false if there is no term."""
    term = F.lower(target)
    forms = [F.concat(F.lit(a), term, F.lit(b)) for a, b in (("“", "” means"), ('"', '" means'), ("", " means"))]
    return F.coalesce(reduce(lambda a, b: a | b, [F.contains(passage, f) for f in forms]), F.lit(False))


def supports_definition(target: Column, passage: Column) -> Column:
    """It speaks of definitions, and of every word of the term if there is one."""
    focus = F.forall(F.split(F.lower(F.coalesce(target, F.lit(""))), r"\s+"), lambda w: F.contains(passage, w))
    return focus & any_of(passage, ("definition", "সংজ্ঞা", " means ", " means\n", "defined as"))


RATE = ("করহার", "কর হার", "tax rate")


def supports_question(kind: Column, section: Column, subsection: Column, own_section: Column, own_subsection: Column, text: Column, each: dict[str, Column]) -> Column:
    """Whether a passage answers a question of its kind: the kind's own test, else the sections asked for, else a rate's language where a rate is asked."""
    rated = ~(kind == "rate_lookup") | any_of(text, RATE)
    by_subsection = F.when(own_subsection.eqNullSafe(subsection), rated).otherwise(F.contains(text, subsection) & (kind != "rate_lookup"))
    by_section = ((own_section == section) | F.contains(text, section)) & rated
    rest = F.when(subsection.isNotNull(), by_subsection).when(section.isNotNull() & own_section.isNotNull(), by_section).otherwise(rated)
    for name, test in each.items():
        rest = F.when(kind == name, test).otherwise(rest)
    return F.coalesce(rest, F.lit(False))
