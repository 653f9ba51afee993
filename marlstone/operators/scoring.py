"""Scores by rules: a table of rules, compiled to one expression that holds for every kind of question at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import support as S
from ..functions.legal import query_signals, question_parts
from ..functions.scores import authority_value
from ..functions.text import quality_score, tokens


@dataclass(frozen=True)
class Rule:
    """What a passage gains or loses by one observation.

    ``kinds``: only for questions of these kinds; ``asks``: only if the question has this signal. Then either ``on``, a fact of
    the passage, gives ``gain``, and without it ``loss``; with the fact, ``also`` gives ``more``, and without that ``less``.
    Or a ``measure`` gives ``each`` for every unit, up to ``most``, and where it is 0 ``none``, unless the fact ``spares`` it.
    Of the rules of one ``group`` only the first that applies counts: whose signal and fact hold, or that has no fact.
    """

    kinds: tuple[str, ...] = ()
    asks: str | None = None
    on: str | None = None
    gain: float = 0.0
    loss: float = 0.0
    also: str | None = None
    more: float = 0.0
    less: float = 0.0
    measure: str | None = None
    each: float = 0.0
    most: float | None = None
    none: float = 0.0
    spares: str | None = None
    group: str | None = None


def _applies(rule: Rule, kind: Column, facts: dict[str, Column]) -> Column:
    tests = [kind.isin(*rule.kinds)] if rule.kinds else []
    tests += [facts[rule.asks]] if rule.asks else []
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def _worth(rule: Rule, facts: dict[str, Column]) -> Column:
    if rule.measure:
        gained = facts[rule.measure] * rule.each
        gained = gained if rule.most is None else F.least(gained, F.lit(rule.most))
        nothing = facts[rule.measure] == 0
        return gained + F.when(nothing & ~facts[rule.spares] if rule.spares else nothing, rule.none).otherwise(0.0) if rule.none else gained
    gained = F.lit(rule.gain) + (F.when(facts[rule.also], rule.more).otherwise(rule.less) if rule.also else F.lit(0.0))
    return F.when(facts[rule.on], gained).otherwise(rule.loss) if rule.on else gained


def compiled(rules: list[Rule], kind: Column, facts: dict[str, Column]) -> Column:
    """The sum of all rules, for whatever kind a row's question has. Facts must not be null."""
    total, groups = F.lit(0.0), {}
    for rule in rules:
        if rule.group:
            groups.setdefault(rule.group, []).append(rule)
        else:
            total = total + F.when(_applies(rule, kind, facts), _worth(rule, facts)).otherwise(0.0)
    for members in groups.values():
        first = F.lit(0.0)
        for rule in reversed(members):
            held = _applies(rule, kind, facts)
            first = F.when(held & facts[rule.on] if rule.on else held, _worth(rule, facts)).otherwise(first)
        total = total + first
    return total


_LOOKUPS = {"amount_lookup": "says_amount", "count_lookup": "says_count", "duration_lookup": "says_duration", "date_lookup": "says_date", "list_lookup": "says_list", "comparison": "supports_comparison"}


def _kinds(rows: tuple[tuple[str, float, float, float, float, float], ...]) -> list[Rule]:
    """For each kind: what its language gains, what is lost without it, what each shared term adds, how much at most, and what is lost without any."""
    found = []
    for kind, gain, loss, each, most, none in rows:
        found.append(Rule(kinds=(kind,), on=_LOOKUPS[kind], gain=gain, loss=loss))
        found.append(Rule(kinds=(kind,), asks="asks_terms", measure="shared", each=each, most=most, none=none))
    return found


# What a lexical hit gains and loses.
LEXICAL = [
    Rule(measure="quality", each=1.2),
    Rule(group="section", asks="asks_reference", on="subsection_asked", gain=4.0, also="exact_heading", more=2.5, less=-1.0),
    Rule(group="section", asks="asks_reference", on="section_asked", gain=2.5, also="exact_heading", more=2.0, less=-1.2),
    Rule(group="section", asks="asks_subsection", gain=-2.5),
    Rule(group="section", asks="asks_reference", on="other_section", gain=-1.5),
    Rule(asks="asks_year", on="same_year", gain=1.5),
    Rule(asks="asks_appendix", on="same_appendix", gain=1.5),
    Rule(asks="asks_order", on="same_order", gain=2.0),
    Rule(measure="heading_shared", each=0.3, most=1.2),
    Rule(asks="asks_reference", measure="heading_salient", each=1.5, most=4.5, none=-3.0, spares="exact_heading"),
    Rule(asks="asks_reference", on="heading_salient_one", gain=-2.5),
    Rule(measure="authority", each=0.15),
    Rule(kinds=("example",), on="is_example", gain=1.25),
    Rule(kinds=("rate_lookup",), on="is_table", gain=1.75),
    Rule(kinds=("rate_lookup",), on="table_of_rates", gain=1.25),
    Rule(kinds=("rate_lookup",), asks="asks_subsection", on="table_elsewhere", gain=-2.0),
    Rule(kinds=("rate_lookup",), on="says_rate_or_payable", loss=-1.0),
    Rule(kinds=("eligibility",), on="supports_eligibility", gain=1.9, loss=-1.4),
    Rule(group="labour", kinds=("eligibility",), asks="asks_labour", on="says_labourer", gain=2.4),
    Rule(group="labour", kinds=("eligibility",), asks="asks_labour", on="says_employee", gain=0.8),
    Rule(group="labour", kinds=("eligibility",), asks="asks_labour", gain=-0.8),
    Rule(kinds=("eligibility",), asks="asks_salary", on="says_salary", gain=1.2, loss=-0.9),
    Rule(kinds=("eligibility",), asks="asks_terms", measure="shared", each=1.1, most=3.8, none=-3.0, spares="says_anchor"),
    *_kinds((
        ("amount_lookup", 1.9, -1.5, 1.2, 4.0, -3.5),
        ("count_lookup", 1.6, 0.0, 1.1, 3.5, -3.2),
        ("duration_lookup", 1.8, -1.4, 1.2, 4.0, -3.5),
        ("date_lookup", 1.7, -1.3, 1.1, 3.5, -3.0),
        ("list_lookup", 1.7, -1.0, 1.0, 3.0, -2.8),
        ("comparison", 2.4, -2.6, 1.1, 3.8, -3.8),
    )),
    Rule(group="definition", kinds=("definition",), on="definition_heading", gain=3.0),
    Rule(group="definition", kinds=("definition",), on="has_heading", gain=-0.8),
    Rule(kinds=("definition",), on="says_definition", gain=2.0, loss=-1.2),
    Rule(kinds=("definition",), asks="asks_target", on="says_target", gain=2.4, also="means_target", more=3.0, loss=-1.4),
    Rule(asks="asks_company", on="says_company", gain=1.0, loss=-0.8),
]

# What a hit of the fused ranking gains and loses after it.
FUSED = [
    Rule(measure="lexical_score", each=0.12, most=2.4),
    Rule(measure="dense_score", each=0.04, most=0.4),
    Rule(asks="asks_year", on="same_year", gain=1.4),
    Rule(group="section", asks="asks_section", on="same_section", gain=1.8),
    Rule(group="section", asks="asks_section", on="has_section", gain=-1.2),
    Rule(asks="asks_subsection", on="same_subsection", gain=2.6, loss=-2.2),
    Rule(asks="asks_appendix", on="same_appendix", gain=1.2),
    Rule(asks="asks_order", on="same_order", gain=1.4),
    Rule(measure="heading_shared", each=0.25, most=1.0),
    Rule(measure="authority", each=0.18),
    Rule(kinds=("rate_lookup",), on="is_table", gain=1.1),
    Rule(kinds=("example", "calculation"), on="is_example", gain=1.1),
    Rule(kinds=("procedure",), on="is_procedure", gain=1.1),
    Rule(kinds=("rate_lookup",), on="says_rate_in_bengali", loss=-1.0),
    Rule(asks="asks_company_by_name", on="says_company_by_name", gain=1.1, loss=-0.6),
    Rule(kinds=("mention_lookup",), measure="salient_shared", each=0.9, most=4.5),
    Rule(kinds=("mention_lookup",), asks="asks_software", on="says_software", gain=2.8, loss=-2.6),
    Rule(kinds=("mention_lookup",), asks="asks_service", on="says_service", gain=1.6, loss=-1.4),
    Rule(kinds=("mention_lookup",), on="says_software_service", gain=1.5),
    Rule(kinds=("eligibility",), on="supports_eligibility", gain=1.8, loss=-1.4),
    Rule(group="labour", kinds=("eligibility",), asks="asks_labour", on="says_labourer", gain=2.1),
    Rule(group="labour", kinds=("eligibility",), asks="asks_labour", on="says_employee", gain=0.7),
    Rule(group="labour", kinds=("eligibility",), asks="asks_labour", gain=-0.8),
    Rule(kinds=("eligibility",), asks="asks_salary", on="says_salary", gain=1.1, loss=-0.9),
    Rule(kinds=("eligibility",), asks="asks_terms", measure="shared", each=0.9, most=3.5, none=-3.2, spares="says_anchor"),
    *_kinds((
        ("amount_lookup", 2.0, -1.6, 1.0, 4.0, -4.0),
        ("count_lookup", 1.8, 0.0, 1.0, 4.0, -4.0),
        ("duration_lookup", 2.0, -1.5, 1.0, 4.0, -4.0),
        ("date_lookup", 1.8, -1.4, 0.9, 3.5, -3.5),
        ("list_lookup", 1.9, -1.2, 0.9, 3.5, -3.2),
        ("comparison", 2.2, -2.2, 0.9, 3.5, -3.8),
    )),
]


def once(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """``rows`` with more columns, which are computed once however often they are used: a generator's columns aren't merged into what reads them.

    The generator takes one finished struct: one that holds a function of array elements would interpret all of its columns, row by row, and what they share anew for each.
    """
    made = rows.select("*", F.struct(*[c.alias(n) for n, c in columns.items()]).alias("_once"))
    return made.select(*rows.columns, F.inline(F.array("_once")))


def with_signals(rows: DataFrame, question: Column, into: str) -> DataFrame:
    """``rows`` with the struct ``into`` of a question's signals and the columns of ``question_parts``, each read once."""
    names = []
    for step in question_parts(question):
        rows, names = once(rows, step), [*names, *step]
    return once(rows, {into: query_signals(question, {n: F.col(n) for n in names})})


#: What a passage has: title, headings (a list), body, section, subsection, tax_year, appendix, order_id, type and authority.
PASSAGE = ("title", "headings", "body", "section", "subsection", "tax_year", "appendix", "order_id", "type", "authority")


def with_facts(rows: DataFrame, question: str, passage: str, lexical_score: str | None = None, dense_score: str | None = None) -> DataFrame:
    """``rows`` of a question's text and a passage's struct (fields PASSAGE, and any may be null), with ``kind`` and the struct ``facts`` of all that the rules ask."""
    q, p = F.coalesce(F.col(question), F.lit("")), F.col(passage)
    nothing = F.array().cast("array<string>")
    headings, body = F.coalesce(p["headings"], nothing), F.coalesce(p["body"], F.lit(""))
    rows = with_signals(rows, q, "_signals")
    rows = once(rows, {"_heads": headings, "_own": S.lowered(headings, body)})
    title = F.coalesce(p["title"], F.lit(""))
    kind = F.col("_signals.kind")
    rows = once(rows, {
        "_terms": F.array_distinct("_tokens"), "_informative": S.informative_terms(q, kind), "_full": F.concat_ws(" ", F.lower(title), F.col("_own")),
        "_heading_terms": F.array_distinct(tokens(F.array_join("_heads", " "))), "_reference": F.col("_signals.reference"),
    })
    own, full, asked, wanted = F.col("_own"), F.col("_full"), F.col("_lower"), F.col("_reference")
    rows = once(rows, {"_words": F.array_distinct(tokens(full)), "_says": F.struct(*[c.alias(n) for n, c in S.says(own).items()])})
    common = lambda a, b: F.size(F.array_intersect(a, b))
    rows = once(rows, {"_shared": common("_informative", "_words")})
    each = S.supports(asked, own, F.col("_shared"), {n: F.col(f"_says.{n}") for n in S.says(own)})
    begins = lambda text: F.rlike(text, F.concat(F.lit("^"), F.replace(wanted, F.lit("."), F.lit("\\.")), F.lit(r"(?:[.)]|\s*[—:-])")))
    same = lambda name, signal: p[name].eqNullSafe(F.col(f"_signals.{signal}"))
    says = lambda what: F.col(f"_says.{what}")
    focus = tokens(F.coalesce("_defined", F.lit("")))
    target = (F.size(focus) > 0) & F.forall(focus, lambda t: F.contains(full, t))
    facts = {
        "quality": quality_score(body), "authority": authority_value(p["authority"]), "lexical_score": F.col(lexical_score) if lexical_score else F.lit(0.0), "dense_score": F.col(dense_score) if dense_score else F.lit(0.0),
        "heading_shared": common("_terms", "_heading_terms"), "heading_salient": common("_salient", "_heading_terms"), "heading_salient_one": common("_salient", "_heading_terms") <= 1,
        "shared": F.col("_shared"), "salient_shared": common("_salient", "_words"),
        "asks_reference": wanted.isNotNull(), "asks_section": F.col("_signals.section").isNotNull(), "asks_subsection": F.col("_signals.subsection").isNotNull(), "asks_year": F.col("_signals.tax_year").isNotNull(),
        "asks_appendix": F.col("_signals.appendix").isNotNull(), "asks_order": F.col("_signals.order_id").isNotNull(), "asks_terms": F.size("_informative") > 0, "asks_target": F.col("_defined").isNotNull(),
        "asks_labour": S.any_of(asked, ("labour", "labor", "worker")), "asks_salary": S.any_of(asked, ("salary", "salaried", "employee")), "asks_company": S.any_of(asked, ("company", "কোম্পানি", "কম্পানি", "software")),
        "asks_company_by_name": S.any_of(asked, COMPANY), "asks_software": F.contains(asked, F.lit("software")), "asks_service": F.contains(asked, F.lit("service")),
        "exact_heading": begins(body) | F.exists("_heads", begins), "subsection_asked": p["subsection"].eqNullSafe(wanted), "section_asked": p["section"].eqNullSafe(wanted),
        "other_section": F.col("_signals.section").isNotNull() & p["section"].isNotNull() & (p["section"] != F.col("_signals.section")), "same_section": same("section", "section"), "has_section": p["section"].isNotNull(),
        "same_subsection": same("subsection", "subsection"), "same_year": same("tax_year", "tax_year"), "same_appendix": same("appendix", "appendix"), "same_order": same("order_id", "order_id"),
        "is_table": p["type"] == "table", "is_example": p["type"] == "example", "is_procedure": p["type"] == "procedure", "has_heading": F.size("_heads") > 0,
        "table_of_rates": (p["type"] == "table") & S.any_of(full, ("করহার", "কর হার", "tax rate", "rate of tax")), "table_elsewhere": (p["type"] == "table") & ~same("subsection", "subsection"),
        "says_rate_or_payable": S.any_of(full, ("করহার", "কর হার", "tax rate", "rate of tax", "tax payable")), "says_rate_in_bengali": S.any_of(body, ("করহার", "কর হার")),
        "says_amount": says("amount"), "says_duration": says("duration"), "says_date": says("date"), "says_list": says("list"), "says_count": says("list") | F.exists("_words", lambda w: F.rlike(w, F.lit("^[0-9]+$"))),
        "says_labourer": S.any_of(full, ("day labourer", "day laborer", "worker")), "says_employee": S.any_of(full, ("employee", "employment")), "says_salary": S.any_of(full, ("salary", "employee", "employment", "income from employment")),
        "says_anchor": S.any_of(full, S.ANCHORS), "says_company": S.any_of(full, ("company", "কোম্পানি", "কম্পানি", "software")), "says_company_by_name": S.any_of(own, COMPANY),
        "says_software": F.contains(own, F.lit("software")), "says_service": F.contains(own, F.lit("service")), "says_software_service": F.contains(own, F.lit("software")) & F.contains(own, F.lit("service")),
        "definition_heading": F.exists("_heads", lambda h: F.rlike(F.lower(h), F.lit("definition|সংজ্ঞা"))), "says_definition": S.any_of(full, (" means ", " means\n", "defined as", "definition")),
        "says_target": target, "means_target": S.means_target(F.col("_defined"), full), "supports_comparison": each["comparison"], "supports_eligibility": each["eligibility"],
    }
    clean = {n: F.coalesce(c, F.lit(0.0 if n in ("quality", "lexical_score", "dense_score") else 0 if n in _MEASURES else False)) for n, c in facts.items()}
    supports = S.supports_question(kind, F.col("_signals.section"), F.col("_signals.subsection"), p["section"], p["subsection"], F.lower(body), each)
    rows = once(rows, {"facts": F.struct(*[c.alias(n) for n, c in clean.items()]), "kind": kind, "supports": supports, "supports_definition": S.supports_definition(F.col("_defined"), full)})
    return rows.drop("_signals", "_clean", "_kind", "_tokens", "_lower", "_defined", "_sections", "_says", "_heads", "_own", "_terms", "_salient", "_informative", "_full", "_heading_terms", "_reference", "_words", "_shared")


#: A company by name, also as it is misread.
COMPANY = ("কোম্প", "কম্প", "মকাম্প", "ককাম্প", "company")
_MEASURES = ("authority", "heading_shared", "heading_salient", "shared", "salient_shared")


def scored(rows: DataFrame, rules: list[Rule], base: Column | None = None) -> Column:
    """The score of a row of ``with_facts``."""
    names = [f.name for f in rows.schema["facts"].dataType.fields]
    return (base if base is not None else F.lit(0.0)) + compiled(rules, F.col("kind"), {n: F.col(f"facts.{n}") for n in names})
