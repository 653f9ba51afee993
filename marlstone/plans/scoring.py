"""Registered queries of rule-scored ranking and of support, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import questions, support
from ..functions.scores import AUTHORITY
from ..operators import scoring
from ..sources.tables import table
from .guides import _CLEAN
from .retrieval import QUALITY_FILTER
from .sqltext import tokens_sql

#: Questions of every kind, and what passages say: the given texts have no law in them.
ASKED = (
    "Am I eligible as a day labourer to pay tax", "I am a salaried employee will I pay tax", "Compare the company and the startup", "What is the threshold for charitable purpose", "For how many years is a loss carried forward",
    "What is the tax day for a company", "How many classes of income are there", "List of the income tax authorities", "Is software service mentioned", "Definition of assessee?", "করহার কত for company", "Give an example of dividend",
    "The process of appeal", "Calculate the levy", "Appendix a of the act", "What tax rate for a worker",
)
HEADS = ("Definitions", "Rates of tax", "Charitable purpose", "Company and startup", "Salary of persons", "সংজ্ঞা", "Classes of income")
SAID = (
    "assessee means a person.", "“assessee” means all.", "taka 5 lakh threshold for charitable purpose", "3 (three) successive assessment years a loss is carried forward", "tax day is 30th november", "(a) company (b) startup namely income tax authorities",
    "day labourer and worker tax exemption", "salary of an employee chargeable to tax", "software service company", "করহার 10% tax rate", "an example of dividend", "3.2. process of appeal", "",
)


def _pick(items: tuple[str, ...], by: str):
    return F.element_at(F.array(*[F.lit(x) for x in items]), F.expr(f"cast({by} % {len(items)} + 1 as int)"))


def _pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Each document with a question about it."""
    number = F.expr("cast(doc_id % 7 + 1 as string)")
    where = F.expr("CASE doc_id % 4 WHEN 1 THEN 'In section ' || (doc_id div 4 % 7 + 1) || ' ' WHEN 2 THEN 'In section ' || (doc_id div 4 % 7 + 1) || '.2 ' WHEN 3 THEN '2023-2024 ' ELSE '' END")
    passage = F.struct(
        F.concat(F.lit("Act "), F.coalesce("lang", F.lit(""))).alias("title"), F.when(F.expr("doc_id % 3 > 0"), F.array(F.concat(number, F.lit(". "), _pick(HEADS, "(doc_id div 2)")))).alias("headings"),
        F.concat(_pick(SAID, "(doc_id div 3)"), F.lit(" "), F.coalesce("text", F.lit(""))).alias("body"), F.when(F.expr("doc_id % 11 > 0"), number).alias("section"), F.when(F.expr("doc_id % 2 = 0"), F.concat(number, F.lit(".2"))).alias("subsection"),
        F.when(F.expr("doc_id % 3 = 0"), F.lit("2023-2024")).alias("tax_year"), F.when(F.expr("doc_id % 5 = 0"), F.lit("Appendix a")).alias("appendix"), F.lit(None).cast("string").alias("order_id"),
        _pick(("table", "example", "procedure", "text"), "(doc_id div 5)").alias("type"), _pick(tuple(AUTHORITY), "doc_id").alias("authority"),
    )
    rows = table(spark, sf, "documents").select("doc_id", F.concat(where, _pick(ASKED, "doc_id")).alias("question"), passage.alias("passage"), F.expr("doc_id % 30 * 1.0").alias("lexical"), F.expr("doc_id % 13 * 1.0").alias("dense"))
    return scoring.with_facts(rows, "question", "passage", "lexical", "dense")


def rule_scores(spark: SparkSession, sf: str) -> DataFrame:
    rows = _pairs(spark, sf)
    lexical, fused = scoring.scored(rows, scoring.LEXICAL), scoring.scored(rows, scoring.FUSED)
    return rows.select("doc_id", "kind", F.round(lexical, 5).alias("lexical"), F.round(fused, 5).alias("fused"), "supports", "supports_definition")


def _list(items) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in items) + "]"


def _any(text: str, *phrases: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{p}')" for p in phrases) + ")"


def _overlap(each: float, most: float, none: float, spared: str = "FALSE") -> str:
    return f"CASE WHEN len(informative) > 0 THEN least(shared * {each}, {most}) + CASE WHEN shared = 0 AND NOT {spared} THEN {none} ELSE 0 END ELSE 0 END"


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(asked, '{p}') THEN '{n}'" for n, p in questions.QUESTION_KINDS) + " ELSE 'general' END"
_ELIGIBLE = ", ".join(f"CASE WHEN contains(asked, '{p}') THEN string_split('{p}', ' ') ELSE [] END" for p in support.ELIGIBILITY_TERMS)
_WORK, _PAID = "(contains(asked, 'labour') OR contains(asked, 'labor') OR contains(asked, 'worker'))", "(contains(asked, 'salary') OR contains(asked, 'salaried') OR contains(asked, 'employee'))"
_LABOUR = _any("text_all", "day labourer", "day laborer", "worker")
_EMPLOY = _any("text_all", "employee", "employment")
_SALARY = _any("text_all", "salary", "employee", "employment")
_ANCHOR = _any("text_all", "chargeable to tax", "day labourer", "day laborer", "income from employment", "tax exemption")
_ROLES = """(taxable OR (NOT contains(asked, 'labo') AND NOT contains(asked, 'worker') OR contains(own, 'day labourer') OR contains(own, 'day laborer') OR contains(own, 'worker') OR contains(own, 'employee') OR contains(own, 'employment'))
      AND (NOT contains(asked, 'salar') OR contains(own, 'salary') OR contains(own, 'employee') OR contains(own, 'employment')) AND (NOT contains(asked, 'employee') OR contains(own, 'employee') OR contains(own, 'employment'))
      AND (NOT contains(asked, 'resident') AND NOT contains(asked, 'individual') OR contains(own, 'resident') OR contains(own, 'individual') OR contains(own, 'assessee')))"""

RULE_SCORES = rf"""WITH d AS (SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN 'In section ' || (doc_id // 4 % 7 + 1) || ' ' WHEN 2 THEN 'In section ' || (doc_id // 4 % 7 + 1) || '.2 ' WHEN 3 THEN '2023-2024 ' ELSE '' END || {_list(ASKED)}[doc_id % {len(ASKED)} + 1] AS q,
      'act ' || coalesce(lower(lang), '') AS title, CASE WHEN doc_id % 3 > 0 THEN (doc_id % 7 + 1) || '. ' || {_list(HEADS)}[doc_id // 2 % {len(HEADS)} + 1] ELSE '' END AS head, {_list(SAID)}[doc_id // 3 % {len(SAID)} + 1] || ' ' || coalesce(text, '') AS text,
      CASE WHEN doc_id % 11 > 0 THEN CAST(doc_id % 7 + 1 AS VARCHAR) END AS sec, CASE WHEN doc_id % 2 = 0 THEN (doc_id % 7 + 1) || '.2' END AS sub, ['table', 'example', 'procedure', 'text'][doc_id // 5 % 4 + 1] AS kind_of, doc_id % {len(AUTHORITY)} AS authority,
      CASE WHEN doc_id % 4 IN (1, 2) THEN CAST(doc_id // 4 % 7 + 1 AS VARCHAR) END AS qsec, CASE WHEN doc_id % 4 = 2 THEN (doc_id // 4 % 7 + 1) || '.2' END AS qsub FROM documents),
    quality AS ({QUALITY_FILTER.replace("FROM documents", "FROM d").replace("round(quality, 6) AS quality, round(quality, 6) < 0.22 AS low_quality", "quality")}),
    e AS (SELECT *, lower(q) AS asked, coalesce(qsub, qsec) AS ref, lower({_CLEAN.format("(head || ' ' || text)")}) AS own FROM d JOIN quality USING (doc_id)),
    f AS (SELECT *, {_KIND} AS kind, title || ' ' || own AS text_all, list_distinct({tokens_sql("q")}) AS terms, list_distinct({tokens_sql("head")}) AS head_terms,
      CASE WHEN contains(asked, 'definition of ') THEN split_part(split_part(asked, 'definition of ', 2), '?', 1) END AS target FROM e),
    g AS (SELECT *, list_distinct({tokens_sql("text_all")}) AS words, list_filter(terms, lambda t: length(t) > 1 AND t NOT IN ({", ".join(f"'{w}'" for w in questions.STOPWORDS)})) AS salient FROM f),
    h AS (SELECT *, list_distinct(list_filter(flatten([salient, CASE WHEN kind = 'eligibility' THEN flatten([{_ELIGIBLE}]) ELSE [] END, CASE WHEN kind = 'definition' AND target IS NOT NULL THEN [target] ELSE [] END]), lambda t: t NOT IN ({", ".join(f"'{w}'" for w in support.GENERIC)}))) AS informative,
      coalesce(ref IS NOT NULL AND (regexp_matches(text, '^' || replace(ref, '.', '\.') || '(?:[.)]|\s*[—:-])') OR regexp_matches(head, '^' || replace(ref, '.', '\.') || '(?:[.)]|\s*[—:-])')), FALSE) AS exact,
      len(list_intersect(terms, head_terms)) AS head_shared, len(list_intersect(salient, head_terms)) AS head_salient FROM g),
    i AS (SELECT *, len(list_intersect(informative, words)) AS shared, regexp_matches(own, '{support.AMOUNT}') AS amount, regexp_matches(own, '{support.DURATION}') AS duration, regexp_matches(own, '{support.DATE}') AS dated, regexp_matches(own, '{support.LIST}') AS listed,
      {_any("own", "chargeable to tax", "tax exemption", "taxable income")} AS taxable, regexp_matches(own, '{support.ELIGIBILITY}') AS eligible,
      (NOT contains(asked, 'tax day') OR contains(own, 'tax day')) AND (NOT contains(asked, 'charitable purpose') OR contains(own, 'charitable purpose')) AND (NOT contains(asked, 'income tax authorities') OR contains(own, 'income tax authorities'))
        AND (NOT contains(asked, 'startup') OR contains(own, 'startup')) AND (NOT contains(asked, 'carried forward') OR contains(own, 'carried forward') OR contains(own, 'set off')) AS phrased FROM h),
    j AS (SELECT *, phrased AND (NOT contains(asked, 'tax day') OR dated) AND (shared > 0 OR (contains(asked, 'company') AND contains(own, 'company')) OR (contains(asked, 'assessee') AND contains(own, 'assessee')) OR (contains(asked, 'startup') AND contains(own, 'startup'))
        OR (contains(asked, 'dividend') AND contains(own, 'dividend'))) AS compares,
      eligible AND {_ROLES} AND phrased AND (shared > 0 OR {_ANCHOR.replace("text_all", "own")}) AS own_case, {_any("text_all", "করহার", "কর হার", "tax rate", "rate of tax")} AS rated, {_any("lower(text)", "করহার", "কর হার", "tax rate")} AS rated_text FROM i),
    s AS (SELECT doc_id, kind, quality * 1.2::DOUBLE
      + CASE WHEN ref IS NULL THEN 0 WHEN sub = ref THEN 4.0 + CASE WHEN exact THEN 2.5 ELSE -1.0 END WHEN sec = ref THEN 2.5 + CASE WHEN exact THEN 2.0 ELSE -1.2 END WHEN qsub IS NOT NULL THEN -2.5 WHEN sec <> qsec THEN -1.5 ELSE 0 END
      + CASE WHEN doc_id % 4 = 3 AND doc_id % 3 = 0 THEN 1.5 ELSE 0 END + CASE WHEN contains(asked, 'appendix a') AND doc_id % 5 = 0 THEN 1.5 ELSE 0 END + least(head_shared * 0.3, 1.2)
      + CASE WHEN ref IS NOT NULL THEN least(head_salient * 1.5, 4.5) - CASE WHEN NOT exact AND head_salient = 0 THEN 3.0 ELSE 0 END - CASE WHEN head_salient <= 1 THEN 2.5 ELSE 0 END ELSE 0 END + authority * 0.15
      + CASE WHEN kind = 'example' AND kind_of = 'example' THEN 1.25 ELSE 0 END
      + CASE WHEN kind = 'rate_lookup' AND kind_of = 'table' THEN 1.75 + CASE WHEN rated THEN 1.25 ELSE 0 END - CASE WHEN qsub IS NOT NULL AND sub IS DISTINCT FROM qsub THEN 2.0 ELSE 0 END ELSE 0 END
      - CASE WHEN kind = 'rate_lookup' AND NOT rated AND NOT contains(text_all, 'tax payable') THEN 1.0 ELSE 0 END
      + CASE kind WHEN 'eligibility' THEN CASE WHEN own_case THEN 1.9 ELSE -1.4 END + CASE WHEN {_WORK} THEN CASE WHEN {_LABOUR} THEN 2.4 WHEN {_EMPLOY} THEN 0.8 ELSE -0.8 END ELSE 0 END
          + CASE WHEN {_PAID} THEN CASE WHEN {_SALARY} THEN 1.2 ELSE -0.9 END ELSE 0 END + {_overlap(1.1, 3.8, -3.0, _ANCHOR)}
        WHEN 'amount_lookup' THEN CASE WHEN amount THEN 1.9 ELSE -1.5 END + {_overlap(1.2, 4.0, -3.5)} WHEN 'count_lookup' THEN CASE WHEN listed OR len(list_filter(words, lambda w: regexp_full_match(w, '[0-9]+'))) > 0 THEN 1.6 ELSE 0 END + {_overlap(1.1, 3.5, -3.2)}
        WHEN 'duration_lookup' THEN CASE WHEN duration THEN 1.8 ELSE -1.4 END + {_overlap(1.2, 4.0, -3.5)} WHEN 'date_lookup' THEN CASE WHEN dated THEN 1.7 ELSE -1.3 END + {_overlap(1.1, 3.5, -3.0)}
        WHEN 'list_lookup' THEN CASE WHEN listed THEN 1.7 ELSE -1.0 END + {_overlap(1.0, 3.0, -2.8)} WHEN 'comparison' THEN CASE WHEN compares THEN 2.4 ELSE -2.6 END + {_overlap(1.1, 3.8, -3.8)}
        WHEN 'definition' THEN CASE WHEN regexp_matches(lower(head), 'definition|সংজ্ঞা') THEN 3.0 WHEN head <> '' THEN -0.8 ELSE 0 END + CASE WHEN {_any("text_all", " means ", "defined as", "definition")} THEN 2.0 ELSE -1.2 END
          + CASE WHEN target IS NULL THEN 0 WHEN contains(text_all, target) THEN 2.4 + CASE WHEN contains(text_all, target || ' means') OR contains(text_all, '“' || target || '” means') THEN 3.0 ELSE 0 END ELSE -1.4 END ELSE 0 END
      + CASE WHEN {_any("asked", "company", "software")} THEN CASE WHEN {_any("text_all", "company", "কোম্পানি", "কম্পানি", "software")} THEN 1.0 ELSE -0.8 END ELSE 0 END AS lexical,
      least(doc_id % 30, 20) * 0.12::DOUBLE + least(doc_id % 13, 10) * 0.04 + CASE WHEN doc_id % 4 = 3 AND doc_id % 3 = 0 THEN 1.4 ELSE 0 END + CASE WHEN qsec IS NULL OR sec IS NULL THEN 0 WHEN sec = qsec THEN 1.8 ELSE -1.2 END
      + CASE WHEN qsub IS NULL THEN 0 WHEN sub = qsub THEN 2.6 ELSE -2.2 END + CASE WHEN contains(asked, 'appendix a') AND doc_id % 5 = 0 THEN 1.2 ELSE 0 END + least(head_shared * 0.25, 1.0) + authority * 0.18
      + CASE WHEN (kind = 'rate_lookup' AND kind_of = 'table') OR (kind IN ('example', 'calculation') AND kind_of = 'example') OR (kind = 'procedure' AND kind_of = 'procedure') THEN 1.1 ELSE 0 END
      - CASE WHEN kind = 'rate_lookup' AND NOT contains(text, 'করহার') AND NOT contains(text, 'কর হার') THEN 1.0 ELSE 0 END + CASE WHEN contains(asked, 'company') THEN CASE WHEN {_any("own", "company", "কোম্প", "কম্প")} THEN 1.1 ELSE -0.6 END ELSE 0 END
      + CASE kind WHEN 'mention_lookup' THEN least(len(list_intersect(salient, words)) * 0.9, 4.5) + CASE WHEN contains(asked, 'software') THEN CASE WHEN contains(own, 'software') THEN 2.8 ELSE -2.6 END ELSE 0 END
          + CASE WHEN contains(asked, 'service') THEN CASE WHEN contains(own, 'service') THEN 1.6 ELSE -1.4 END ELSE 0 END + CASE WHEN contains(own, 'software') AND contains(own, 'service') THEN 1.5 ELSE 0 END
        WHEN 'eligibility' THEN CASE WHEN own_case THEN 1.8 ELSE -1.4 END + CASE WHEN {_WORK} THEN CASE WHEN {_LABOUR} THEN 2.1 WHEN {_EMPLOY} THEN 0.7 ELSE -0.8 END ELSE 0 END
          + CASE WHEN {_PAID} THEN CASE WHEN {_SALARY} THEN 1.1 ELSE -0.9 END ELSE 0 END + {_overlap(0.9, 3.5, -3.2, _ANCHOR)}
        WHEN 'amount_lookup' THEN CASE WHEN amount THEN 2.0 ELSE -1.6 END + {_overlap(1.0, 4.0, -4.0)} WHEN 'count_lookup' THEN CASE WHEN listed OR len(list_filter(words, lambda w: regexp_full_match(w, '[0-9]+'))) > 0 THEN 1.8 ELSE 0 END + {_overlap(1.0, 4.0, -4.0)}
        WHEN 'duration_lookup' THEN CASE WHEN duration THEN 2.0 ELSE -1.5 END + {_overlap(1.0, 4.0, -4.0)} WHEN 'date_lookup' THEN CASE WHEN dated THEN 1.8 ELSE -1.4 END + {_overlap(0.9, 3.5, -3.5)}
        WHEN 'list_lookup' THEN CASE WHEN listed THEN 1.9 ELSE -1.2 END + {_overlap(0.9, 3.5, -3.2)} WHEN 'comparison' THEN CASE WHEN compares THEN 2.2 ELSE -2.2 END + {_overlap(0.9, 3.5, -3.8)} ELSE 0 END AS fused,
      CASE kind WHEN 'eligibility' THEN own_case WHEN 'amount_lookup' THEN phrased AND shared > 0 AND amount WHEN 'count_lookup' THEN phrased AND shared > 0 AND (listed OR regexp_matches(own, '\b[0-9]+\b')) WHEN 'duration_lookup' THEN phrased AND shared > 0 AND duration
        WHEN 'date_lookup' THEN phrased AND shared > 0 AND dated WHEN 'list_lookup' THEN phrased AND shared > 0 AND listed WHEN 'comparison' THEN compares
        ELSE CASE WHEN qsub IS NOT NULL THEN CASE WHEN sub = qsub THEN kind <> 'rate_lookup' OR rated_text ELSE contains(lower(text), qsub) AND kind <> 'rate_lookup' END
          WHEN qsec IS NOT NULL AND sec IS NOT NULL THEN (sec = qsec OR contains(lower(text), qsec)) AND (kind <> 'rate_lookup' OR rated_text) ELSE kind <> 'rate_lookup' OR rated_text END END AS supports,
      coalesce(contains(text_all, target), TRUE) AND {_any("text_all", "definition", "সংজ্ঞা", " means ", "defined as")} AS supports_definition FROM j)
    SELECT doc_id, kind, round(lexical, 5) AS lexical, round(fused, 5) AS fused, supports, supports_definition FROM s"""

QUERIES = {"q_rule_scores": (rule_scores, RULE_SCORES)}
