"""Evaluation of cases: what failed, at which stage, and how families of cases fare."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: the sentence with which an answer refuses.
REFUSAL = "information not found in retrieved evidence"


def lost_in_lower(needles: Column, text: Column) -> Column:
    """The needles that ``text`` doesn't hold, whatever the case."""
    return F.filter(F.coalesce(needles, F.array().cast("array<string>")), lambda s: ~F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(s)))


def found_in_lower(needles: Column, text: Column) -> Column:
    return F.filter(F.coalesce(needles, F.array().cast("array<string>")), lambda s: F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(s)))


def _named(name: str, items: Column) -> Column:
    return F.transform(items, lambda s: F.concat(F.lit(name + ": "), s))


def _unless(ok: Column, name: str) -> Column:
    return F.when(~F.coalesce(ok, F.lit(False)), F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))


def _some(items: Column) -> Column:
    return F.coalesce(F.size(items) > 0, F.lit(False))


def case_failures(expected: Column, response: Column) -> Column:
    """What a response lacks of what a case expects, in the order of the checks.

    ``expected`` has abstained, primary, recommended, cross_sell, cross_sell_needed, path, least_steps, required, forbidden,
    hard_issues, missing_facts, actions and last_action; ``response`` has abstained, plan_abstained, primary, recommended,
    cross_sell, path, steps, answer, hard_issues, missing_facts and actions (null without a trace). Lists that a case
    leaves empty, and other fields that it leaves null, aren't checked; the primary product always is.
    """
    e, r = expected, response
    joined = lambda c: F.array_join(F.coalesce(c, F.array().cast("array<string>")), " ")
    actions = F.coalesce(r["actions"], F.array().cast("array<string>"))
    same = lambda name: ~_some(e[name]) | r[name].eqNullSafe(e[name])
    return F.concat(
        _unless(r["abstained"].eqNullSafe(e["abstained"]), "abstained"),
        _unless(r["plan_abstained"].eqNullSafe(e["abstained"]), "plan abstained"),
        _unless(r["primary"].eqNullSafe(e["primary"]), "primary"),
        _unless(same("recommended"), "recommended"),
        _unless(same("cross_sell"), "cross sell"),
        _unless(~F.coalesce(e["cross_sell_needed"], F.lit(False)) | _some(r["cross_sell"]), "no cross sell"),
        _unless(e["path"].isNull() | r["path"].eqNullSafe(e["path"]), "path"),
        _unless(e["least_steps"].isNull() | (F.coalesce(r["steps"], F.lit(0)) >= e["least_steps"]), "steps"),
        _named("answer lacks", lost_in_lower(e["required"], r["answer"])),
        _named("answer has", found_in_lower(e["forbidden"], r["answer"])),
        _named("hard issues lack", lost_in_lower(e["hard_issues"], joined(r["hard_issues"]))),
        _named("missing facts lack", lost_in_lower(e["missing_facts"], joined(r["missing_facts"]))),
        _named("trace lacks", F.filter(F.coalesce(e["actions"], F.array().cast("array<string>")), lambda a: ~F.array_contains(actions, a))),
        _unless(e["last_action"].isNull() | F.try_element_at(actions, F.lit(-1)).eqNullSafe(e["last_action"]), "last action"),
    )


def failure_stage(expected: Column, response: Column, failures: Column) -> Column:
    """Null for what passed; retrieval if the product, any hit or an action of the trace is missing; else answer."""
    hits = F.coalesce(response["hits"], F.array().cast("array<string>"))
    unseen = expected["primary"].isNotNull() & ~F.array_contains(hits, F.coalesce(expected["primary"].cast("string"), F.lit("")))
    none = (F.size(hits) == 0) & ~F.coalesce(expected["abstained"], F.lit(False))
    untraced = _some(expected["actions"]) & (response["actions"].isNull() | (F.size(F.array_except(expected["actions"], F.coalesce(response["actions"], F.array().cast("array<string>")))) > 0))
    return F.when(F.size(failures) > 0, F.when(unseen | none | untraced, F.lit("retrieval")).otherwise(F.lit("answer")))


def judge(rows: DataFrame, expected: str = "expected", response: str = "response") -> DataFrame:
    """``rows`` with failures, passed and failure_stage."""
    found = rows.withColumn("failures", case_failures(F.col(expected), F.col(response)))
    return found.withColumn("passed", F.size("failures") == 0).withColumn("failure_stage", failure_stage(F.col(expected), F.col(response), F.col("failures")))


def matrix(judged: DataFrame, group: list[str] | None = None) -> DataFrame:
    """One row, or one for each group: cases, passed, failed, accuracy, failures by stage, abstentions expected, needless and missed."""
    wanted, given = F.coalesce(F.col("expected.abstained"), F.lit(False)), F.coalesce(F.col("response.abstained"), F.lit(False))
    return judged.groupBy(*(group or [])).agg(
        F.count("*").alias("cases"),
        F.count_if("passed").alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.coalesce(F.round(F.try_divide(F.count_if("passed"), F.count("*")), 3), F.lit(0.0)).alias("accuracy"),
        F.count_if(F.coalesce(F.col("failure_stage") == "retrieval", F.lit(False))).alias("retrieval_failures"),
        F.count_if(F.coalesce(F.col("failure_stage") == "answer", F.lit(False))).alias("answer_failures"),
        F.count_if(wanted).alias("expected_abstentions"),
        F.count_if(~wanted & given).alias("needless_abstentions"),
        F.count_if(wanted & ~given).alias("missed_abstentions"),
    )


def failure_modes(judged: DataFrame, tags: str = "tags") -> DataFrame:
    """(tag, covered, observed): cases that have the tag, and those of them that failed."""
    return judged.select(F.explode(tags).alias("tag"), "passed").groupBy("tag").agg(F.count("*").alias("covered"), F.count_if(~F.col("passed")).alias("observed"))


def contract(cases: DataFrame, wanted: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, side): ids that the contract names and no case has (missing), and ids of cases that it doesn't name (untracked)."""
    have, want = cases.select(case).distinct(), wanted.select(case).distinct()
    return want.join(have, case, "left_anti").withColumn("side", F.lit("missing")).unionByName(have.join(want, case, "left_anti").withColumn("side", F.lit("untracked")))


def sections_and_phrases(rows: DataFrame) -> DataFrame:
    """Adds matched_sections, matched_substrings, refused and passed to rows of (expected_sections, required_substrings, expected_refusal, cited_sections, answer).

    A case that names substrings and no refusal fails if the answer refuses; one that names nothing passes.
    """
    refused = F.contains(F.lower(F.coalesce("answer", F.lit(""))), F.lit(REFUSAL))
    rows = rows.withColumn("matched_sections", F.filter("expected_sections", lambda s: F.array_contains("cited_sections", s)))
    rows = rows.withColumn("matched_substrings", found_in_lower(F.col("required_substrings"), F.col("answer"))).withColumn("refused", refused)
    whole = (F.size("matched_sections") == F.size("expected_sections")) & (F.size("matched_substrings") == F.size("required_substrings"))
    manner = F.when(F.col("expected_refusal"), F.col("refused")).otherwise((F.size("required_substrings") == 0) | ~F.col("refused"))
    return rows.withColumn("passed", whole & manner)


def approved(rows: DataFrame) -> DataFrame:
    """Adds issues, checks and passed to rows of an approved case (expected_intent, expected_products, expected_substring, must_not_contain) and a response (intent, products, answer).

    Blank expectations are none, and a case without any fails for that.
    """
    text = lambda name: F.nullif(F.trim(F.coalesce(name, F.lit(""))), F.lit(""))
    listed = lambda name: F.filter(F.coalesce(name, F.array().cast("array<string>")), lambda s: F.trim(s) != "")
    intent, phrase, wanted, barred = text("expected_intent"), text("expected_substring"), listed("expected_products"), listed("must_not_contain")
    checks = intent.isNotNull().cast("int") + (F.size(wanted) > 0).cast("int") + phrase.isNotNull().cast("int") + F.size(barred)
    missing = F.array_join(F.array_except(wanted, F.coalesce("products", F.array().cast("array<string>"))), ", ")
    issues = F.concat(
        _unless(intent.isNull() | F.col("intent").eqNullSafe(intent), "intent"),
        F.when(missing != "", F.array(F.concat(F.lit("missing products: "), missing))).otherwise(F.array().cast("array<string>")),
        _unless(phrase.isNull() | F.contains(F.lower(F.coalesce("answer", F.lit(""))), F.lower(phrase)), "substring"),
        _named("must not contain", found_in_lower(barred, F.col("answer"))),
        _unless(checks > 0, "no expectations"),
    )
    return rows.withColumn("issues", issues).withColumn("checks", checks).withColumn("passed", F.size("issues") == 0)


def cascade(expected: DataFrame, stages: dict[str, list[DataFrame]], case: str = "question", key: str = "key") -> DataFrame:
    """``expected`` (case, key and more) with ``trace``, a struct of the rank in each stage, and ``failure_stage``, the first stage that has lost the key.

    ``stages`` are in the order in which a search goes through them, each with the rankings (case, key, rank) of its lists; of
    several lists of a stage one is enough, and the best rank counts. All stages are one union and one aggregate beside
    the expected pairs, whatever their number; what isn't expected goes before anything is grouped.
    """
    rows = [df.select(F.col(case).alias("_case"), F.col(key).alias("_key"), F.lit(i).alias("_stage"), F.col("rank").cast("int").alias("_rank")) for i, lists in enumerate(stages.values()) for df in lists]
    held = reduce(DataFrame.unionByName, rows)
    pairs = expected.select(F.col(case).alias("_case"), F.col(key).alias("_key")).distinct()
    best = [F.min(F.when(F.col("_stage") == i, F.col("_rank"))).alias(name) for i, name in enumerate(stages)]
    traced = held.join(pairs, ["_case", "_key"], "left_semi").groupBy("_case", "_key").agg(*best)
    joined = expected.join(traced, (expected[case] == F.col("_case")) & (expected[key] == F.col("_key")), "left")
    lost = F.coalesce(*[F.when(F.col(name).isNull(), F.lit(name)) for name in stages])
    return joined.select(*[expected[c] for c in expected.columns], F.struct(*stages).alias("trace"), lost.alias("failure_stage"))


def fates(traced: DataFrame, stages: list[str], group: list[str], case: str = "question") -> DataFrame:
    """For each group: cases, passed (all expected keys reach the end), accuracy, recall at each stage, mean reciprocal rank of the best at the end, and keys lost at each stage."""
    reached = [F.count(f"trace.{s}").alias(f"_at_{s}") for s in stages]
    own = traced.groupBy(*group, case).agg(F.count("*").alias("_n"), F.min(f"trace.{stages[-1]}").alias("_best"), *reached)
    found = own.groupBy(*group).agg(
        F.count("*").alias("cases"),
        F.count_if(F.col(f"_at_{stages[-1]}") == F.col("_n")).alias("passed"),
        F.round(F.avg(F.coalesce(1.0 / F.col("_best"), F.lit(0.0))), 6).alias("mean_reciprocal_rank"),
        *[F.round(F.avg(F.col(f"_at_{s}") / F.col("_n")), 6).alias(f"recall_{s}") for s in stages],
        *[F.sum((F.col(f"_at_{stages[i - 1]}") if i else F.col("_n")) - F.col(f"_at_{s}")).alias(f"lost_{s}") for i, s in enumerate(stages)],
    )
    return found.withColumn("accuracy", F.round(F.col("passed") / F.col("cases"), 3))
