"""What scores by rules read of a passage: columns are compiled, not interpreted, and cheaper tests tell the same."""

import re

from pyspark.sql import functions as F

from marlstone.functions import questions, support, text
from marlstone.operators import scoring


def test_columns_of_once_are_compiled(spark):
    """A generator that holds a function of array elements is interpreted with all its columns; it may hold none."""
    rows = spark.createDataFrame([("a b", ["x"])], "t string, xs array<string>")
    made = scoring.once(rows, {"n": F.exists("xs", lambda x: x == "x"), "u": F.upper("t")})
    plan = made.select("n", "u")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" in plan and not any("lambda" in line for line in plan.splitlines() if "Generate" in line)
    assert [tuple(r) for r in made.collect()] == [("a b", ["x"], True, "A B")]


def test_no_branch_is_tried_at_every_character(spark):
    """Of a long text without months or numbers no expression of dates begins with a boundary that each character is asked for."""
    plan = spark.range(1).select(support.meets(F.col("id").cast("string"), support.DATE).alias("m"))._jdf.queryExecution().analyzed().toString()
    assert "january" in plan
    assert r"\b(?:january" not in plan


def test_tests_of_passages_agree_with_expressions(spark):
    said = ["in may it", "maybe so", "1st of all", "a1st", "11th", "111th day", "21stx", "x 5 y", "x5y", "may", "june july", "(a) of", "due date", "", "first 30th", "৩ may"]
    for pattern in (support.DATE, support.LIST, support.DURATION, support.AMOUNT, support.ELIGIBILITY, r"\b[0-9]+\b"):
        found = spark.createDataFrame([(s,) for s in said], "s string").select("s", text.meets(F.col("s"), pattern).alias("m")).collect()
        assert {r.s: r.m for r in found} == {s: bool(re.search(pattern, s, re.A)) for s in said}, pattern


def test_space_and_digits(spark):
    said = ["  a  b \t", "\n\n\n\na\n\n\nb\r\n", "\x0b\f x \x0b", "", " ", "a \x85", "ক ১২৩ খ", "a ", "  "]
    found = spark.createDataFrame([(s,) for s in said], "s string").select("s", questions.normalize_space(F.col("s")).alias("n"), text.normalize_digits(F.col("s")).alias("d"), F.regexp_replace(F.regexp_replace(F.regexp_replace("s", r"[ \t]+", " "), r"\n{3,}", "\n\n"), r"^\s+|\s+$", "").alias("want"))
    for r in found.collect():
        assert r.n == r.want, r
        assert r.d == r.s.translate({0x09E6 + k: str(k) for k in range(10)})


def test_quality_is_unchanged(spark):
    """Words up to 28 and single bytes take shorter ways to the same figure."""
    said = ["a " * k for k in (1, 27, 28, 29, 400)] + ["é ক খ ১ 12 x", "কর " * 30, "--- 1.2\n3\nabc def", "x" * 300, "", "ab_c-d/e " * 28, "É" * 20]
    rows = spark.createDataFrame([(s,) for s in said], "s string").select("s", text.quality_score(F.col("s")).alias("q")).collect()
    for r in rows:
        s = r.s.strip(" \t\n\r\f\v")
        n = max(len(s), 1)
        lines = [x for x in (y.strip(" ") for y in s.split("\n")) if x]
        latin, bengali = len(re.findall("[A-Za-z]", s)), len(re.findall("[ঀ-৿]", s))
        letters, digits = sum(c.isalpha() for c in s), sum(c.isdecimal() for c in s)
        words = len(re.findall(r"(?:[^\W]|[ঀ-৿])+", s))
        bare = sum(bool(re.fullmatch(r"[0-9 .:/()%|-]+", x)) for x in lines) / max(len(lines), 1)
        want = min(len(s) / 180, 1) * 0.25 + min(letters / n / 0.45, 1) * 0.35 + min(words / 28, 1) * 0.2 + min((latin + bengali) / 18, 1) * 0.25 - min(digits / n, 1) * 0.2 - bare * 0.35
        want = max(0, min(1, want - (0.7 if re.fullmatch(r"[0-9 .:/()%-]+", s) else 0))) if s else 0
        assert abs(r.q - want) < 1e-9, (s, r.q, want)
