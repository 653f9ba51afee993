"""References, signals, specifications, guardrails, chunkers and tokens of two scripts, on small fixtures."""

import itertools
import re

import pytest
from pyspark.sql import functions as F

from marlstone.functions import legal, specs
from marlstone.functions.text import quality_score, sentences, tokens
from marlstone.operators import chunkers, documents, guards, search


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first()["x"]


def test_tokens_of_two_scripts(spark):
    assert one(spark, "করহার ১০.৫% — l'été Straße, 12/3", tokens) == ["করহার", "10.5", "l", "été", "straße", "12/3"]
    assert one(spark, None, tokens) == []
    docs = spark.createDataFrame([(1, "কোম্পানির করহার বিশ শতাংশ"), (2, "ব্যক্তির আয়"), (3, "été"), (4, "eté"), (5, None)], "id long, t string")
    assert [r["id"] for r in search.Bm25(docs, "id", "t").search(["করহার"], 5).collect()] == [1]
    assert [r["id"] for r in search.Bm25(docs, "id", "t").search(["été"], 5).collect()] == [3]
    assert one(spark, "এক। দুই? Three. Four", sentences) == ["এক।", "দুই?", "Three.", "Four"]
    assert one(spark, "কোম্পানির জন্য প্রযোজ্য করহার হলো বিশ শতাংশ " * 6, quality_score) > 0.7


def test_bm25_of_common_terms(spark):
    """A term in over half of the corpus weighs a share of the mean over the whole vocabulary, as the full tables say."""
    docs = spark.createDataFrame([(i, "the " * (i % 3 + 1) + w) for i, w in enumerate("a b c d e the".split())], "id long, t string")
    index = search.Bm25(docs, "id", "t")
    full = search.okapi(index.postings(), index.vocabulary(), index.statistics(), ["the", "a"], "id")
    want = {r["id"]: r["score"] for r in full.collect()}
    got = {r["id"]: r["score"] for r in index.scores(["the", "a"]).collect()}
    assert got == pytest.approx(want) and len(got) == 6


def test_references(spark):
    text = "S.R.O. No. 25-Law/2020 and SRO 25; পরিশিষ্ট ক, Appendix B-1; ধারা ৫.২ of 2023 - 2024, 12.3.4, 2023-2024"
    assert one(spark, text, legal.order_ids) == ["S.R.O. No. 25-Law/2020", "SRO 25"]
    assert one(spark, text, legal.cross_references) == ["ধারা 5.2", "5.2", "12.3.4"]
    assert one(spark, text, legal.appendix_ids) == ["Appendix B-1"]
    assert one(spark, text, legal.tax_years) == ["2023-2024"]
    assert one(spark, "What is the definition of  “company”?", legal.definition_target) == "“company”"
    assert one(spark, "কোম্পানি মানে কী?", legal.definition_target) == "কোম্পানি" and one(spark, "hello", legal.definition_target) is None
    assert one(spark, "ধারা ৫২):", legal.section_marker) == "52" and one(spark, "Section 5.", legal.section_marker) == "5"
    signals = one(spark, "What is the rate of company tax in section 5.2?", legal.query_signals)
    assert (signals["kind"], signals["section"], signals["subsection"]) == ("rate_lookup", "5", "5.2") and signals["rewritten"].endswith("company tax tax rate")


def test_specifications(spark):
    of = lambda key: lambda c: specs.spec_bool(c, key)
    assert [one(spark, v, of("water_resistance_support")) for v in (None, " ", "No", "IPX7", "no water", "dust", "yes")] == [None, None, False, True, False, False, True]
    assert one(spark, "whatever", of(None)) is True
    assert one(spark, None, lambda c: specs.spec_satisfied(c, "ram_gb", "gte", 8.0)) is False
    assert one(spark, "1 TB", lambda c: specs.spec_satisfied(c, "storage_gb", "eq", 1024.0)) is True
    wishes = {"between 50 and 20": (20.0, 50.0), "Under tk 300": (None, 300.0), "at least $7.5": (7.5, None), "cheap": (None, None), None: (None, None)}
    assert {w: tuple(one(spark, w, specs.budget)) for w in wishes} == wishes


def test_price_sums(spark):
    prices = [1.1, 2.25, 4.5, 9.99, 20.0, 40.4]
    sums = {round(sum(c) * 100) for n in range(1, 6) for c in itertools.combinations(prices, n)}
    row = spark.createDataFrame([(prices, [33.34, 37.84, 78.24, 18.9, 0.3])], "p array<double>, m array<double>")
    got = row.select(guards.reachable_sums(F.col("p")).alias("s"), guards.unsupported_prices(F.col("m"), F.col("p")).alias("u")).first()
    assert set(got["s"]) == sums and got["u"] == [78.24, 0.3]  # all six are one price too many


def test_common_terms_read_the_texts_once_more(spark):
    """A term in over half of the corpus takes one more reading, for the mean of all weights."""
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(text):
        read.add(1)
        return text

    index = search.Bm25(spark.createDataFrame([(i, f"the w{i} w{i % 3}") for i in range(20)], "id long, t string"), "id", seen(F.col("t")))
    index.learn(["the", "w1"])
    assert read.value <= 40
    assert abs(index.idf["the"] - index.vocabulary().where("term = 'the'").first()["idf"]) < 1e-12 and index.idf["the"] > 0


def test_patterns_are_tried_where_their_words_stand(spark):
    """Alternatives by what they can't do without mean what the whole pattern means."""
    from marlstone.functions import questions, support, text

    patterns = {**dict(questions.QUESTION_KINDS), **{k: getattr(support, k) for k in ("AMOUNT", "DURATION", "DATE", "LIST", "ELIGIBILITY")}, "odd": r"a(?:b|c)?d+e{2}f\|g|[|)(]x|\(y\)z?|k*"[:-3]}
    assert [text.required(b) for b in text.branches(patterns["odd"])] == ["f|g", "x", "(y)"]
    said = ["", "am i", "I am a man and tax", "exceeds taka", "exceed takas", "5 (five) successive assessment years", "carried forward", "carryied  forward", "from here\nto there", "from a to b", "mayor", "in may", "1st", "(b)", "(xi)", "how many classes", "for how many good years",
        "period of 5", "listing", "a list", "what does x mean", "which of them are listed", "adee", "acddee|", "addeef|g", "|x", "(y)", "adeef|g", "করহার কত", "taka", "wages", "তুলনা", "i am an old one, tax"]
    rows = spark.createDataFrame([(t,) for t in said], "t string")
    for name, p in patterns.items():
        assert text.branches(p) and "|".join(text.branches(p)) == p
        for r in rows.select("t", text.meets(F.col("t"), p).alias("got"), F.rlike("t", F.lit(p)).alias("want")).collect():
            assert r["got"] == r["want"], (name, r)


def test_signals_read_a_question_once(spark):
    """A question's kind is found once for all signals; they are those of the column."""
    from marlstone.operators import scoring

    asked = ["What is the rate of company tax in section 5.2?", "Definition of  assessee?", "করহার মানে কী?", "আয় এর সংজ্ঞা কী", "Am I a worker, tax 2023 - 2024 Appendix b, S.R.O. No. 5-Law/2020", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(asked)], "i int, t string")
    known = scoring.with_signals(rows, F.col("t"), "s").select("i", "s")
    assert sorted(known.collect()) == sorted(rows.select("i", legal.query_signals(F.col("t")).alias("s")).collect())
    plan = known._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("THEN comparison") == 1


def test_price_sums_of_many_answers(spark):
    """Answers of many sizes against all combinations; nulls; sums are numbers of a matrix, so an answer of ten prices costs what ten thousand did."""
    import random

    random.seed(6)
    rows = [([random.randint(1, 40) / 4 for _ in range(random.randint(0, 12))], [random.randint(1, 400) / 4 for _ in range(random.randint(0, 4))]) for _ in range(200)]
    rows += [([], [1.0]), (None, [1.0]), ([1.0], None), ([1.0, None], [5.0]), ([1.0], [None, 1.0, 3.0])]
    data = spark.createDataFrame([(i, p, m) for i, (p, m) in enumerate(rows)], "i int, p array<double>, m array<double>").repartition(3)
    got = {r["i"]: r["u"] for r in data.select("i", guards.unsupported_prices(F.col("m"), F.col("p")).alias("u")).collect()}
    for i, (p, m) in enumerate(rows[:-3]):
        cents = [round(x * 100) for x in p or []]
        made = {sum(c) for n in range(1, 6) for c in itertools.combinations(cents, n)} | {abs(a - b) for a in cents for b in cents}
        assert got[i] == ([x for x in m if not any(abs(round(x * 100) - s) <= 1 for s in made)] if p is not None else []), i
    assert [got[i] for i in range(len(rows) - 3, len(rows))] == [None, [], [3.0]]
    plan = data.select(guards.unsupported_prices(F.col("m"), F.col("p")).alias("u"))._jdf.queryExecution().toString()
    assert "array_distinct" not in plan and "aggregate(" not in plan


def test_answer_policy_and_stock(spark):
    rows = [("a", 0, "Citations: x", False), ("a", 1, "Wrong.", False), ("b", 0, "Right.", True), ("b", 1, "Wrong.", False), ("c", 0, "Right.", True)]
    out = {r["k"]: (r["final"], r["n_removed"], r["refused"]) for r in guards.answer_policy(spark.createDataFrame(rows, "k string, at int, c string, ok boolean"), "k", "at", "c", "ok").collect()}
    assert out == {"a": (guards.REFUSAL, 1, True), "b": ("Right.", 1, False), "c": ("Right.", 0, False)}
    claims = spark.createDataFrame([("It is in stock", 0), ("It is in stock", 3), ("sold out", 2), ("sold out", 0), ("nice", 0)], "t string, n int")
    assert [r[0] for r in claims.select(guards.stock_claim_faults(F.col("t"), F.col("n"))).collect()] == [True, False, True, False, False]


def test_chunkers(spark):
    pages = spark.createDataFrame([(1, "PART I\n12345\nintro\n2. Definitions.\n(1) a means b\n(2) c means d\nExample one\nmore\nCHAPTER 2\nlast\n5 The words x"), (2, None), (3, "a\nb"), (4, "|\n12")], "id long, t string")
    blocks = [(r["kind"], r["heading"], r["chunk"]) for r in chunkers.page_blocks(pages.where("id = 1"), "id", "t").orderBy("block").collect()]
    assert blocks == [
        ("section", "PART I", "intro"), ("section", "PART I > 2. Definitions.", "2. Definitions."), ("section", "PART I > 2. Definitions.", "(1) a means b"), ("section", "PART I > 2. Definitions.", "(2) c means d"),
        ("example", "PART I > 2. Definitions.", "Example one\nmore"), ("section", "CHAPTER 2", "last\n5 The words x"),
    ]
    clean = {r["id"]: (r["c"], r["low"]) for r in pages.select("id", chunkers.cleaned(F.col("t")).alias("c"), chunkers.low_value(F.col("t")).alias("low")).collect()}
    assert clean[1] == ("intro\n2. Definitions.\n(1) a means b\n(2) c means d\nExample one\nmore\nCHAPTER 2\nlast", False) and clean[2] == ("", True) and clean[4] == ("", True)
    rows = {(r["id"], r["row"]): r["chunk"] for r in chunkers.table_rows(spark.createDataFrame([(1, "h\na\nb"), (2, "h\na"), (3, "")], "id long, t string"), "id", "t").collect()}
    assert rows == {(1, 0): "h\na", (1, 1): "h\nb", (2, 0): "h\na"}
    text = "One two three. Four five! " + "w " * 12 + ". Six"
    got = [(r["n_tokens"], r["chunk"]) for r in chunkers.long_segments(spark.createDataFrame([(1, text), (2, None)], "id long, t string"), "id", "t", 6).orderBy("piece").collect()]
    assert [n for n, _ in got] == [4, 3, 6, 6, 1, 1] and re.sub(r"\s", "", "".join(c for _, c in got)) == re.sub(r"\s", "", text)


def test_claims_in_blocks(spark, monkeypatch):
    claims = spark.createDataFrame([(i, t) for i, t in enumerate(["a b c", "c d", "zz", "", "b c d e"])], "c long, t string")
    docs = spark.createDataFrame([(5, "a b"), (2, "c b x"), (9, "d c e"), (7, None)], "k long, t string")
    want = {(0, 2, 0.666667), (1, 9, 1.0), (4, 9, 0.75)}
    assert {tuple(r) for r in documents.claim_support(claims, "c", "t", docs, "k", "t").collect()} == want
    monkeypatch.setattr(documents, "CLAIM_BYTES", 30)
    assert {tuple(r) for r in documents.claim_support(claims, "c", "t", docs, "k", "t").collect()} == want


def test_deep_trees_and_circles(spark):
    nodes = spark.createDataFrame([(i, i - 1 if i else None, "root" if i == 0 else "n") for i in range(20)], "n int, p int, k string")
    spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir"))
    assert documents.ancestor(nodes, "n", "p", "k", "root").where("ancestor = 0").count() == 19
    ring = spark.createDataFrame([(1, 2, "n"), (2, 1, "n")], "n int, p int, k string")
    with pytest.raises(ValueError):
        documents.ancestor(ring, "n", "p", "k", "root")
