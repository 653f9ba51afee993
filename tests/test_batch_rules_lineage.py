"""Batch search, evaluation, rule scores, the ontology, lineage and claims on small fixtures, against brute force or by hand."""

from collections import Counter
from math import log

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions import specs, support
from marlstone.operators import documents, evaluation, lineage, ontology, postings, scoring
from marlstone.operators.shared import checkpoints


def brute_bm25(docs, questions, k):
    """Okapi over all documents for all questions, in plain Python."""
    n, average = len(docs), sum(map(len, docs.values())) / len(docs)
    df = Counter(t for words in docs.values() for t in set(words))
    raw = {t: log(n - d + 0.5) - log(d + 0.5) for t, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    idf = {t: 0.25 * mean if v < 0 else v for t, v in raw.items()}
    out = set()
    for q, asked in questions.items():
        scores = []
        for key, words in docs.items():
            tf = Counter(words)
            s = sum(idf[t] * tf[t] * 2.5 / (tf[t] + 1.5 * (0.25 + 0.75 * len(words) / average)) for t in asked if tf[t])
            if round(s, 6) > 0:
                scores.append((-round(s, 6), key))
        out |= {(q, key, -s, i + 1) for i, (s, key) in enumerate(sorted(scores)[:k])}
    return out


def test_batch_search_and_pruning(spark, monkeypatch):
    """Ranges of few documents: every question's best equal brute force, and most ranges of questions with rare terms are never scored."""
    monkeypatch.setattr(postings, "RANGE", 8)
    checkpoints(spark)
    rng = np.random.default_rng(2)
    words = np.array([f"w{i}" for i in range(300)])
    p = 1 / np.arange(1, 301)
    docs = {i: rng.choice(words, size=int(rng.integers(0, 60)), p=p / p.sum()).tolist() for i in range(400)}
    docs[400], docs[401], docs[402] = [], ["rare", "rare", "w1"], ["rare"] + ["w0"] * 40
    questions = {q: rng.choice(words, size=4, p=p / p.sum()).tolist() for q in range(30)} | {30: ["rare", "w0"], 31: ["unknown"], 32: ["rare", "rare", "w7"], 33: []}
    table = spark.createDataFrame([(k, " ".join(v)) for k, v in docs.items()] + [(999, None)], "id long, t string").repartition(4)
    asked = spark.createDataFrame([(q, " ".join(v)) for q, v in questions.items()], "question long, text string")
    index = postings.build(table, "id", "t")
    got = {(r["question"], r["key"], r["score"], r["rank"]) for r in postings.search(index, asked, 5).collect()}
    want = brute_bm25(docs | {999: []}, questions, 5)
    assert {(q, k, r) for q, k, _, r in got} == {(q, k, r) for q, k, _, r in want}
    assert sorted(s for *_, s, _ in got) == pytest.approx(sorted(s for *_, s, _ in want))
    share = postings.scored_share(index, asked, 5).first()
    assert share["scored"] < 0.8 * share["ranges"]
    assert postings.search(index, asked.where("false"), 5).count() == 0


def test_the_written_index_is_read_again(spark, tmp_path):
    checkpoints(spark)
    docs = spark.createDataFrame([(1, "tax rate of tax"), (2, "law"), (3, None)], "id long, t string")
    asked = spark.createDataFrame([("a", "tax"), ("b", "law rate")], "question string, text string")
    postings.build(docs, "id", "t", str(tmp_path / "i"))
    got = postings.search(postings.Index.read(spark, str(tmp_path / "i")), asked, 3).collect()
    assert {(r["question"], r["key"]) for r in got} == {("a", 1), ("b", 1), ("b", 2)}
    empty = postings.build(docs.where("false"), "id", "t")
    assert postings.search(empty, asked, 3).count() == 0


def test_cascade(spark):
    """A key that each stage loses in turn, one that no list has, one that comes through, one in the second list of a stage only."""
    expected = spark.createDataFrame([(1, k, "f" if k < 4 else "g") for k in range(6)], "question int, key int, family string")
    rank = lambda keys: spark.createDataFrame([(1, k, i + 1) for i, k in enumerate(keys)] + [(2, 5, 9)], "question int, key int, rank int")
    stages = {"channel": [rank([7, 1, 2, 3]), rank([4, 1])], "fusion": [rank([2, 3, 4])], "cut": [rank([4, 3])]}
    traced = evaluation.cascade(expected, stages)
    got = {r["key"]: (r["failure_stage"], tuple(r["trace"])) for r in traced.collect()}
    assert got[0] == ("channel", (None, None, None)) and got[1] == ("fusion", (2, None, None)) and got[2] == ("cut", (3, 1, None))
    assert got[3] == (None, (4, 2, 2)) and got[4] == (None, (1, 3, 1)) and got[5][0] == "channel"
    fates = {r["family"]: r for r in evaluation.fates(traced, list(stages), ["family"]).collect()}
    assert fates["f"]["recall_channel"] == 0.75 and fates["f"]["recall_cut"] == 0.25 and fates["f"]["lost_cut"] == 1 and fates["f"]["passed"] == 0 and fates["g"]["mean_reciprocal_rank"] == 1.0


def test_judged_cases(spark):
    expected = "struct<abstained:boolean,primary:string,recommended:array<string>,cross_sell:array<string>,cross_sell_needed:boolean,path:string,least_steps:int,required:array<string>,forbidden:array<string>,hard_issues:array<string>,missing_facts:array<string>,actions:array<string>,last_action:string>"
    response = "struct<abstained:boolean,plan_abstained:boolean,primary:string,recommended:array<string>,cross_sell:array<string>,path:string,steps:int,answer:string,hard_issues:array<string>,missing_facts:array<string>,actions:array<string>,hits:array<string>>"
    plain = (False, "p1", None, None, None, None, None, ["In Stock"], ["sorry"], None, None, None, None)
    good = (False, False, "p1", ["p1"], [], "ask", 1, "It is in stock.", [], [], None, ["p1", "p2"])
    rows = [
        ("ok", plain, good), ("lacking", plain, good[:7] + ("Sorry, none.",) + good[8:]), ("unseen", plain, good[:2] + ("p2",) + good[3:11] + (["p2"],)),
        ("trace", plain[:11] + (["look", "check"], "check"), good[:10] + (["look"],) + good[11:]), ("untraced", plain[:11] + (["look"], None), good), ("null", (True, None, *[None] * 11), (None,) * 12),
        ("order", plain[:2] + (["p2", "p1"],) + plain[3:], good[:3] + (["p1", "p2"],) + good[4:]), ("none", plain[:1] + (None,) + plain[2:], good[:2] + (None,) + good[3:11] + ([],)),
    ]
    df = spark.createDataFrame([(n, ["t", n], e, r) for n, e, r in rows], f"case string, tags array<string>, expected {expected}, response {response}")
    got = {r["case"]: (r["failures"], r["failure_stage"]) for r in evaluation.judge(df).collect()}
    assert got["ok"] == ([], None)
    assert got["lacking"] == (["answer lacks: In Stock", "answer has: sorry"], "answer")
    assert got["unseen"] == (["primary"], "retrieval") and got["order"] == (["recommended"], "answer")
    assert got["trace"] == (["trace lacks: check", "last action"], "retrieval") and got["untraced"] == (["trace lacks: look"], "retrieval")
    assert got["null"] == (["abstained", "plan abstained"], "answer") and got["none"] == ([], None)
    whole = evaluation.matrix(evaluation.judge(df)).first()
    assert (whole["cases"], whole["passed"], whole["retrieval_failures"], whole["missed_abstentions"], whole["accuracy"]) == (8, 2, 3, 1, 0.25)
    assert evaluation.matrix(evaluation.judge(df.where("false"))).first()["accuracy"] == 0.0
    assert {r["tag"]: (r["covered"], r["observed"]) for r in evaluation.failure_modes(evaluation.judge(df)).collect()}["t"] == (8, 6)


def scored(spark, question, body, headings=(), rules=scoring.LEXICAL, **more):
    fields = dict.fromkeys(scoring.PASSAGE) | {"body": body, "headings": list(headings)} | more
    schema = "q string, p struct<" + ",".join(f"{f}:{'array<string>' if f == 'headings' else 'string'}" for f in scoring.PASSAGE) + ">"
    rows = scoring.with_facts(spark.createDataFrame([(question, tuple(fields[f] for f in scoring.PASSAGE))], schema), "q", "p")
    return rows.select("kind", "supports", scoring.scored(rows, rules).alias("s"), "facts.quality").first()


def test_rule_scores_by_hand(spark):
    """Single passages, the sum of what the rules of their kind say."""
    r = scored(spark, "What is the due date for a company", "the deadline is 30th june", rules=scoring.FUSED)
    # date 1.8, no shared informative term of {company}: -3.5, company asked and not said: -0.6
    assert r["kind"] == "date_lookup" and not r["supports"] and r["s"] == pytest.approx(1.8 - 3.5 - 0.6)
    r = scored(spark, "definition of assessee?", "“assessee” means a person", ["2. Definitions"])
    # quality, three heading rules (definition: 0.3), definition heading 3, language 2, term 2.4 and said so 3
    assert r["kind"] == "definition" and r["s"] == pytest.approx(r["quality"] * 1.2 + 3.0 + 2.0 + 2.4 + 3.0)
    r = scored(spark, "what tax in section 5.2", "5.2. Rates: tax payable", ["5. Levy"], section="5", subsection="5.2", type="table")
    # section 4 + 2.5, no salient heading term: exact spares 3, at most one costs 2.5; rate: table 1.75, said payable
    assert r["kind"] == "rate_lookup" and r["s"] == pytest.approx(r["quality"] * 1.2 + 6.5 - 2.5 + 1.75)
    r = scored(spark, "am i eligible as a day labourer", "income of a worker is chargeable to tax", rules=scoring.FUSED)
    # supports 1.8, labour 2.1, nothing shared but an anchor
    assert r["kind"] == "eligibility" and r["supports"] and r["s"] == pytest.approx(1.8 + 2.1)
    r = scored(spark, None, None)
    assert r["kind"] == "general" and r["supports"] and r["s"] == 0.0


def test_phrases_that_must_be_shared(spark):
    rows = spark.createDataFrame([("tax day when", "30 june"), ("tax day when", "the tax day"), ("loss carried forward", "is set off"), ("loss carried forward", "is lost")], "a string, p string")
    assert [r[0] for r in rows.select(support.shares_phrases(F.col("a"), F.col("p"))).collect()] == [False, True, True, False]


def test_spec_words(spark):
    def told(value, key=None):
        return spark.createDataFrame([(value,)], "v string").select(specs.spec_bool(F.col("v"), key)).first()[0]

    assert [told(v) for v in ("off", "Disabled", "unsupported", "N", "passive isolation", "Yes!", "leather", "  ", None)] == [False, False, False, False, False, True, True, None, None]
    assert told("2.4GHz dongle", "wireless_support") and told("144 Hz", "high_refresh_support") and not told("60hz", "high_refresh_support") and not told("matte", "high_refresh_support")
    assert not told("phone-connected GPS", "built_in_gps_support") and told("phone-connected GPS", "gps_support") and told("Wi-Fi 6E", "wifi6_support")
    facts = spark.createDataFrame([({"capacity": "2 TB"},)], "f map<string,string>")
    assert facts.select(specs.spec_satisfied(specs.spec_fact(F.col("f"), "storage_gb"), "storage_gb", "eq", 2048.0)).first()[0]


def test_ontology(spark):
    kinds = ontology.Ontology(
        {"mic": ("mic", "usb mic"), "stand": ("laptop stand",), "laptop": ("laptop", "notebook"), "speaker": ("speaker",)}, {"mic": "audio", "speaker": "audio"}, {"laptop": "Computers", "speaker": "Sound"}, {"laptop": ("stand", "mic")}, (("speaker", "speaker", ("outdoor",), 4),)
    )
    rows = [(1, "USB-mic stand", "x", "y", None), (2, "The usb mic", "Audio", "Mic Co", ["mic"]), (3, "Laptop Stand", None, None, []), (4, "gamic", "computers", None, ["Notebook!"]), (5, None, None, None, ["speaker", "outdoor"]), (6, "zzz", "", "", [""]), (7, "comics", "Computers", None, [])]
    found = ontology.detect(spark.createDataFrame(rows, "id int, name string, category string, brand string, tags array<string>"), kinds, "name", "category", "brand", "tags", [])
    types = {r["id"]: r["product_type"] for r in found.collect()}
    assert types == {1: "mic", 2: "mic", 3: "stand", 4: "laptop", 5: "speaker", 6: None, 7: "laptop"}
    related = found.select("id", ontology.relation_score(kinds, "speaker", F.col("product_type"), F.col("category")).alias("s")).collect()
    assert {r["id"]: r["s"] for r in related} == {1: 2, 2: 2, 3: 0, 4: 0, 5: 3, 6: 0, 7: 0}
    sold = {r["id"]: (r["n_cross_sell"], r["cross_sell"]) for r in ontology.cross_sells(found, kinds, "product_type", [F.lit(0)], "id", 2).collect()}
    assert sold[4] == (3, [1, 3]) and sold[1] == (2, [4, 7]) and sold[5] == (0, None)
    pair = spark.createDataFrame([("mic", "laptop"), ("laptop", "mic"), ("mic", "mic"), ("mic", "speaker"), (None, "mic")], "a string, b string")
    assert [r[0] for r in pair.select(ontology.valid_cross_sell(kinds, F.col("a"), F.col("b"))).collect()] == [True, True, False, False, False]
    assert [r[0] for r in pair.select(ontology.valid_alternative(kinds, "audio", F.col("a"), F.col("b"))).collect()] == [False, False, True, True, False]


def test_automaton_against_plain_search():
    import re

    rng = np.random.default_rng(4)
    phrases = ["a", "b-c", "ab", "a b", "bc a", "+a", "c"]
    held = ontology.Automaton(phrases)
    for _ in range(400):
        text = " ".join("".join(rng.choice(list("abc-+ ", ), size=9)).split())
        assert held.found(text) == {p for p in phrases if (p in text if " " in p else re.search(rf"\b{re.escape(p)}\b", text))}


def test_ancestors_of_a_long_chain(spark, monkeypatch):
    checkpoints(spark)
    rounds = []
    double = lineage._double
    monkeypatch.setattr(lineage, "_double", lambda *a: rounds.append(1) or double(*a))
    nodes = spark.range(10_000).select(F.col("id").alias("n"), F.when(F.col("id") > 0, F.col("id") - 1).alias("p"), F.when(F.col("id") == 0, "section").when(F.col("id") == 5000, "subsection").otherwise("x").alias("k"))
    found = lineage.typed_ancestors(nodes, "n", "p", "k", {"section": ("section",), "either": ("section", "subsection")})
    assert found.where("section IS NULL").count() == 1 and found.where("either = 5000").count() == 4999 and len(rounds) < 20


def test_governing(spark):
    checkpoints(spark)
    rows = [("s", None, "section"), ("ss", "s", "subsection"), ("c", "ss", "clause"), ("c2", "s", "clause"), ("pv", "c", "proviso"), ("ex", "pv", "explanation"), ("t", "ss", "table"), ("x", "c", "note"), ("lost", "gone", "note"), ("alone", None, "note"), ("t2", None, "table")]
    got = {r["node"]: (r["reasoning_parent"], r["governing_rule"]) for r in lineage.governing(spark.createDataFrame(rows, "n string, p string, k string"), "n", "p", "k").collect()}
    assert got == {
        "s": ("s", "s"), "ss": ("s", "s"), "c": ("ss", "ss"), "c2": ("s", "s"), "pv": ("c", "c"), "ex": ("c", "c"), "t": ("s", "ss"), "x": ("c", "c"), "lost": (None, None), "alone": ("alone", "alone"), "t2": (None, None),
    }


def test_claims_in_blocks(spark, monkeypatch):
    """Many blocks of claims, keys beyond 2^53 beside a null, ties, and claims that nothing supports."""
    monkeypatch.setattr(documents, "CLAIM_BYTES", 40)
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(30)]
    claims = [(i, " ".join(rng.choice(words, size=5))) for i in range(25)] + [(90, "nothing known"), (91, None), (92, "")]
    docs = [(2**53 + 1 + i, " ".join(rng.choice(words, size=8))) for i in range(60)] + [(None, "w1 w2 w3"), (7, None)]
    found = documents.claim_support(spark.createDataFrame(claims, "c long, t string"), "c", "t", spark.createDataFrame(docs, "d long, t string").repartition(3), "d", "t")
    want = {}
    for c, t in claims:
        own = set((t or "").split())
        best = min(((-len(own & set((x or "").split())), d is None, d or 0) for d, x in docs), default=None)
        if own and best[0]:
            want[c] = (None if best[1] else best[2], round(-best[0] / len(own), 6))
    assert {r["c"]: (r["best_doc"], r["support"]) for r in found.collect()} == want
