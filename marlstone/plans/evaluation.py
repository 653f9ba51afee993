"""Registered queries of batch search and of evaluation, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import rrf_gain
from ..functions.text import LOW_QUALITY, quality_score, tokens
from ..operators import evaluation as E
from ..operators import postings
from ..operators.search import top_k_each
from ..operators.shared import checkpoints
from ..sources.tables import table
from .retrieval import QUALITY_FILTER
from .sqltext import tokens_sql


def _batch_sql(name: str, asked: str, k: int, text: str = "text", source: str = "documents") -> str:
    """CTEs that end in ``name``(question, key, score, rank): every document scored for every question of ``asked``(question, term, times)."""
    return f"""
    {name}_tok AS (SELECT doc_id AS key, {tokens_sql(text)} AS toks FROM {source}),
    {name}_raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS i FROM (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(toks)) AS term FROM {name}_tok) GROUP BY term), (SELECT count(*) AS n FROM {name}_tok)),
    {name}_idf AS (SELECT term, CASE WHEN i < 0 THEN 0.25 * (SELECT avg(i) FROM {name}_raw) ELSE i END AS idf FROM {name}_raw),
    {name}_tf AS (SELECT key, dl, term, count(*) AS tf FROM (SELECT key, len(toks) AS dl, unnest(toks) AS term FROM {name}_tok) GROUP BY ALL),
    {name}_s AS (SELECT question, key, round(sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(len(toks)) FROM {name}_tok)))), 6) AS score
      FROM {asked} JOIN {name}_idf USING (term) JOIN {name}_tf USING (term) GROUP BY question, key),
    {name} AS (SELECT question, key, score, row_number() OVER (PARTITION BY question ORDER BY score DESC, key) AS rank FROM {name}_s WHERE score > 0 QUALIFY rank <= {k})"""


def bm25_batch(spark: SparkSession, sf: str) -> DataFrame:
    """Every text of the benchmark as a question to all documents, ten best each."""
    checkpoints(spark)
    index = postings.build(table(spark, sf, "documents"), "doc_id", "text")
    hits = postings.search(index, table(spark, sf, "benchmark"), 10, "item_id")
    return hits.select(F.col("question").alias("item_id"), F.col("key").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


BM25_BATCH = f"""WITH q AS (SELECT question, term, count(*) AS times FROM (SELECT item_id AS question, unnest({tokens_sql()}) AS term FROM benchmark) GROUP BY ALL), {_batch_sql('h', 'q', 10)}
    SELECT question AS item_id, key AS doc_id, score, rank FROM h"""

def index_versions(spark: SparkSession, sf: str) -> DataFrame:
    """An index of most documents, changed three times and compacted: the benchmark's texts asked of the third version and of the compacted one."""
    from uuid import uuid4

    from ..operators.segments import SegmentedIndex
    from ..operators.shared import shared_folder

    docs, asked = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "benchmark")
    index = SegmentedIndex(spark, f"{shared_folder(spark)}/segments-{uuid4().hex}", "doc_id")
    index.upsert(docs.where("doc_id % 10 < 8"))
    index.upsert(docs.where("doc_id % 10 IN (0, 8, 9)").withColumn("text", F.substring_index("text", "\n", 1)))
    merged = index.delete(docs.where("doc_id % 7 = 3"))
    index.compact()
    hits = [index.search(asked, 10, "item_id", version=v).withColumn("state", F.lit(n)) for n, v in (("merged", merged), ("compacted", merged + 1))]
    return hits[0].unionByName(hits[1]).select("state", F.col("question").alias("item_id"), F.col("key").alias("doc_id"), "score", F.col("rank").cast("long").alias("rank"))


_LIVE = "(SELECT doc_id, CASE WHEN doc_id % 10 IN (0, 8, 9) THEN split_part(text, chr(10), 1) ELSE text END AS text FROM documents WHERE doc_id % 7 <> 3)"
INDEX_VERSIONS = f"""WITH q AS (SELECT question, term, count(*) AS times FROM (SELECT item_id AS question, unnest({tokens_sql()}) AS term FROM benchmark) GROUP BY ALL), {_batch_sql('h', 'q', 10, source=_LIVE)}
    SELECT state, question AS item_id, key AS doc_id, score, rank FROM h, (VALUES ('merged'), ('compacted')) v(state)"""

#: Ranks that a channel, the fusion and the cut let through. The cut counts ranks of the fusion, so what the gate drops isn't made up for by what comes after.
CHANNEL, FUSED, CUT = 50, 20, 3
STAGES = ["channel", "fusion", "gate", "cut"]


def _traced(spark: SparkSession, sf: str) -> DataFrame:
    """Known-item search: some words of each hundredth document shall find it again, by its text or its first line, in its language and among passages of quality."""
    checkpoints(spark)
    docs = table(spark, sf, "documents")
    cases = docs.where("doc_id % 100 = 0").select(F.col("doc_id").alias("question"), F.col("doc_id").alias("key"), F.coalesce("lang", F.lit("")).alias("family"), F.array_join(F.slice(tokens("text"), 5, 6), " ").alias("words")).checkpoint()

    def channel(text: str | Column) -> DataFrame:
        return postings.search(postings.build(docs, "doc_id", text), cases, CHANNEL, text="words").checkpoint()

    channels = [channel("text"), channel(F.substring_index("text", "\n", 1))]
    both = channels[0].select("question", "key", "rank").unionByName(channels[1].select("question", "key", "rank"))
    fused = top_k_each(both.groupBy("question", "key").agg(F.sum(rrf_gain(F.col("rank"))).alias("score")), "question", "score", FUSED, "key").checkpoint()
    fit = docs.where(F.round(quality_score(F.col("text")), 6) >= LOW_QUALITY).select(F.col("doc_id").alias("key"), F.coalesce("lang", F.lit("")).alias("lang"))
    gated = fused.join(cases.select("question", "family"), "question").join(fit, "key").where("lang = family").select("question", "key", "rank").checkpoint()
    cut = gated.where(F.col("rank") <= CUT).withColumn("rank", F.row_number().over(Window.partitionBy("question").orderBy("rank")))
    return E.cascade(cases.drop("words"), {"channel": channels, "fusion": [fused], "gate": [gated], "cut": [cut]})


def eval_cascade(spark: SparkSession, sf: str) -> DataFrame:
    return _traced(spark, sf).select("question", "family", *[F.col(f"trace.{s}").alias(f"rank_{s}") for s in STAGES], "failure_stage")


_HEAD = "split_part(text, chr(10), 1)"
_TRACED = f"""quality AS ({QUALITY_FILTER}),
    c AS (SELECT doc_id AS question, coalesce(lang, '') AS family, list_slice({tokens_sql()}, 5, 10) AS words FROM documents WHERE doc_id % 100 = 0),
    q AS (SELECT question, term, count(*) AS times FROM (SELECT question, unnest(words) AS term FROM c) GROUP BY ALL), {_batch_sql('b', 'q', CHANNEL)}, {_batch_sql('h', 'q', CHANNEL, _HEAD)},
    u AS (SELECT question, key, rank FROM b UNION ALL SELECT question, key, rank FROM h),
    f AS (SELECT question, key, row_number() OVER (PARTITION BY question ORDER BY score DESC, key) AS rank FROM (SELECT question, key, round(sum(1.0 / (60 + rank)), 6) AS score FROM u GROUP BY question, key) QUALIFY rank <= {FUSED}),
    g AS (SELECT f.question, f.key, f.rank FROM f JOIN c USING (question) JOIN documents d ON d.doc_id = f.key JOIN quality USING (doc_id) WHERE coalesce(d.lang, '') = c.family AND quality >= {LOW_QUALITY}),
    x AS (SELECT question, key, row_number() OVER (PARTITION BY question ORDER BY rank) AS rank FROM g QUALIFY rank <= {CUT}),
    t AS (SELECT c.question, c.family, CAST((SELECT min(rank) FROM u WHERE u.question = c.question AND u.key = c.question) AS INTEGER) AS rank_channel,
      CAST((SELECT rank FROM f WHERE f.question = c.question AND f.key = c.question) AS INTEGER) AS rank_fusion, CAST((SELECT rank FROM g WHERE g.question = c.question AND g.key = c.question) AS INTEGER) AS rank_gate,
      CAST((SELECT rank FROM x WHERE x.question = c.question AND x.key = c.question) AS INTEGER) AS rank_cut FROM c)"""
EVAL_CASCADE = f"""WITH {_TRACED}
    SELECT *, CASE WHEN rank_channel IS NULL THEN 'channel' WHEN rank_fusion IS NULL THEN 'fusion' WHEN rank_gate IS NULL THEN 'gate' WHEN rank_cut IS NULL THEN 'cut' END AS failure_stage FROM t"""


def eval_families(spark: SparkSession, sf: str) -> DataFrame:
    return E.fates(_traced(spark, sf), STAGES, ["family"])


EVAL_FAMILIES = f"""WITH {_TRACED}
    SELECT family, count(*) AS cases, count(rank_cut) AS passed, round(count(rank_cut) / count(*), 3) AS accuracy, round(avg(coalesce(1.0 / rank_cut, 0.0)), 6) AS mean_reciprocal_rank,
      {", ".join(f"round(count(rank_{s}) / count(*), 6) AS recall_{s}" for s in STAGES)},
      {", ".join(f"CAST({f'count(rank_{STAGES[i - 1]})' if i else 'count(*)'} - count(rank_{s}) AS BIGINT) AS lost_{s}" for i, s in enumerate(STAGES))} FROM t GROUP BY family"""


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as cases: the dearest line is expected, the largest one is answered; discounted lines are the hits and line states the trace."""
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.max_by("l_partkey", F.struct("l_extendedprice", -F.col("l_partkey"))).cast("string").alias("dearest"),
        F.max_by("l_partkey", F.struct("l_quantity", -F.col("l_partkey"))).cast("string").alias("largest"),
        F.array_sort(F.collect_set(F.when(F.col("l_discount") >= 0.04, F.col("l_partkey").cast("string")))).alias("hits"),
        F.array_sort(F.collect_set("l_linestatus")).alias("states"),
        F.array_sort(F.collect_set("l_returnflag")).alias("tags"),
        F.count("*").cast("int").alias("n"),
    )
    status, none = F.col("o_orderstatus"), F.lit(None)
    expected = F.struct(
        (status == "P").alias("abstained"), F.when(status != "P", F.col("dearest")).alias("primary"), F.when(F.col("n") == 2, F.col("hits")).alias("recommended"), none.cast("array<string>").alias("cross_sell"),
        (status == "O").alias("cross_sell_needed"), F.when(status == "F", F.lit("agentic")).alias("path"), F.when(status == "F", 3).alias("least_steps"), F.array(F.concat(F.lit("STATE "), status)).alias("required"),
        F.array(F.lit("1-urgent")).alias("forbidden"), F.when(F.col("n") > 5, F.array(F.lit("N"))).alias("hard_issues"), F.when(F.col("n") > 6, F.array(F.lit("r a"), F.lit("R"))).alias("missing_facts"),
        F.when(F.col("o_totalprice") > 100000, F.array(F.lit("F"))).otherwise(F.array().cast("array<string>")).alias("actions"), F.when(status == "O", F.lit("O")).alias("last_action"),
    )
    response = F.struct(
        (F.size("hits") == 0).alias("abstained"), (F.size("hits") == 0).alias("plan_abstained"), F.col("largest").alias("primary"), F.slice("hits", 1, 2).alias("recommended"), F.slice("hits", 2, 9).alias("cross_sell"),
        F.when(F.col("n") > 1, F.lit("agentic")).otherwise(F.lit("ask")).alias("path"), F.col("n").alias("steps"), F.concat_ws(" ", F.lit("state"), F.lower(status), "o_orderpriority").alias("answer"),
        F.col("tags").alias("hard_issues"), F.reverse("tags").alias("missing_facts"), F.when(F.col("n") > 1, F.col("states")).alias("actions"), F.col("hits").alias("hits"),
    )
    rows = table(spark, sf, "orders").join(lines, "o_orderkey")
    return E.judge(rows.select("o_orderkey", F.col("o_orderpriority").alias("family"), "tags", expected.alias("expected"), response.alias("response")))


_ORDERS = """l AS (SELECT l_orderkey AS k, CAST(first(l_partkey ORDER BY l_extendedprice DESC, l_partkey) AS VARCHAR) AS dearest, CAST(first(l_partkey ORDER BY l_quantity DESC, l_partkey) AS VARCHAR) AS largest,
      coalesce(list_sort(list(DISTINCT CAST(l_partkey AS VARCHAR)) FILTER (l_discount >= 0.04)), []) AS hits, list_sort(list(DISTINCT l_linestatus)) AS states, list_sort(list(DISTINCT l_returnflag)) AS tags, count(*) AS n FROM lineitem GROUP BY l_orderkey),
    o AS (SELECT *, o_orderpriority AS family, o_orderstatus AS s, len(hits) = 0 AS abstained, 'state ' || lower(o_orderstatus) || ' ' || o_orderpriority AS answer, CASE WHEN n > 1 THEN states ELSE [] END AS trace,
      lower(array_to_string(tags, ' ')) AS hard, lower(array_to_string(list_reverse(tags), ' ')) AS facts FROM orders JOIN l ON k = o_orderkey),
    j AS (SELECT o_orderkey, family, tags, s, abstained, hits, dearest, n, states, o_totalprice, list_filter([
      CASE WHEN abstained <> (s = 'P') THEN 'abstained' END, CASE WHEN abstained <> (s = 'P') THEN 'plan abstained' END, CASE WHEN s = 'P' OR largest <> dearest THEN 'primary' END,
      CASE WHEN n = 2 AND len(hits) > 0 AND hits[1:2] <> hits THEN 'recommended' END, CASE WHEN s = 'O' AND len(hits[2:10]) = 0 THEN 'no cross sell' END, CASE WHEN s = 'F' AND n = 1 THEN 'path' END, CASE WHEN s = 'F' AND n < 3 THEN 'steps' END,
      CASE WHEN NOT contains(answer, 'state ' || lower(s)) THEN 'answer lacks: STATE ' || s END, CASE WHEN contains(lower(answer), '1-urgent') THEN 'answer has: 1-urgent' END,
      CASE WHEN n > 5 AND NOT contains(hard, 'n') THEN 'hard issues lack: N' END, CASE WHEN n > 6 AND NOT contains(facts, 'r a') THEN 'missing facts lack: r a' END, CASE WHEN n > 6 AND NOT contains(facts, 'r') THEN 'missing facts lack: R' END,
      CASE WHEN o_totalprice > 100000 AND NOT list_contains(trace, 'F') THEN 'trace lacks: F' END, CASE WHEN s = 'O' AND coalesce(trace[-1], '') <> 'O' THEN 'last action' END], lambda x: x IS NOT NULL) AS failures FROM o),
    v AS (SELECT *, len(failures) = 0 AS passed, CASE WHEN len(failures) > 0 THEN CASE WHEN (s <> 'P' AND NOT list_contains(hits, dearest)) OR (len(hits) = 0 AND s <> 'P') OR (o_totalprice > 100000 AND (n = 1 OR NOT list_contains(states, 'F'))) THEN 'retrieval' ELSE 'answer' END END AS failure_stage FROM j)"""


def eval_cases(spark: SparkSession, sf: str) -> DataFrame:
    return _orders(spark, sf).select("o_orderkey", "family", F.array_join("failures", "; ").alias("failures"), "passed", "failure_stage")


EVAL_CASES = f"WITH {_ORDERS} SELECT o_orderkey, family, array_to_string(failures, '; ') AS failures, passed, failure_stage FROM v"


def eval_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return E.matrix(_orders(spark, sf), ["family"])


EVAL_MATRIX = f"""WITH {_ORDERS} SELECT family, count(*) AS cases, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed, round(count(*) FILTER (passed) / count(*), 3) AS accuracy,
    count(*) FILTER (failure_stage = 'retrieval') AS retrieval_failures, count(*) FILTER (failure_stage = 'answer') AS answer_failures, count(*) FILTER (s = 'P') AS expected_abstentions,
    count(*) FILTER (s <> 'P' AND abstained) AS needless_abstentions, count(*) FILTER (s = 'P' AND NOT abstained) AS missed_abstentions FROM v GROUP BY family"""


def eval_modes(spark: SparkSession, sf: str) -> DataFrame:
    return E.failure_modes(_orders(spark, sf))


EVAL_MODES = f"WITH {_ORDERS} SELECT tag, count(*) AS covered, count(*) FILTER (NOT passed) AS observed FROM (SELECT unnest(tags) AS tag, passed FROM v) GROUP BY tag"


def eval_contract(spark: SparkSession, sf: str) -> DataFrame:
    """Sold parts as cases, catalogued ones as the contract."""
    sold = table(spark, sf, "lineitem").select(F.col("l_partkey").alias("case_id"))
    return E.contract(sold, table(spark, sf, "part").where("p_size > 3").select(F.col("p_partkey").alias("case_id")))


EVAL_CONTRACT = """WITH c AS (SELECT DISTINCT l_partkey AS case_id FROM lineitem), w AS (SELECT DISTINCT p_partkey AS case_id FROM part WHERE p_size > 3)
    SELECT case_id, 'missing' AS side FROM w WHERE case_id NOT IN (SELECT case_id FROM c) UNION ALL SELECT case_id, 'untracked' FROM c WHERE case_id NOT IN (SELECT case_id FROM w)"""


def eval_sections(spark: SparkSession, sf: str) -> DataFrame:
    """Turns of conversations as answers: the speakers' roles are cited, some turns refuse."""
    turns = table(spark, sf, "conversations")
    refusing = F.when(F.col("turn") % 3 == 2, F.lit("Information not found in retrieved evidence. ")).otherwise("")
    rows = turns.select(
        "conv_id", "turn", F.concat(refusing, F.coalesce("text", F.lit(""))).alias("answer"), F.array("role").alias("cited_sections"), (F.col("turn") % 5 == 2).alias("expected_refusal"),
        F.when(F.col("conv_id") % 2 == 0, F.array(F.lit("user"))).otherwise(F.array().cast("array<string>")).alias("expected_sections"),
        F.when(F.col("conv_id") % 3 == 0, F.array(F.lit("E"), F.lit("THE"))).otherwise(F.array().cast("array<string>")).alias("required_substrings"),
    )
    judged = E.sections_and_phrases(rows)
    return judged.select("conv_id", "turn", F.size("matched_sections").alias("sections"), F.size("matched_substrings").alias("substrings"), "refused", "passed")


EVAL_SECTIONS = """WITH r AS (SELECT conv_id, turn, role, lower(CASE WHEN turn % 3 = 2 THEN 'Information not found in retrieved evidence. ' ELSE '' END || coalesce(text, '')) AS a FROM conversations),
    m AS (SELECT *, CASE WHEN conv_id % 2 = 0 AND role = 'user' THEN 1 ELSE 0 END AS sections, CASE WHEN conv_id % 3 = 0 THEN CAST(contains(a, 'e') AS INTEGER) + CAST(contains(a, 'the') AS INTEGER) ELSE 0 END AS substrings,
      contains(a, 'information not found in retrieved evidence') AS refused FROM r)
    SELECT conv_id, turn, sections, substrings, refused, (conv_id % 2 = 1 OR sections = 1) AND (conv_id % 3 <> 0 OR substrings = 2) AND CASE WHEN turn % 5 = 2 THEN refused ELSE conv_id % 3 <> 0 OR NOT refused END AS passed FROM m"""


def eval_approved(spark: SparkSession, sf: str) -> DataFrame:
    """Events as responses to approved cases: the kind of event is the intent, what it carries the answer."""
    events, value = table(spark, sf, "events"), F.floor("value").cast("string")
    rows = events.select(
        "event_id", F.col("event_type").alias("intent"), F.array(value).alias("products"), F.concat(F.lit("Value "), value, F.lit(" of "), F.upper("event_type")).alias("answer"),
        F.when(F.col("event_id") % 2 == 0, F.lit(" click ")).alias("expected_intent"), F.when(F.col("event_id") % 3 == 0, F.array(F.lit("1"), F.lit(" "), value)).alias("expected_products"),
        F.when(F.col("event_id") % 5 == 0, F.lit("VALUE 3")).otherwise(" ").alias("expected_substring"), F.when(F.col("event_id") % 7 == 0, F.array(F.lit("error"), F.lit(""))).alias("must_not_contain"),
    )
    return E.approved(rows).select("event_id", "checks", F.array_join("issues", "; ").alias("issues"), "passed")


EVAL_APPROVED = """WITH e AS (SELECT *, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS v FROM events),
    i AS (SELECT event_id, CAST(event_id % 2 = 0 AS INTEGER) + CAST(event_id % 3 = 0 AS INTEGER) + CAST(event_id % 5 = 0 AS INTEGER) + CAST(event_id % 7 = 0 AS INTEGER) AS checks, list_filter([
      CASE WHEN event_id % 2 = 0 AND event_type <> 'click' THEN 'intent' END, CASE WHEN event_id % 3 = 0 AND v <> '1' THEN 'missing products: 1' END,
      CASE WHEN event_id % 5 = 0 AND NOT contains(lower('Value ' || v || ' of ' || event_type), 'value 3') THEN 'substring' END, CASE WHEN event_id % 7 = 0 AND contains(lower(event_type), 'error') THEN 'must not contain: error' END,
      CASE WHEN event_id % 2 > 0 AND event_id % 3 > 0 AND event_id % 5 > 0 AND event_id % 7 > 0 THEN 'no expectations' END], lambda x: x IS NOT NULL) AS issues FROM e)
    SELECT event_id, checks, array_to_string(issues, '; ') AS issues, len(issues) = 0 AS passed FROM i"""

QUERIES = {f"q_{n}": (globals()[n], globals()[n.upper()]) for n in ("bm25_batch", "index_versions", "eval_cascade", "eval_families", "eval_cases", "eval_matrix", "eval_modes", "eval_contract", "eval_sections", "eval_approved")}
