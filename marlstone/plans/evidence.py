"""Registered queries of question, evidence and correction operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import colors, fuzzy, questions
from ..operators import evidence as E
from ..operators import search
from ..sources.tables import table
from .commerce import _PARTS, _parts
from .retrieval import _DOT, _query_vector
from .sqltext import tokens_sql

_QUESTION = "was the thing of heon and eror in that reading"


def question_kinds(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select(questions.question_kind(F.col("text")).alias("kind"), "role")
    return turns.groupBy("kind", "role").agg(F.count("*").alias("n"))


_KIND = "CASE " + " ".join(f"WHEN regexp_matches(lower(coalesce(text, '')), '{p}') THEN '{n}'" for n, p in questions.QUESTION_KINDS) + " ELSE 'general' END"
QUESTION_KINDS = f"SELECT {_KIND} AS kind, role, count(*) AS n FROM conversations GROUP BY ALL"


def salient_terms(spark: SparkSession, sf: str) -> DataFrame:
    terms = table(spark, sf, "benchmark").select("item_id", questions.salient_terms(F.col("text")).alias("t"))
    return terms.select("item_id", F.size("t").cast("long").alias("n_terms"), F.array_join("t", " ").alias("terms"))


_STOP = ", ".join(f"'{w}'" for w in questions.STOPWORDS)
_SALIENT = "list_filter({0}, lambda x, i: list_position({0}, x) = i AND length(x) > 1 AND x NOT IN (" + _STOP + "))"
SALIENT_TERMS = f"WITH s AS (SELECT item_id, {tokens_sql('text')} AS k FROM benchmark), t AS (SELECT item_id, {_SALIENT.format('k')} AS t FROM s) SELECT item_id, len(t) AS n_terms, array_to_string(t, ' ') AS terms FROM t"


def entity_phrases(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    rows = table(spark, sf, "documents").select("doc_id", F.size(questions.phrases(text, questions.AMOUNTS)).cast("long").alias("n_amounts"), F.size(questions.phrases(text, questions.DURATIONS)).cast("long").alias("n_durations"), F.size(questions.phrases(text, questions.DATES)).cast("long").alias("n_dates"), questions.enumerated_items(text).cast("long").alias("n_items"), questions.looks_list_like(text).alias("list_like"))
    return rows.where("n_amounts + n_durations + n_dates + n_items > 0 OR list_like")


def _phrases_sql(patterns: tuple[str, ...]) -> str:
    found = [f"regexp_extract_all(lower(text), '{p}')" for p in patterns]
    merged = found[0]
    for f in found[1:]:
        merged = f"list_concat({merged}, {f})"
    return f"len(list_distinct({merged}))"


ENTITY_PHRASES = rf"""WITH e AS (SELECT doc_id, {_phrases_sql(questions.AMOUNTS)} AS n_amounts, {_phrases_sql(questions.DURATIONS)} AS n_durations, {_phrases_sql(questions.DATES)} AS n_dates,
    CASE WHEN regexp_matches(lower(text), '{questions.MARKERS}') THEN len(list_distinct(regexp_extract_all(lower(text), '{questions.MARKERS}'))) ELSE len(list_distinct(regexp_extract_all(lower(text), '{questions.ORDINALS}', 1))) END AS n_items,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^\s*\([a-z0-9]{{1,3}}\)'))) >= 2 AS list_like FROM documents)
    SELECT * FROM e WHERE n_amounts + n_durations + n_dates + n_items > 0 OR list_like"""


def normalized_text(spark: SparkSession, sf: str) -> DataFrame:
    clean = questions.normalize_space(questions.normalize_digits(F.col("text")))
    rows = table(spark, sf, "conversations").select("conv_id", "turn", clean.alias("c"))
    return rows.select("conv_id", "turn", F.length("c").cast("long").alias("n_chars"), questions.truncate(F.col("c"), 40).alias("head"), questions.language(F.col("c")).alias("language"))


NORMALIZED_TEXT = r"""WITH c AS (SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(translate(text, '০১২৩৪৫৬৭৮৯', '0123456789'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g') AS c FROM conversations)
    SELECT conv_id, turn, length(c) AS n_chars, CASE WHEN length(c) > 40 THEN rtrim(substring(c, 1, 40)) || '...' ELSE c END AS head, CASE WHEN regexp_matches(c, '[\x{0980}-\x{09ff}]') THEN 'bn' ELSE 'en' END AS language FROM c"""


def best_sentences(spark: SparkSession, sf: str) -> DataFrame:
    best = E.best_sentences(table(spark, sf, "documents"), "doc_id", "text", _QUESTION, 20)
    return best.select("doc_id", F.col("at").cast("long").alias("place"), F.col("overlap").cast("long").alias("overlap"), F.length("sentence").cast("long").alias("n_chars"))


_SENTENCES = r"list_filter(list_transform(string_split(regexp_replace(coalesce({0}, ''), '([.!?।])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
BEST_SENTENCES = rf"""WITH s AS (SELECT doc_id, {_SENTENCES.format('text')} AS s FROM documents), r AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS place, s[i] AS sentence FROM (SELECT doc_id, s, unnest(range(1, len(s) + 1)) AS i FROM s)),
    q AS (SELECT {tokens_sql(f"'{_QUESTION}'")} AS k), t AS (SELECT doc_id, place, sentence, {tokens_sql('sentence')} AS k FROM r),
    o AS (SELECT doc_id, place, sentence, len(list_intersect({_SALIENT.format('t.k')}, (SELECT {_SALIENT.format('k')} FROM q))) AS overlap FROM t)
    SELECT doc_id, place, overlap, length(sentence) AS n_chars FROM o WHERE overlap > 0 ORDER BY overlap DESC, length(sentence) DESC, doc_id, place LIMIT 20"""


def verify_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Each conversation's last turn checked sentence by sentence against its first."""
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.max_by("text", "turn").alias("answer"), F.min_by("text", "turn").alias("evidence"))
    return E.verify_claims(turns, "conv_id", "answer", "evidence").select("conv_id", F.col("at").cast("long").alias("place"), "support", "supported")


VERIFY_CLAIMS = rf"""WITH c AS (SELECT conv_id, arg_max(text, turn) AS answer, lower(coalesce(arg_min(text, turn), '')) AS e FROM conversations GROUP BY conv_id), s AS (SELECT conv_id, e, {_SENTENCES.format('answer')} AS s FROM c),
    r AS (SELECT conv_id, e, CAST(i - 1 AS BIGINT) AS place, s[i] AS claim FROM (SELECT conv_id, e, s, unnest(range(1, len(s) + 1)) AS i FROM s)),
    k AS (SELECT conv_id, place, e, claim, {tokens_sql('claim')} AS a, {tokens_sql('e')} AS b FROM r), u AS (SELECT conv_id, place, e, claim, {_SALIENT.format('a')} AS a, {_SALIENT.format('b')} AS b FROM k),
    p AS (SELECT conv_id, place, CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(a, b)) / len(a) END AS support, len(list_filter(regexp_extract_all(claim, '[0-9]+(?:\.[0-9]+)?'), lambda n: NOT contains(e, n))) = 0 AS grounded FROM u)
    SELECT conv_id, place, round(support, 3) AS support, grounded AND support >= 0.35 AS supported FROM p"""


def exact_gate(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    hits = search.similar(vectors, _query_vector(vectors)).withColumn("score", F.round("score", 6))
    gated = E.exact_match_gate(hits.withColumnRenamed("label", "family"), "family", "score", "vec_id")
    return gated.where("rank <= 3").select("family", "vec_id", "score", F.col("rank").cast("long").alias("rank"), F.col("label").alias("decision"))


_HITS = f"(SELECT e.label AS family, e.vec_id, round({_DOT}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q)"
EXACT_GATE = f"""WITH r AS (SELECT *, row_number() OVER w AS rank, lead(score) OVER w AS nxt FROM {_HITS} WINDOW w AS (PARTITION BY family ORDER BY score DESC, vec_id))
    SELECT family, vec_id, score, rank, CASE WHEN rank = 1 AND score >= 0.9 THEN CASE WHEN coalesce(score - nxt >= 0.04, true) THEN 'confirmed_exact' ELSE 'likely_same_design' END ELSE 'similar' END AS decision FROM r WHERE rank <= 3"""


def prune_outliers(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    hits = search.similar(vectors, _query_vector(vectors)).select(F.lit(0).alias("query"), "vec_id", F.col("label").alias("family"), F.round("score", 6).alias("score"))
    return E.prune_outliers(hits, "query", "score", "family", "vec_id").select("vec_id", "family", "score")


PRUNE_OUTLIERS = f"""WITH b AS (SELECT score AS s, family AS c FROM {_HITS} ORDER BY score DESC, vec_id LIMIT 1)
    SELECT vec_id, family, score FROM {_HITS}, b WHERE s < 0.85 OR c IS NULL OR family IS NOT DISTINCT FROM c OR score >= s - 0.18"""


def merge_hits(spark: SparkSession, sf: str) -> DataFrame:
    rows = _parts(spark, sf)
    cheap = rows.where("p_retailprice < 1100").select("p_partkey", F.lit("cheap").alias("channel"), F.round(F.col("p_size") / 50.0, 4).alias("score"))
    brass = rows.where(F.contains(F.lower("p_type"), F.lit("brass"))).select("p_partkey", F.lit("brass").alias("channel"), F.round(F.col("stock") / 22.0, 4).alias("score"))
    return E.merge_hits([cheap, brass], "p_partkey", [F.col("score"), F.col("channel")])


MERGE_HITS = f"""WITH u AS (SELECT p_partkey, 'cheap' AS channel, round(p_size / 50.0::DOUBLE, 4) AS score FROM {_PARTS} WHERE p_retailprice < 1100 UNION ALL SELECT p_partkey, 'brass', round(stock / 22.0::DOUBLE, 4) FROM {_PARTS} WHERE contains(lower(p_type), 'brass'))
    SELECT p_partkey, channel, score FROM u QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, channel DESC) = 1"""


def link_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as links from orders to parts, against the orders that are closed and the parts that suppliers share a key with."""
    links = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    nodes = table(spark, sf, "part").join(table(spark, sf, "supplier"), F.col("p_partkey") == F.col("s_suppkey"), "left_semi").select(F.col("p_partkey").alias("k"))
    nodes = nodes.unionByName(table(spark, sf, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k")))
    return E.link_faults(links, "l_orderkey", "l_partkey", nodes, "k")


LINK_FAULTS = """WITH n AS (SELECT p_partkey AS k FROM part WHERE p_partkey IN (SELECT s_suppkey FROM supplier) UNION SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'),
    f AS (SELECT 'unknown_source' AS fault, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT k FROM n) UNION ALL SELECT 'unknown_target', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT k FROM n)
      UNION ALL SELECT 'duplicate', coalesce(sum(c - 1), 0) FROM (SELECT count(*) AS c FROM lineitem GROUP BY l_orderkey, l_partkey HAVING count(*) > 1))
    SELECT fault, CAST(n AS BIGINT) AS n FROM f WHERE n > 0"""


def graph_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Urgent orders of the smallest keys expanded to up to three of their parts."""
    hits = table(spark, sf, "orders").where(F.startswith("o_orderpriority", F.lit("1"))).select("o_orderkey")
    links = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey").distinct()
    return E.expand(hits, "o_orderkey", links, "l_orderkey", "l_partkey", 3).select("o_orderkey", "l_partkey", F.col("place").cast("long").alias("place"))


GRAPH_EXPAND = """SELECT o_orderkey, l_partkey, place FROM (SELECT l_orderkey AS o_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey) AS place
    FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE starts_with(o_orderpriority, '1')))) WHERE place <= 3"""


def price_check(spark: SparkSession, sf: str) -> DataFrame:
    """Order totals as mentioned prices, against the prices of the order's lines."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_extendedprice")).alias("prices"), F.round(F.sum("l_extendedprice"), 2).alias("total"), F.max("l_extendedprice").alias("most"))
    rows = lines.select("l_orderkey", "prices", F.array("total", "most").alias("said"))
    return E.prices_verified(rows, "l_orderkey", "said", "prices").select("l_orderkey", F.col("n_mentioned").cast("long").alias("n_mentioned"), F.col("n_supported").cast("long").alias("n_supported"))


PRICE_CHECK = """WITH l AS (SELECT l_orderkey, round(sum(l_extendedprice), 2) AS total, max(l_extendedprice) AS most FROM lineitem GROUP BY l_orderkey),
    a AS (SELECT l_orderkey, l_extendedprice AS p FROM lineitem), b AS (SELECT l_orderkey, round(p, 2) AS v FROM a UNION SELECT x.l_orderkey, unnest([round(abs(x.p - y.p), 2), round(x.p + y.p, 2)]) FROM a x JOIN a y USING (l_orderkey))
    SELECT l_orderkey, CAST(2 AS BIGINT) AS n_mentioned, CAST(CASE WHEN (l_orderkey, round(total, 2)) IN (SELECT (l_orderkey, v) FROM b) THEN 1 ELSE 0 END + CASE WHEN (l_orderkey, round(most, 2)) IN (SELECT (l_orderkey, v) FROM b) THEN 1 ELSE 0 END AS BIGINT) AS n_supported FROM l"""


def compare_sides(spark: SparkSession, sf: str) -> DataFrame:
    return E.compare_sides(_parts(spark, sf), "p_brand", ["Brand#1", "Brand#2"], "stock", "p_retailprice", "p_partkey")


COMPARE_SIDES = f"""WITH s AS (SELECT p_brand, count(*) AS in_stock, arg_min(p_partkey, (-stock, p_retailprice, p_partkey)) AS best, arg_min(p_retailprice, (-stock, p_retailprice, p_partkey)) AS best_price FROM {_PARTS} WHERE p_brand IN ('Brand#1', 'Brand#2') AND stock > 0 GROUP BY p_brand)
    SELECT p_brand, in_stock, best, best_price, best_price = (SELECT min(best_price) FROM s) AS cheaper FROM s"""


def restock_triggers(spark: SparkSession, sf: str) -> DataFrame:
    """Users' event values in time order as a stock level, in steps of 20 less one."""
    levels = table(spark, sf, "events").select("event_id", "user_id", "ts", (F.floor(F.col("value") / 20) - 1).cast("long").alias("stock"))
    return E.restock_triggers(levels, "user_id", ["ts", "event_id"], "stock").select("event_id", "user_id", "stock")


RESTOCK_TRIGGERS = """WITH l AS (SELECT event_id, user_id, ts, CAST(floor(value / 20) - 1 AS BIGINT) AS stock FROM events)
    SELECT event_id, user_id, stock FROM l QUALIFY lag(stock) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= 0 AND stock > 0"""


def nearest_color(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("p_partkey")
    return table(spark, sf, "part").select("p_partkey", colors.nearest_color(F.pmod(key * 37, F.lit(256)), F.pmod(key * 91, F.lit(256)), F.pmod(key * 13, F.lit(256))).alias("color"))


_COLORS = ", ".join(f"({i}, '{n}', {r}, {g}, {b})" for i, (n, (r, g, b)) in enumerate(colors.PALETTE.items()))
NEAREST_COLOR = f"""SELECT p_partkey, color FROM (SELECT p_partkey, n AS color, i, (p_partkey * 37 % 256 - r) ** 2 + (p_partkey * 91 % 256 - g) ** 2 + (p_partkey * 13 % 256 - b) ** 2 AS d FROM part, (VALUES {_COLORS}) c(i, n, r, g, b))
    QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY d, i) = 1"""


def spec_credit(spark: SparkSession, sf: str) -> DataFrame:
    size = questions.spec_number(F.concat(F.col("p_size").cast("string"), F.when(F.col("p_partkey") % 2 == 0, " TB").otherwise(" GB")), "storage_gb")
    return table(spark, sf, "part").select("p_partkey", size.alias("gigabytes"), F.round(questions.spec_credit(size, 40.0), 6).alias("credit"))


SPEC_CREDIT = """WITH g AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size * 1024.0::DOUBLE ELSE p_size * 1.0::DOUBLE END AS gigabytes FROM part)
    SELECT p_partkey, gigabytes, round(CASE WHEN gigabytes <= 0 THEN 0.0::DOUBLE WHEN gigabytes >= 40 THEN 1.0::DOUBLE ELSE least(0.75::DOUBLE, gigabytes / 40) END, 6) AS credit FROM g"""


def fuzzy_corrections(spark: SparkSession, sf: str) -> DataFrame:
    """Whole words of what users ask against those of the benchmark."""
    word = lambda rows: rows.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("w"))
    found = fuzzy.corrections(word(table(spark, sf, "conversations").where("role = 'user'")), "w", word(table(spark, sf, "benchmark")), "w")
    return found.select("word", "correction", F.col("distance").cast("long").alias("distance"))


FUZZY_CORRECTIONS = """WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS known FROM benchmark), w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM conversations WHERE role = 'user'),
    p AS (SELECT word, known AS correction, levenshtein(word, known) AS distance FROM w JOIN v ON abs(length(word) - length(known)) <= 2 WHERE word NOT IN (SELECT known FROM v))
    SELECT word, correction, CAST(distance AS BIGINT) AS distance FROM p WHERE distance <= 2 QUALIFY row_number() OVER (PARTITION BY word ORDER BY distance, correction) = 1"""


def fuzzy_words(spark: SparkSession, sf: str) -> DataFrame:
    """Whole words of conversations against those of the benchmark, within the operator's own distance."""
    word = lambda t: table(spark, sf, t).select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{4,}"), F.lit(0)))).alias("w"))
    found = fuzzy.corrections(word("conversations"), "w", word("benchmark"), "w")
    return found.select("word", "correction", F.col("distance").cast("long").alias("distance"))


FUZZY_WORDS = """WITH v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS known FROM benchmark), w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS word FROM conversations),
    p AS (SELECT word, known AS correction, levenshtein(word, known) AS distance FROM w JOIN v ON abs(length(word) - length(known)) <= 2 WHERE word NOT IN (SELECT known FROM v))
    SELECT word, correction, CAST(distance AS BIGINT) AS distance FROM p WHERE distance <= 2 QUALIFY row_number() OVER (PARTITION BY word ORDER BY distance, correction) = 1"""


def line_islands(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of neighbouring order lines with one return flag."""
    rows = E.islands(table(spark, sf, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], F.col("l_returnflag"))
    runs = rows.groupBy("l_orderkey", "island").agg(F.count("*").alias("n"))
    return runs.groupBy("l_orderkey").agg(F.count("*").alias("n_runs"), F.max("n").alias("longest"))


LINE_ISLANDS = """WITH m AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, CASE WHEN l_returnflag IS NOT DISTINCT FROM lag(l_returnflag) OVER w THEN 0 ELSE 1 END AS b FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice)),
    i AS (SELECT l_orderkey, sum(b) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS island FROM m), r AS (SELECT l_orderkey, island, count(*) AS n FROM i GROUP BY ALL)
    SELECT l_orderkey, count(*) AS n_runs, max(n) AS longest FROM r GROUP BY l_orderkey"""

_NAMES = (
    "question_kinds salient_terms entity_phrases normalized_text best_sentences verify_claims exact_gate prune_outliers merge_hits link_faults graph_expand price_check compare_sides restock_triggers nearest_color "
    "spec_credit fuzzy_corrections fuzzy_words line_islands"
).split()
QUERIES = {f"q_{n}": (globals()[n], globals()[n.upper()]) for n in _NAMES}
