"""Registered queries of references, rules, evidence packs, specifications and guardrails, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import legal, questions, specs
from ..functions.scores import price_fit
from ..functions.text import quality_score, sentences, token_set
from ..operators import guards as G
from ..operators import packs as P
from ..operators import ranking as R
from ..operators import scoring, search
from ..operators.shared import checkpoints
from ..sources.tables import table
from .commerce import _PARTS, _parts
from .evidence import _SENTENCES
from .ranking import _HAS
from .retrieval import _F, _TOKENS, QUALITY_FILTER, TERMS, _bm25_sql, _top_sql
from .sqltext import tokens_sql


def _clause(number: Column) -> Column:
    """A clause of law about an order, as text."""
    n = number.cast("long")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    parts = [
        "Section ", n % 90 + 1, ".", n % 7 + 1, " and Appendix ", F.substring(F.lit("ABCDE"), (n % 5 + 1).cast("int"), F.lit(1)), ": S.R.O. No. ", n, "-Law/", n % 20 + 2000,
        ", ধারা ", n % 60, " applies to tax years 20", two(n % 30), " - 20", two(n % 30 + 1), ". What is the definition of ", F.lower("o_orderpriority"), "?",
    ]
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


_CLAUSE = """'Section ' || (o_orderkey % 90 + 1) || '.' || (o_orderkey % 7 + 1) || ' and Appendix ' || substring('ABCDE', CAST(o_orderkey % 5 + 1 AS INTEGER), 1) || ': S.R.O. No. ' || o_orderkey || '-Law/' || (o_orderkey % 20 + 2000)
    || ', ধারা ' || (o_orderkey % 60) || ' applies to tax years 20' || lpad(CAST(o_orderkey % 30 AS VARCHAR), 2, '0') || ' - 20' || lpad(CAST(o_orderkey % 30 + 1 AS VARCHAR), 2, '0') || '. What is the definition of ' || lower(o_orderpriority) || '?'"""


def legal_marks(spark: SparkSession, sf: str) -> DataFrame:
    """References in a clause of law for each order."""
    text = F.col("t")
    rows = table(spark, sf, "orders").select("o_orderkey", _clause(F.col("o_orderkey")).alias("t"))
    joined = {"years": legal.tax_years(text), "orders": legal.order_ids(text), "refs": legal.cross_references(text), "appendices": legal.appendix_ids(text)}
    return rows.select("o_orderkey", *[F.array_join(c, ",").alias(n) for n, c in joined.items()], legal.definition_target(text).alias("term"), legal.section_marker(F.regexp_extract("t", r"^Section [0-9.]+", 0)).alias("marker"))


_CLEAN = r"regexp_replace(regexp_replace(regexp_replace(translate({0}, '০১২৩৪৫৬৭৮৯', '0123456789'), '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
_ONCE = "list_filter({0}, lambda x, i: list_position({0}, x) = i)"
LEGAL_MARKS = rf"""WITH c AS (SELECT o_orderkey, {_CLAUSE} AS t FROM orders), n AS (SELECT o_orderkey, {_CLEAN.format('t')} AS t FROM c),
    m AS (SELECT o_orderkey, t, regexp_extract_all(t, '\b(20[0-9]{{2}}\s*[-–]\s*20[0-9]{{2}})\b', 1) AS y,
      regexp_extract_all(t, '(?i)(?:^|[^A-Za-z])((?:{legal.ORDER_WORDS})(?:\s+(?:নং|no\.?)?\s*[-:()]?\s*|\s*[-:()]\s*)?[0-9/-][A-Za-z0-9/-]*)', 1) AS o,
      list_concat(regexp_extract_all(t, '(?:{legal.REFERENCE_WORDS})\s*[0-9]+(?:\.[0-9]+)*'), regexp_extract_all(t, '\b[0-9]+(?:\.[0-9]+)+\b')) AS r,
      regexp_extract_all(t, '(?i)(?:{legal.APPENDIX_WORDS})\s*[A-Za-z0-9.-]+') AS a FROM n)
    SELECT o_orderkey, array_to_string(list_transform({_ONCE.format('y')}, lambda x: replace(x, ' ', '')), ',') AS years, array_to_string({_ONCE.format('o')}, ',') AS orders, array_to_string({_ONCE.format('r')}, ',') AS refs,
      array_to_string({_ONCE.format('a')}, ',') AS appendices, trim(regexp_extract(t, '(?i)what is (?:the\s+)?definition of\s+(.+?)(?:\?|$)', 1), ' "''`.,:;-') AS term,
      trim(regexp_replace(regexp_extract(t, '^Section [0-9.]+'), '(?i)^(?:section)\s*', ''), ' .):;-') AS marker FROM m"""

_ASKED = {"amount_lookup": "What is the maximum amount", "duration_lookup": "How long is the period", "date_lookup": "What is the due date", "mention_lookup": "Does it say about the act", "definition": "What is the definition of thing", "comparison": "Compare this"}


def query_signals(spark: SparkSession, sf: str) -> DataFrame:
    """Signals of a question about each order: its status and priority choose how it is put."""
    asked = F.element_at(F.array(*[F.lit(t) for t in _ASKED.values()]), (F.col("o_orderkey") % len(_ASKED) + 1).cast("int"))
    text = F.concat(asked, F.lit(" in section "), (F.col("o_orderkey") % 40 + 1).cast("string"), F.when(F.col("o_orderstatus") == "O", F.lit(".2")).otherwise(F.lit("")), F.lit(" 2023-2024?"))
    rows = scoring.with_signals(table(spark, sf, "orders").select("o_orderkey", text.alias("_q")), F.col("_q"), "s")
    return rows.select("o_orderkey", "s.kind", "s.rewritten", "s.section", "s.subsection", "s.tax_year", F.col("s.n_salient").cast("long").alias("n_salient"))


def _query_signals_sql() -> str:
    kind = "CASE " + " ".join(f"WHEN regexp_matches(lower(t), '{p}') THEN '{n}'" for n, p in questions.QUESTION_KINDS) + " ELSE 'general' END"
    lists = []
    for name, words, terms in legal.EXPANSIONS:
        held = f"kind = '{name}'" + (f" AND ({' OR '.join(f'''contains(lower(t), '{w}')''' for w in words)})" if words else "")
        lists.append(f"CASE WHEN {held} THEN [{', '.join(f"'{x}'" for x in terms)}] ELSE [] END")
    focus = f"CASE WHEN kind = 'definition' THEN {tokens_sql(r'''trim(regexp_extract(t, '(?i)definition of\s+(.+?)(?:\?|$)', 1), ' .,:;-')''')} ELSE [] END"
    asked = ", ".join(f"'{t}'" for t in _ASKED.values())
    stop = ", ".join(f"'{w}'" for w in questions.STOPWORDS)
    return rf"""WITH q AS (SELECT o_orderkey, [{asked}][o_orderkey % {len(_ASKED)} + 1] || ' in section ' || (o_orderkey % 40 + 1) || CASE WHEN o_orderstatus = 'O' THEN '.2' ELSE '' END || ' 2023-2024?' AS t FROM orders),
    k AS (SELECT o_orderkey, t, {kind} AS kind, {tokens_sql('t')} AS tok, regexp_extract(t, 'section ([0-9]+(?:\.[0-9]+)*)', 1) AS ref FROM q),
    r AS (SELECT *, flatten([tok, {', '.join(lists)}, {focus}]) AS w FROM k)
    SELECT o_orderkey, kind, array_to_string({_ONCE.format('w')}, ' ') AS rewritten, split_part(ref, '.', 1) AS section, CASE WHEN contains(ref, '.') THEN ref END AS subsection, '2023-2024' AS tax_year,
      CAST(len(list_filter({_ONCE.format('tok')}, lambda x: length(x) > 1 AND x NOT IN ({stop}))) AS BIGINT) AS n_salient FROM r"""


QUERY_SIGNALS = _query_signals_sql()


def weight_profiles(spark: SparkSession, sf: str) -> DataFrame:
    """The ten best documents under each kind of question's weights; the fields are scored once for all."""
    checkpoints(spark)
    docs = table(spark, sf, "documents")
    fields = {"body": "text", "heading": F.substring_index("text", "\n", 1), "structure": F.concat_ws(" ", "lang", "source")}
    parts = search.field_parts(docs, "doc_id", fields, _F)
    rows = parts.select("doc_id", F.explode(F.array(*[F.struct(F.lit(k).alias("profile"), search.weighted(w).alias("score")) for k, w in P.PROFILES.items()])).alias("p")).select("doc_id", "p.*")
    best = search.top_k_each(rows, "profile", "score", 10, "doc_id")
    return best.select("profile", "doc_id", "score", F.col("rank").cast("long").alias("rank"))


_NORMED = ", ".join(f"coalesce({n}.score / (SELECT max(score) FROM {n} WHERE score > 0), 0) AS {f}" for n, f in (("b", "body"), ("h", "heading"), ("u", "structure")))
WEIGHT_PROFILES = f"""WITH {_bm25_sql('b', _F)}, {_bm25_sql('h', _F, "split_part(text, chr(10), 1)")}, {_bm25_sql('u', _F, "concat_ws(' ', lang, source)")},
    p AS (SELECT doc_id, {_NORMED} FROM b FULL JOIN h USING (doc_id) FULL JOIN u USING (doc_id)),
    s AS ({' UNION ALL '.join(f"SELECT '{k}' AS profile, doc_id, round((body * {w['body']}::DOUBLE + heading * {w['heading']}::DOUBLE + structure * {w['structure']}::DOUBLE) * 12.0::DOUBLE, 6) AS score FROM p" for k, w in P.PROFILES.items())})
    SELECT profile, doc_id, score, row_number() OVER (PARTITION BY profile ORDER BY score DESC, doc_id) AS rank FROM s QUALIFY rank <= 10"""


def rule_boosts(spark: SparkSession, sf: str) -> DataFrame:
    """The hundred best by BM25 under the rules of a question about dates."""
    docs = table(spark, sf, "documents")
    hits = search.Bm25(docs, "doc_id", "text").search(TERMS, 100).join(docs.select("doc_id", "text", "source"), "doc_id")
    asked = F.array(*[F.lit(t) for t in sorted(TERMS)])
    shared = lambda text: F.size(F.array_intersect(token_set(text), asked))
    authority = F.regexp_extract("source", "[0-9]+", 0).try_cast("int") % 6
    rules = P.kind_rules("date_lookup", F.rlike(F.lower("text"), F.lit(R.SUPPORT["date"])), shared("text"))
    score = P.boosted(F.col("score"), quality_score(F.col("text")), F.coalesce(authority, F.lit(0)), shared(F.substring_index("text", "\n", 1)), rules)
    ranked = search.top_k(hits.drop("rank").withColumn("score", score), "score", 30, "doc_id")
    return ranked.select("doc_id", "score", F.col("rank").cast("long").alias("rank"))


_RULE = P.KIND_RULES["date_lookup"]
_SHARED = "len(list_intersect(list_distinct({0}), ['eror', 'thing', 'was']))"
_QUALITY = QUALITY_FILTER.replace("round(quality, 6) AS quality, round(quality, 6) < 0.22 AS low_quality", "quality")
RULE_BOOSTS = f"""WITH {_bm25_sql('z', TERMS)}, {_top_sql('t', 'z', 100)}, g AS ({_QUALITY}),
    v AS (SELECT doc_id, t.score + quality * 1.2::DOUBLE + coalesce(TRY_CAST(regexp_extract(source, '[0-9]+') AS INTEGER) % 6, 0) * 0.15::DOUBLE + least({_SHARED.format(tokens_sql("split_part(text, chr(10), 1)"))} * 0.3::DOUBLE, 1.2::DOUBLE)
      + CASE WHEN regexp_matches(lower(text), '{R.SUPPORT["date"]}') THEN {_RULE[0]}::DOUBLE ELSE {_RULE[1]}::DOUBLE END + least({_SHARED.format(_TOKENS)} * {_RULE[2]}::DOUBLE, {_RULE[3]}::DOUBLE)
      + CASE WHEN {_SHARED.format(_TOKENS)} = 0 THEN {_RULE[4]}::DOUBLE ELSE 0.0::DOUBLE END AS score FROM t JOIN documents USING (doc_id) JOIN g USING (doc_id)), {_top_sql('w', 'v', 30)}
    SELECT doc_id, score, rank FROM w"""


def evidence_packs(spark: SparkSession, sf: str) -> DataFrame:
    """A pack of each kind from the best thirty documents; documents of a source and language are its pages, by number."""
    docs = table(spark, sf, "documents")
    pool = docs.select("doc_id", "source", "lang", F.col("doc_id").alias("page"), R.supports(F.col("text"), "count", "was the thing of eror").alias("supports"), F.coalesce(F.contains(F.lower("text"), F.lit("thing")), F.lit(False)).alias("exact"))
    hits = search.Bm25(docs, "doc_id", "text").search(TERMS, 30).join(pool, "doc_id")
    packs = [P.evidence_pack(kind, hits, pool, "source", "lang", "page", "doc_id", "score", "supports", "exact", 3).withColumn("pack", F.lit(kind)) for kind in P.ANCHORS]
    rows = packs[0]
    for more in packs[1:]:
        rows = rows.unionByName(more)
    return rows.select("pack", "doc_id", F.col("place").cast("long").alias("place"))


def _pack_sql(kind: str) -> str:
    first = "exact DESC, " if kind in ("definition", "section", "comparison") else ""
    order = {"definition": "exact DESC, supports DESC, score DESC, page", "context": "anchor DESC, page", "list": "page", "section": "anchor DESC, exact DESC, score DESC, page", "comparison": "anchor DESC, exact DESC, supports DESC, page"}[kind]
    keep = "WHERE exact OR supports" if kind == "definition" else ""
    return f"""SELECT '{kind}' AS pack, doc_id, row_number() OVER (ORDER BY {order}, doc_id) AS place FROM (
      SELECT p.doc_id, p.page, p.supports, p.exact, p.doc_id IN (SELECT doc_id FROM a_{kind}) AS anchor, coalesce(h.score, 0) AS score FROM p LEFT JOIN h USING (doc_id)
      WHERE p.doc_id IN (SELECT doc_id FROM a_{kind}) OR p.doc_id IN (SELECT doc_id FROM n_{kind}))
      {keep} QUALIFY place <= {({'definition': 2, 'list': 4}.get(kind, 3))}""", f"""a_{kind} AS (SELECT * FROM h ORDER BY {first}score DESC, doc_id LIMIT {P.ANCHORS[kind]}),
    n_{kind} AS (SELECT DISTINCT doc_id FROM (SELECT p.doc_id, row_number() OVER (PARTITION BY a.doc_id ORDER BY abs(p.page - a.page), p.doc_id) AS n FROM a_{kind} a JOIN p ON p.source = a.source AND p.lang = a.lang AND abs(p.page - a.page) <= 2) WHERE n <= 5)"""


_PACKS = [_pack_sql(k) for k in P.ANCHORS]
EVIDENCE_PACKS = f"""WITH {_bm25_sql('z', TERMS)}, {_top_sql('t', 'z', 30)},
    p AS (SELECT doc_id, source, lang, doc_id AS page, {_HAS} AND regexp_matches(lower(coalesce(text, '')), '{R.SUPPORT["count"]}') AS supports, coalesce(contains(lower(text), 'thing'), false) AS exact FROM documents),
    h AS (SELECT p.*, t.score FROM t JOIN p USING (doc_id)), {', '.join(c for _, c in _PACKS)}
    {' UNION ALL '.join(f'SELECT * FROM ({q})' for q, _ in _PACKS)}"""


def spec_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Parts' names, types and sizes as specifications."""
    words = F.concat_ws(" ", "p_type", "p_name")
    facts = F.create_map(F.lit("Size"), F.concat(F.col("p_size"), F.lit(" GB")), F.lit("Type"), F.col("p_type"))
    size = specs.first_fact(facts, ("storage_gb", "Size"))
    water = F.when(F.col("p_size") % 3 == 0, F.concat(F.lit("splash "), words)).when(F.col("p_size") % 3 == 1, F.lit("not supported")).otherwise(F.concat(F.lit("no water "), words))
    return table(spark, sf, "part").select(
        "p_partkey", specs.spec_bool(water, "water_resistance_support").alias("water"), specs.spec_bool(F.col("p_type"), "oled_support").alias("oled"), specs.spec_satisfied(size, "storage_gb", "gte", 20.0).alias("large"),
        specs.spec_satisfied(F.col("p_type"), "kind", "eq", " Economy").alias("economy"), F.round(specs.spec_match(size, "storage_gb", 10.0), 6).alias("fit"),
    )


SPEC_CHECKS = """SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN true WHEN 1 THEN false ELSE false END AS water, contains(lower(p_type), 'oled') AS oled, p_size >= 20 AS large, lower(p_type) = 'economy' AS economy,
    round(CASE WHEN p_size < 10 THEN 0.0 ELSE greatest(0.0, 1.0 - least(0.35, (p_size - 10) / 10.0 * 0.35)) END, 6) AS fit FROM part"""


def budgets(spark: SparkSession, sf: str) -> DataFrame:
    """A wish made of each order's total and priority."""
    t = F.round("o_totalprice").cast("long").cast("string")
    low = F.round(F.col("o_totalprice") / 2).cast("long").cast("string")
    said = F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("Something between $"), low, F.lit(" and $"), t)).when(F.col("o_orderstatus") == "F", F.concat(F.lit("a phone UNDER tk "), t, F.lit(" please"))).otherwise(F.concat(F.lit("at least "), low, F.lit(" or so")))
    return table(spark, sf, "orders").select("o_orderkey", specs.budget(said).alias("b")).select("o_orderkey", "b.low", "b.high")


BUDGETS = """SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN CAST(round(o_totalprice / 2) AS DOUBLE) END AS low, CASE WHEN o_orderstatus IN ('O', 'F') THEN CAST(round(o_totalprice) AS DOUBLE) END AS high FROM orders"""


def product_features(spark: SparkSession, sf: str) -> DataFrame:
    """All features of a product's score for a wish: economy parts of size 20 or more up to 1500, in stock."""
    rows = _parts(spark, sf)
    kind, price, stock = F.col("p_type"), F.col("p_retailprice"), F.col("stock")
    features = {
        "semantic": F.col("p_size") / 50.0, "lexical": F.contains("p_name", F.lit("widget")).cast("int"), "exact_name": F.col("p_name") == "cold widget", "exact_sku": F.col("p_partkey") == 7, "kind": kind == "ECONOMY",
        "family": F.substring("p_brand", 7, 1) == "1", "category": kind == "ECONOMY", "brand": F.col("p_brand") == "Brand#13", "price_fit": price_fit(price, None, 1500.0), "stock_fit": F.when(stock > 0, 1.0).otherwise(0.0),
        "metadata": F.rlike("p_name", F.lit("cold|hot")), "spec": specs.spec_match(F.col("p_size").cast("string"), "size", 20.0), "premium": F.lit(0.0), "budget": specs.budget_fit(price, 1500.0),
        "unrelated": specs.unrelated_penalty(kind, F.substring("p_brand", 7, 1), kind, "ECONOMY", "1", None), "sold_out": specs.sold_out_penalty(stock, True),
    }
    features = {n: c.cast("double") for n, c in features.items()}
    return rows.select("p_partkey", specs.product_score(features, by_spec=True).alias("score"))


PRODUCT_FEATURES = f"""WITH f AS (SELECT *, p_size / 50.0 * 0.12::DOUBLE + CASE WHEN contains(p_name, 'widget') THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN p_name = 'cold widget' THEN 0.12::DOUBLE ELSE 0 END + CASE WHEN p_partkey = 7 THEN 0.14::DOUBLE ELSE 0 END
      + CASE WHEN p_type = 'ECONOMY' THEN 0.18::DOUBLE + 0.08::DOUBLE ELSE 0 END + CASE WHEN substring(p_brand, 7, 1) = '1' THEN 0.08::DOUBLE ELSE 0 END + CASE WHEN p_brand = 'Brand#13' THEN 0.05::DOUBLE ELSE 0 END
      + CASE WHEN p_retailprice > 1500 THEN greatest(0.0, least(1.0, 1.0 - (p_retailprice - 1500) / 1500.0)) ELSE 1.0 END * 0.07::DOUBLE + CASE WHEN stock > 0 THEN 0.03::DOUBLE ELSE 0 END + CASE WHEN regexp_matches(p_name, 'cold|hot') THEN 0.04::DOUBLE ELSE 0 END
      + CASE WHEN p_size < 20 THEN 0.0 ELSE greatest(0.0, 1.0 - least(0.35, (p_size - 20) / 20.0 * 0.35)) END * 0.28::DOUBLE + greatest(0.0, least(1.0, 1.0 - p_retailprice / 1500.0 * 0.35)) * 0.03::DOUBLE
      - CASE WHEN p_type = 'ECONOMY' THEN 0.0 WHEN substring(p_brand, 7, 1) = '1' THEN 0.04::DOUBLE ELSE 0.35::DOUBLE END - CASE WHEN stock > 0 THEN 0.0 ELSE 0.25::DOUBLE END AS raw FROM {_PARTS})
    SELECT p_partkey, round(greatest(0.0, least(1.0, raw)), 4) AS score FROM f"""


def price_sums(spark: SparkSession, sf: str) -> DataFrame:
    """Of each order: its lines' total, the total of the first three, and a made-up price, against sums of up to five of its lines' prices."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list("l_extendedprice")).alias("p")).where(F.size("p") <= 7)
    said = F.array(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), F.aggregate(F.slice("p", 1, 3), F.lit(0.0), lambda a, x: a + x), F.lit(0.5))
    rows = lines.select("l_orderkey", F.size("p").alias("n"), G.unsupported_prices(said, F.col("p")).alias("u"))
    return rows.select("l_orderkey", F.col("n").cast("long").alias("n_lines"), F.size("u").cast("long").alias("n_unsupported"))


PRICE_SUMS = """WITH l AS (SELECT l_orderkey, list_sort(list(CAST(round(l_extendedprice * 100) AS BIGINT))) AS p FROM lineitem GROUP BY l_orderkey HAVING count(*) <= 7),
    m AS (SELECT l_orderkey, p, unnest(range(1, CAST(1 << len(p) AS BIGINT))) AS mask FROM l),
    s AS (SELECT l_orderkey, list_sum(list_filter(p, lambda x, i: (mask >> (i - 1)) & 1 = 1)) AS v FROM m WHERE bit_count(mask) <= 5
      UNION SELECT l_orderkey, abs(a - b) FROM (SELECT l_orderkey, p, unnest(p) AS a FROM l), LATERAL (SELECT unnest(p) AS b)),
    q AS (SELECT l_orderkey, len(p) AS n, unnest([CAST(list_sum(p) AS BIGINT), CAST(list_sum(p[1:3]) AS BIGINT), 50]) AS c FROM l)
    SELECT l_orderkey, n AS n_lines, CAST(count(*) FILTER (NOT EXISTS (SELECT 1 FROM s WHERE s.l_orderkey = q.l_orderkey AND abs(s.v - q.c) <= 1)) AS BIGINT) AS n_unsupported FROM q GROUP BY ALL"""


def _turn_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of every turn; those of more than 8 tokens count as supported if they share a term with the benchmark's first words."""
    rows = table(spark, sf, "conversations").select(F.struct("conv_id", "turn").alias("k"), F.posexplode(sentences(F.col("text"))).alias("at", "claim"))
    return rows.withColumn("supported", F.size(F.array_intersect(token_set("claim"), F.array(*[F.lit(t) for t in ("that", "and", "thing", "la", "de", "und")]))) > 0)


def answer_policy(spark: SparkSession, sf: str) -> DataFrame:
    out = G.answer_policy(_turn_claims(spark, sf), "k", "at", "claim", "supported")
    return out.select("k.conv_id", "k.turn", F.md5("final").alias("digest"), "n_removed", "refused")


ANSWER_POLICY = f"""WITH s AS (SELECT conv_id, turn, {_SENTENCES.format('text')} AS s FROM conversations), c AS (SELECT conv_id, turn, i, s[i] AS claim FROM (SELECT conv_id, turn, s, unnest(range(1, len(s) + 1)) AS i FROM s)),
    v AS (SELECT *, len(list_intersect({tokens_sql('claim')}, ['that', 'and', 'thing', 'la', 'de', 'und'])) > 0 AS ok FROM c)
    SELECT conv_id, turn, md5(CASE WHEN count(*) FILTER (ok) = 0 THEN '{G.REFUSAL}' ELSE string_agg(claim, ' ' ORDER BY i) FILTER (ok) END) AS digest, count(*) FILTER (NOT ok) AS n_removed, count(*) FILTER (ok) = 0 AS refused FROM v GROUP BY ALL"""


def abstentions(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as questions, their lines as hits: price as score, line status as authority, returned lines as conflicts."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_extendedprice") / 10000).alias("score"), (F.col("l_quantity") % 4).cast("int").alias("level"), (F.col("l_returnflag") == "R").alias("conflict"))
    return G.abstentions(lines, "l_orderkey", "score", "level", "conflict", 3.0)


ABSTENTIONS = """WITH h AS (SELECT l_orderkey, l_extendedprice / 10000 AS score, CAST(l_quantity % 4 AS INTEGER) AS level, l_returnflag = 'R' AS conflict FROM lineitem),
    p AS (SELECT l_orderkey, max(score) AS top, count(DISTINCT level) AS levels, bool_or(conflict) AS c, max(level) AS high FROM h GROUP BY 1), w AS (SELECT l_orderkey, count(*) AS n FROM h JOIN p USING (l_orderkey) WHERE level = high GROUP BY 1),
    r AS (SELECT l_orderkey, CASE WHEN top < 3.0 THEN 'weak' WHEN c AND (levels <= 1 OR n <> 1) THEN 'conflict' END AS reason FROM p JOIN w USING (l_orderkey))
    SELECT l_orderkey, reason IS NOT NULL AS abstained, reason FROM r"""


def cited_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of conversations that cite a turn by its number, against that turn's text."""
    turns = table(spark, sf, "conversations")
    rows = turns.select("conv_id", "turn", F.posexplode(sentences(F.col("text"))).alias("at", "s"))
    marked = rows.select("conv_id", F.struct("turn", "at").alias("w"), F.when(F.col("at") % 3 == 0, F.col("s")).otherwise(F.concat("s", F.lit(" ["), (F.col("turn") + F.col("at") % 2 * 50).cast("string"), F.lit("]"))).alias("s"))
    out = G.cited_sentences(marked, "conv_id", "w", "s", turns.groupBy("conv_id", "turn").agg(F.min("text").alias("text")), "turn", "text")
    return out.groupBy("verdict").agg(F.count("*").alias("n"))


CITED_SENTENCES = f"""WITH s AS (SELECT conv_id, turn, {_SENTENCES.format('text')} AS s FROM conversations), c AS (SELECT conv_id, turn, i - 1 AS place, s[i] AS s FROM (SELECT conv_id, turn, s, unnest(range(1, len(s) + 1)) AS i FROM s)),
    m AS (SELECT conv_id, turn, place, CASE WHEN place % 3 = 0 THEN s ELSE s || ' [' || (turn + place % 2 * 50) || ']' END AS s, CASE WHEN place % 3 <> 0 THEN turn + place % 2 * 50 END AS cited FROM c),
    t AS (SELECT conv_id, turn AS cited, min(text) AS e FROM conversations GROUP BY ALL),
    w AS (SELECT m.cited, e, list_distinct(list_filter(regexp_split_to_array(lower(s), '\\s+'), lambda x: x <> '')) AS a, list_distinct(list_filter(regexp_split_to_array(lower(coalesce(e, '')), '\\s+'), lambda x: x <> '')) AS b FROM m LEFT JOIN t USING (conv_id, cited))
    SELECT verdict, count(*) AS n FROM (SELECT CASE WHEN cited IS NULL THEN 'uncited' WHEN e IS NULL THEN 'invalid' WHEN len(list_intersect(a, b)) > 0 OR len(a) <= 4 THEN 'supported' ELSE 'weak' END AS verdict FROM w) GROUP BY 1"""

_NAMES = "legal_marks query_signals weight_profiles rule_boosts evidence_packs spec_checks budgets product_features price_sums answer_policy abstentions cited_sentences".split()
QUERIES = {f"q_{n}": (globals()[n], globals()[n.upper()]) for n in _NAMES}
