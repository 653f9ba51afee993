"""Registered queries of orders, boosts, selections and page features, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import pages
from ..operators import ranking as R
from ..operators import search
from ..sources.tables import table
from .commerce import _PARTS, _parts
from .retrieval import TERMS, _bm25_sql, _top_sql
from .sqltext import tokens_sql

_TOK = tokens_sql()


def support_kinds(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", *[R.supports(F.col("text"), k, "was the thing of eror").alias(k) for k in R.SUPPORT])
    return docs.where(" OR ".join(R.SUPPORT))


_HAS = f"len(list_intersect({_TOK}, ['was', 'thing', 'eror'])) > 0"
SUPPORT_KINDS = f"SELECT * FROM (SELECT doc_id, {', '.join(f'''{_HAS} AND regexp_matches(lower(coalesce(text, '')), '{p}') AS {k}''' for k, p in R.SUPPORT.items())} FROM documents) WHERE {' OR '.join(R.SUPPORT)}"


def boosted_search(spark: SparkSession, sf: str) -> DataFrame:
    """The best hundred by BM25, boosted by the language of a date question and by overlap, then reordered."""
    docs = table(spark, sf, "documents")
    hits = search.Bm25(docs, "doc_id", "text").search(TERMS, 100).join(docs.select("doc_id", "text"), "doc_id")
    boosted = hits.withColumn("score", F.col("score") + R.kind_boost(F.col("text"), "date") + R.overlap_boost(F.col("text"), [*TERMS, "heon", "of"]))
    return search.top_k(boosted.drop("rank"), "score", 20, "doc_id").select("doc_id", "score", F.col("rank").cast("long").alias("rank"))


BOOSTED_SEARCH = f"""WITH {_bm25_sql('s', TERMS)}, {_top_sql('t', 's', 100)},
    b AS (SELECT doc_id, t.score + CASE WHEN regexp_matches(' ' || lower(text) || ' ', '{R.KIND_BOOSTS["date"][0]}') THEN 1.2::DOUBLE ELSE 0.0::DOUBLE END
      + least(len(list_intersect(list_distinct({_TOK}), ['eror', 'heon', 'of', 'thing', 'was'])) * 0.18::DOUBLE, 1.5::DOUBLE) AS score FROM t JOIN documents USING (doc_id)), {_top_sql('u', 'b', 20)}
    SELECT doc_id, score, rank FROM u"""


def support_order(spark: SparkSession, sf: str) -> DataFrame:
    """Parts in the order that "what is running low" asks for."""
    quality = R.completeness(F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.lit(None).cast("string"), F.col("p_retailprice"), F.col("stock"))
    rows = _parts(spark, sf).withColumn("quality", quality.cast("long")).withColumn("score", F.col("p_size") / 50.0)
    order = R.support_order("which are running low?", "stock", "p_retailprice", "quality", "score", "p_name")
    return rows.orderBy(*order, "p_partkey").limit(40).select("p_partkey", "stock", "quality")


SUPPORT_ORDER = f"""WITH q AS (SELECT *, CAST(CASE WHEN length(trim(p_name)) >= 4 THEN 2 ELSE 0 END + CASE WHEN length(trim(p_type)) >= 3 THEN 1 ELSE 0 END + CASE WHEN length(trim(p_brand)) >= 3 THEN 1 ELSE 0 END + 2
      - CASE WHEN length(trim(p_type)) BETWEEN 1 AND 2 THEN 1 ELSE 0 END - CASE WHEN length(trim(p_brand)) BETWEEN 1 AND 2 THEN 1 ELSE 0 END AS BIGINT) AS quality FROM {_PARTS})
    SELECT p_partkey, stock, quality FROM q ORDER BY stock NULLS LAST, quality DESC, p_size DESC, lower(p_name), p_partkey LIMIT 40"""


def step_up(spark: SparkSession, sf: str) -> DataFrame:
    return R.step_up(table(spark, sf, "part"), "p_type", "p_retailprice", "p_partkey")


STEP_UP = """WITH d AS (SELECT p_type, p_retailprice, min(p_partkey) AS k FROM part GROUP BY ALL), s AS (SELECT p_type, p_retailprice, lead(k) OVER (PARTITION BY p_type ORDER BY p_retailprice) AS upsell FROM d)
    SELECT p_partkey, upsell FROM part JOIN s USING (p_type, p_retailprice)"""


def bundle_budget(spark: SparkSession, sf: str) -> DataFrame:
    """An item of each of three brands for 3000 in all, the largest sizes that the money allows."""
    rows = _parts(spark, sf).where("stock > 0").withColumn("score", F.col("p_size") / 50.0)
    return R.bundle(rows, ["Brand#1", "Brand#2", "Brand#3"], "p_brand", "p_retailprice", "score", "p_partkey", 3000.0).select("p_partkey", "p_brand", "p_retailprice")


BUNDLE_BUDGET = f"""WITH c AS (SELECT *, p_size / 50.0 AS score FROM {_PARTS} WHERE stock > 0), f AS (SELECT min(p_retailprice) FILTER (p_brand = 'Brand#2') AS f2, min(p_retailprice) FILTER (p_brand = 'Brand#3') AS f3 FROM c),
    a AS (SELECT p_partkey, p_brand, p_retailprice FROM c, f WHERE p_brand = 'Brand#1' ORDER BY p_retailprice > 3000 - f2 - f3, score DESC, p_retailprice, p_partkey LIMIT 1),
    b AS (SELECT p_partkey, p_brand, p_retailprice FROM c, f WHERE p_brand = 'Brand#2' ORDER BY p_retailprice > 3000 - (SELECT p_retailprice FROM a) - f3, score DESC, p_retailprice, p_partkey LIMIT 1),
    d AS (SELECT p_partkey, p_brand, p_retailprice FROM c, f WHERE p_brand = 'Brand#3' ORDER BY p_retailprice > 3000 - (SELECT p_retailprice FROM a) - (SELECT p_retailprice FROM b), score DESC, p_retailprice, p_partkey LIMIT 1)
    SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM d"""


def section_groups(spark: SparkSession, sf: str) -> DataFrame:
    """The best hundred hits grouped by source, in the order in which sources appear."""
    docs = table(spark, sf, "documents")
    hits = search.Bm25(docs, "doc_id", "text").search(TERMS, 100).join(docs.select("doc_id", "source"), "doc_id")
    groups = R.groups_in_order(hits, "source", "rank", "doc_id", 5)
    return groups.select("source", F.col("first_rank").cast("long").alias("first_rank"), F.array_join(F.transform("members", lambda m: m.cast("string")), ",").alias("members"))


SECTION_GROUPS = f"""WITH {_bm25_sql('s', TERMS)}, {_top_sql('t', 's', 100)}
    SELECT source, min(rank) AS first_rank, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS members FROM t JOIN documents USING (doc_id) GROUP BY source ORDER BY first_rank LIMIT 5"""


def logical_unit(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines near each order's largest one: lines as pages, orders as documents, flags as headings."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_returnflag", "l_linenumber", "l_quantity", "l_extendedprice").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_returnflag").alias("flag"), F.max("l_extendedprice").alias("price"))
    lines = lines.withColumn("key", F.col("l_orderkey") * 100 + F.col("l_linenumber"))
    anchors = lines.groupBy("l_orderkey").agg(F.max_by(F.struct("flag", "l_linenumber", "key"), F.struct("price", "key")).alias("a")).select("l_orderkey", "a.*")
    return R.logical_unit(anchors, lines, "l_orderkey", "flag", "l_linenumber", "key").select("anchor", "member", F.col("distance").cast("long").alias("distance"))


LOGICAL_UNIT = """WITH l AS (SELECT l_orderkey, l_linenumber, max(l_returnflag) AS flag, max(l_extendedprice) AS price, l_orderkey * 100 + l_linenumber AS key FROM lineitem GROUP BY l_orderkey, l_linenumber),
    a AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY price DESC, key DESC) = 1)
    SELECT a.key AS anchor, b.key AS member, CAST(abs(a.l_linenumber - b.l_linenumber) AS BIGINT) AS distance FROM a JOIN l b ON a.l_orderkey = b.l_orderkey AND a.flag = b.flag AND abs(a.l_linenumber - b.l_linenumber) <= 2
    QUALIFY row_number() OVER (PARTITION BY a.key ORDER BY abs(a.l_linenumber - b.l_linenumber), b.key) <= 5"""


def page_features(spark: SparkSession, sf: str) -> DataFrame:
    rows = pages.page_features(table(spark, sf, "documents").select("doc_id", "text"), "text")
    return rows.select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.size("headings").cast("long").alias("n_headings"), F.size("years").cast("long").alias("n_years"), "is_appendix", "is_table_like")


_LINES = "list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '')"
PAGE_FEATURES = rf"""WITH l AS (SELECT doc_id, text, {_LINES} AS l FROM documents), h AS (SELECT *, list_distinct(list_filter(l[1:40], lambda x: regexp_matches(lower(x), '{pages.HEADING}'))) AS h FROM l)
    SELECT doc_id, len(l) AS n_lines, len(h) AS n_headings, len(list_distinct(regexp_extract_all(text, '{pages.YEARS}'))) AS n_years, len(list_filter(list_concat(h, l[1:15]), lambda x: regexp_matches(lower(x), '{pages.APPENDIX}'))) > 0 AS is_appendix,
    len(l) >= 3 AND (len(list_filter(l, lambda x: regexp_matches(x, '\S\s{{3,}}\S'))) >= greatest(2, len(l) // 3)
      OR len(list_filter(l, lambda x: length(regexp_replace(x, '[^0-9]', '', 'g')) >= 3 AND len(regexp_split_to_array(x, '\s+')) >= 3)) >= greatest(2, len(l) // 2)) AS is_table_like FROM h"""


def best_extraction(spark: SparkSession, sf: str) -> DataFrame:
    """Each page by two extractors, raw and stripped of markup; the better-scored stays."""
    from ..functions.text import strip_markup

    raw = table(spark, sf, "pages").select("page_id", F.col("html").alias("text"), F.lit("raw").alias("extractor"))
    both = raw.unionByName(raw.select("page_id", strip_markup(F.col("text")).alias("text"), F.lit("stripped").alias("extractor")))
    return pages.best_extraction(both, ["page_id"], "text", "extractor").select("page_id", "extractor", F.length("text").cast("long").alias("n_chars"))


_SPACE = r"regexp_replace(regexp_replace(regexp_replace({0}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"
BEST_EXTRACTION = rf"""WITH r AS (SELECT page_id, coalesce(html, '') AS text, 'raw' AS extractor FROM pages), b AS (SELECT * FROM r UNION ALL SELECT page_id,
      trim(regexp_replace(regexp_replace(regexp_replace(text, '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')), 'stripped' FROM r),
    n AS (SELECT *, {_SPACE.format('text')} AS t FROM b),
    s AS (SELECT page_id, text, extractor, length(t) * 0.01::DOUBLE + len(regexp_extract_all(t, '[A-Za-z]{{2,}}')) * 0.01::DOUBLE + len(regexp_extract_all(t, '(?:^|\n)[0-9]+(?:\.[0-9]+)*')) * 0.75::DOUBLE + len(regexp_extract_all(t, '## ')) * 1.2::DOUBLE
      - len(list_filter(string_split(t, chr(10)), lambda x: length(trim(x)) = 1)) * 0.35::DOUBLE - len(regexp_extract_all(t, '\|')) * 0.05::DOUBLE AS score FROM n)
    SELECT page_id, extractor, length(text) AS n_chars FROM s QUALIFY row_number() OVER (PARTITION BY page_id ORDER BY score DESC, extractor) = 1"""


_NAMES = "support_kinds boosted_search support_order step_up bundle_budget section_groups logical_unit page_features best_extraction".split()
QUERIES = {f"q_{n}": (globals()[n], globals()[n.upper()]) for n in _NAMES}
