"""Registered queries of search, text and document operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scores import AUTHORITY, authority_value
from ..functions.text import LOW_QUALITY, quality_score, section_references, sentences, strip_markup
from ..operators import documents as D
from ..operators import filters, lineage, search
from ..sources.tables import table
from .sqltext import tokens_sql

TERMS = ["was", "thing", "eror"]
STEPS = (["was", "thing"], ["eror", "heon"], ["que", "das"])

_TOKENS = tokens_sql()


def _bm25_sql(name: str, terms: list[str], text: str = "text") -> str:
    """CTEs that end in ``name``(doc_id, score)."""
    listed = ", ".join(f"'{t}'" for t in terms)
    return f"""
    {name}_tok AS (SELECT doc_id, {tokens_sql(text)} AS toks FROM documents),
    {name}_vocab AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(toks)) AS term FROM {name}_tok) GROUP BY term),
    {name}_raw AS (SELECT term, ln(n - df + 0.5) - ln(df + 0.5) AS i FROM {name}_vocab, (SELECT count(*) AS n FROM {name}_tok)),
    {name}_idf AS (SELECT term, CASE WHEN i < 0 THEN 0.25 * (SELECT avg(i) FROM {name}_raw) ELSE i END AS idf FROM {name}_raw WHERE term IN ({listed})),
    {name}_tf AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(toks) AS dl, unnest(toks) AS term FROM {name}_tok) WHERE term IN ({listed}) GROUP BY ALL),
    {name} AS (SELECT doc_id, sum(idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(len(toks)) FROM {name}_tok)))) AS score
      FROM {name}_tf JOIN {name}_idf USING (term) GROUP BY doc_id)"""


def _top_sql(name: str, source: str, k: int) -> str:
    return f"{name} AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (SELECT doc_id, round(score, 6) AS score FROM {source} WHERE score > 0) QUALIFY rank <= {k})"


def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    hits = search.Bm25(table(spark, sf, "documents"), "doc_id", "text").search(TERMS, 10)
    return hits.select("doc_id", "score", F.col("rank").cast("long").alias("rank"))


BM25_TOPK = f"WITH {_bm25_sql('s', TERMS)}, {_top_sql('t', 's', 10)} SELECT doc_id, score, rank FROM t"


def bm25_field_weighted(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.shared import checkpoints

    checkpoints(spark)
    docs = table(spark, sf, "documents")
    fields = {"body": "text", "heading": F.substring_index("text", "\n", 1), "structure": F.concat_ws(" ", "lang", "source")}
    scored = search.field_search(docs, "doc_id", fields, [*TERMS, "en", "src1"])
    kept = filters.apply(scored.join(docs.select("doc_id", "lang"), "doc_id"), {"lang": "en"})
    return search.top_k(kept, "score", 20, "doc_id").select("doc_id", "score", F.col("rank").cast("long").alias("rank"))


_F = [*TERMS, "en", "src1"]
BM25_FIELD_WEIGHTED = f"""WITH {_bm25_sql('b', _F)}, {_bm25_sql('h', _F, "split_part(text, chr(10), 1)")}, {_bm25_sql('u', _F, "concat_ws(' ', lang, source)")},
    f AS (SELECT doc_id, score / (SELECT max(score) FROM b WHERE score > 0) * 0.5 AS p FROM b WHERE score > 0
      UNION ALL SELECT doc_id, score / (SELECT max(score) FROM h WHERE score > 0) * 0.22 FROM h WHERE score > 0
      UNION ALL SELECT doc_id, score / (SELECT max(score) FROM u WHERE score > 0) * 0.28 FROM u WHERE score > 0),
    w AS (SELECT doc_id, sum(p) * 12.0 AS score FROM f JOIN documents USING (doc_id) WHERE lang = 'en' GROUP BY doc_id), {_top_sql('t', 'w', 20)}
    SELECT doc_id, score, rank FROM t"""


def metadata_filter(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return filters.apply(docs, {"lang": ["en", "de"], "n_chars": {"$gte": 500, "$lte": 3000}}).select("doc_id", "lang", "source", "n_chars")


METADATA_FILTER = "SELECT doc_id, lang, source, n_chars FROM documents WHERE lang IN ('en', 'de') AND n_chars BETWEEN 500 AND 3000"


def authority_min(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    level = F.element_at(F.array(*[F.lit(a) for a in AUTHORITY]), (F.pmod(F.regexp_extract("source", "[0-9]+", 0).cast("int"), F.lit(6)) + 1).cast("int"))
    return docs.select("doc_id", "source", authority_value(level).cast("long").alias("authority")).where("authority >= 3")


AUTHORITY_MIN = "SELECT doc_id, source, authority FROM (SELECT doc_id, source, CAST(regexp_extract(source, '[0-9]+') AS BIGINT) % 6 AS authority FROM documents) WHERE authority >= 3"


def quality_filter(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", F.round(quality_score(F.col("text")), 6).alias("quality"))
    return docs.withColumn("low_quality", F.col("quality") < LOW_QUALITY)


QUALITY_FILTER = r"""WITH s AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '^\s+|\s+$', '', 'g') AS t FROM documents),
    c AS (SELECT doc_id, t, length(t) AS n, length(regexp_replace(t, '[^A-Za-z]', '', 'g')) AS latin, length(regexp_replace(t, '\P{Nd}', '', 'g')) AS digits,
      length(regexp_replace(t, '\P{L}', '', 'g')) AS letters, len(regexp_extract_all(t, '[\p{L}\p{N}_\x{0980}-\x{09FF}]+')) AS words, length(regexp_replace(t, '[^\x{0980}-\x{09FF}]', '', 'g')) AS bengali,
      list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS lines FROM s),
    q AS (SELECT doc_id, CASE WHEN n = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, least(n / 180.0, 1.0) * 0.25 + least(letters / n / 0.45, 1.0) * 0.35 + least(words / 28.0, 1.0) * 0.2
      + CASE WHEN greatest(latin, bengali) >= 18 THEN 1.0 ELSE least((latin + bengali) / 18.0, 1.0) END * 0.25 - least(digits / n, 1.0) * 0.2 - len(list_filter(lines, lambda x: regexp_full_match(x, '[0-9 .:/()%|-]+'))) / greatest(len(lines), 1) * 0.35
      - CASE WHEN regexp_full_match(t, '[0-9 .:/()%-]+') THEN 0.7 ELSE 0.0 END)) END AS quality FROM c)
    SELECT doc_id, round(quality, 6) AS quality, round(quality, 6) < 0.22 AS low_quality FROM q"""


def tokenize_stats(spark: SparkSession, sf: str) -> DataFrame:
    return D.token_statistics(table(spark, sf, "documents"), "lang", "text")


TOKENIZE_STATS = f"""SELECT lang, count(*) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_tokens, round(avg(len(t)), 4) AS avg_tokens, round(avg(len(list_distinct(t))), 4) AS avg_distinct
    FROM (SELECT lang, {_TOKENS} AS t FROM documents) GROUP BY lang"""


def jaccard_near_dup(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.shared import checkpoints

    checkpoints(spark)
    found = D.overlapping(table(spark, sf, "documents"), "doc_id", "source", "text")
    return found.select("source", F.col("a").alias("doc_a"), F.col("b").alias("doc_b"), F.round("overlap", 6).alias("overlap"))


JACCARD_NEAR_DUP = f"""WITH s AS (SELECT source, min(doc_id) AS doc_id, t FROM (SELECT source, doc_id, list_sort(list_distinct({_TOKENS})) AS t FROM documents) WHERE len(t) > 0 GROUP BY source, t),
    p AS (SELECT a.source, a.doc_id AS doc_a, b.doc_id AS doc_b, len(list_intersect(a.t, b.t)) AS c, len(a.t) + len(b.t) AS n
      FROM s a JOIN s b ON a.source = b.source AND a.doc_id < b.doc_id AND least(len(a.t), len(b.t)) >= greatest(len(a.t), len(b.t)) * 0.82)
    SELECT source, doc_a, doc_b, round(c / (n - c), 6) AS overlap FROM p WHERE c / (n - c) >= 0.82"""


def _query_vector(vectors: DataFrame) -> DataFrame:
    return vectors.where("vec_id = 0").select(F.col("embedding").alias("_query")).limit(1)


def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    hits = search.top_k(search.similar(vectors, _query_vector(vectors)), "score", 10, "vec_id")
    return hits.select("vec_id", "label", "score", F.col("rank").cast("long").alias("rank"))


_DOT = "list_dot_product(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[]))"
_NORM = "sqrt(list_dot_product(CAST({0}.embedding AS DOUBLE[]), CAST({0}.embedding AS DOUBLE[])))"
DENSE_TOPK = f"""SELECT vec_id, label, score, row_number() OVER (ORDER BY score DESC, vec_id) AS rank
    FROM (SELECT e.vec_id, e.label, round({_DOT}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) QUALIFY rank <= 10"""


def cosine_minscore(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    scored = search.similar(vectors, _query_vector(vectors), cosine=True)
    return scored.where("score >= 0.2 AND vec_id <> 0").select("vec_id", F.round("score", 6).alias("score"))


COSINE_MINSCORE = f"""SELECT vec_id, round(score, 6) AS score FROM (SELECT e.vec_id, {_DOT} / ({_NORM.format('e')} * {_NORM.format('q')}) AS score
    FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE score >= 0.2 AND vec_id <> 0"""


def channel_argmax(spark: SparkSession, sf: str) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    scored = search.similar(vectors, _query_vector(vectors)).where("vec_id <> 0").withColumn("score", F.round("score", 6))
    best = scored.groupBy("label").agg(F.min_by(F.struct("vec_id", "score"), F.struct((-F.col("score")).alias("s"), "vec_id")).alias("b"), F.count_if(F.col("score") >= 0.5).alias("n_strong"))
    return best.select("label", F.col("b.vec_id").alias("vec_id"), F.col("b.score").alias("score"), "n_strong")


CHANNEL_ARGMAX = f"""WITH s AS (SELECT e.label, e.vec_id, round({_DOT}, 6) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.vec_id <> 0)
    SELECT label, vec_id, score, n_strong FROM (SELECT label, vec_id, score, CAST(count(*) FILTER (score >= 0.5) OVER (PARTITION BY label) AS BIGINT) AS n_strong,
      row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn FROM s) WHERE rn = 1"""


def _overlap_ranking(docs: DataFrame, terms: list[str], k: int) -> DataFrame:
    return search.top_k(search.term_overlap(docs, "text", terms).where("overlap > 0").select("doc_id", F.col("overlap").alias("score")), "score", k, "doc_id")


def rrf(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    fused = search.fuse([search.Bm25(docs, "doc_id", "text").search(TERMS, 50), _overlap_ranking(docs, TERMS, 50)], "doc_id")
    return fused.select("doc_id", F.round("score", 6).alias("score"), "n_lists")


def _overlap_sql(name: str, terms: list[str]) -> str:
    listed = ", ".join(f"'{t}'" for t in sorted(set(terms)))
    return f"{name} AS (SELECT doc_id, len(list_intersect(list_distinct({_TOKENS}), [{listed}])) / {len(set(terms))} AS score FROM documents)"


RRF = f"""WITH {_bm25_sql('s', TERMS)}, {_top_sql('t', 's', 50)}, {_overlap_sql('o', TERMS)}, {_top_sql('p', 'o', 50)}
    SELECT doc_id, round(sum(1.0 / (60 + rank)), 6) AS score, count(*) AS n_lists FROM (SELECT doc_id, rank FROM t UNION ALL SELECT doc_id, rank FROM p) GROUP BY doc_id"""


def multi_rrf(spark: SparkSession, sf: str) -> DataFrame:
    """Three steps of a question, each by BM25 and by overlap: six lists from one pass over the documents."""
    index = search.Bm25(table(spark, sf, "documents"), "doc_id", "text").narrow([t for terms in STEPS for t in terms])
    lists = {f"{kind}{i}": score for i, terms in enumerate(STEPS) for kind, score in (("bm25", index.score(terms)), ("overlap", index.overlap(terms)))}
    return search.top_k(search.fuse([index.rankings(lists, 20)], "doc_id"), "score", 20, "doc_id").select("doc_id", "score", "n_lists", F.col("rank").cast("long").alias("rank"))


_STEPS = ", ".join(f"{_bm25_sql(f's{i}', t)}, {_top_sql(f't{i}', f's{i}', 20)}, {_overlap_sql(f'o{i}', t)}, {_top_sql(f'p{i}', f'o{i}', 20)}" for i, t in enumerate(STEPS))
_UNION = " UNION ALL ".join(f"SELECT doc_id, rank FROM {n}{i}" for i in range(len(STEPS)) for n in ("t", "p"))
MULTI_RRF = f"""WITH {_STEPS}, f AS (SELECT doc_id, round(sum(1.0 / (60 + rank)), 6) AS score, count(*) AS n_lists FROM ({_UNION}) GROUP BY doc_id)
    SELECT doc_id, score, n_lists, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM f QUALIFY rank <= 20"""


def rerank(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    hits = search.Bm25(docs, "doc_id", "text").search(TERMS, 30).join(docs.select("doc_id", "text"), "doc_id")
    return search.rerank(hits, "text", ["heon", "ofonha", "thing"], 15, "doc_id").select("doc_id", F.round("overlap", 6).alias("overlap"), F.col("rank").cast("long").alias("rank"))


RERANK = f"""WITH {_bm25_sql('s', TERMS)}, {_top_sql('t', 's', 30)}, {_overlap_sql('o', ["heon", "ofonha", "thing"])}
    SELECT doc_id, round(o.score, 6) AS overlap, row_number() OVER (ORDER BY CASE WHEN t.rank <= 15 THEN o.score END DESC NULLS LAST, t.rank, doc_id) AS rank FROM t JOIN o USING (doc_id)"""


def conflicts(spark: SparkSession, sf: str) -> DataFrame:
    """Documents under one heading (the first 40 code points) whose language or source differ, by heading."""
    docs = table(spark, sf, "documents").where(F.length("text") > 0)
    per = docs.groupBy(F.substring("text", 1, 40).alias("heading")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n_docs"), F.count_distinct("lang").alias("n_langs"), F.count_distinct("source").alias("n_sources"))
    return per.where("n_langs > 1 OR n_sources > 1").select("first_doc", "n_docs", "n_langs", "n_sources")


CONFLICTS = """SELECT min(doc_id) AS first_doc, count(*) AS n_docs, count(DISTINCT lang) AS n_langs, count(DISTINCT source) AS n_sources FROM documents WHERE length(text) > 0
    GROUP BY substring(text, 1, 40) HAVING count(DISTINCT lang) > 1 OR count(DISTINCT source) > 1"""


def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    chunks = D.fixed_windows(table(spark, sf, "documents"), "doc_id", "text")
    return chunks.select("doc_id", F.col("piece").cast("long").alias("piece"), F.length("chunk").cast("long").alias("n_chars"), F.md5("chunk").alias("digest"))


CHUNK_FIXED = """SELECT doc_id, piece, length(chunk) AS n_chars, md5(chunk) AS digest FROM (SELECT doc_id, piece, trim(substring(text, piece * 880 + 1, 1000)) AS chunk
    FROM (SELECT doc_id, text, unnest(range(0, 1 + CAST(greatest(ceil((length(text) - 1000) / 880), 0) AS BIGINT))) AS piece FROM documents WHERE length(text) > 0)) WHERE chunk <> ''"""


def chunk_tokens(spark: SparkSession, sf: str) -> DataFrame:
    chunks = D.token_windows(table(spark, sf, "documents"), "doc_id", "text", 256)
    return chunks.select("doc_id", F.col("piece").cast("long").alias("piece"), F.md5("chunk").alias("digest"))


CHUNK_TOKENS = r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS w FROM documents),
    p AS (SELECT doc_id, w, unnest(range(0, (len(w) + 255) // 256)) AS piece FROM w)
    SELECT doc_id, piece, md5(array_to_string(w[piece * 256 + 1 : piece * 256 + 256], ' ')) AS digest FROM p"""


def sentence_split(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations").select("conv_id", "turn", sentences(F.col("text")).alias("s"))
    return turns.select("conv_id", "turn", F.posexplode("s").alias("at", "sentence")).select("conv_id", "turn", F.col("at").cast("long").alias("at"), "sentence")


SENTENCE_SPLIT = r"""WITH s AS (SELECT conv_id, turn, list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), '([.!?\x{0964}])\s+', '\1' || chr(10), 'g'), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS s FROM conversations)
    SELECT conv_id, turn, CAST(i - 1 AS BIGINT) AS at, s[i] AS sentence FROM (SELECT conv_id, turn, s, unnest(range(1, len(s) + 1)) AS i FROM s)"""


def claim_support(spark: SparkSession, sf: str) -> DataFrame:
    return D.claim_support(table(spark, sf, "benchmark"), "item_id", "text", table(spark, sf, "documents"), "doc_id", "text")


CLAIM_SUPPORT = f"""WITH c AS (SELECT item_id, list_distinct({_TOKENS}) AS t FROM benchmark), d AS (SELECT doc_id, list_distinct({_TOKENS}) AS t FROM documents),
    s AS (SELECT item_id, doc_id, len(list_intersect(c.t, d.t)) AS k, len(c.t) AS n FROM c, d)
    SELECT item_id, doc_id AS best_doc, round(k / n, 6) AS support FROM s WHERE k > 0 QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY k DESC, doc_id) = 1"""


def section_regex(spark: SparkSession, sf: str) -> DataFrame:
    found = table(spark, sf, "documents").select("doc_id", section_references(F.col("text")).alias("s"))
    return found.where(F.size("s") > 0).select("doc_id", F.size("s").cast("long").alias("n_references"), F.array_join("s", ",").alias("refs"))


SECTION_REGEX = r"""WITH m AS (SELECT doc_id, list_concat(regexp_extract_all(lower(text), '(?:section|article)\s*([0-9]+(?:\.[0-9]+)*)', 1), regexp_extract_all(lower(text), '\b([0-9]+\.[0-9]+(?:\.[0-9]+)*)\b', 1)) AS a FROM documents),
    u AS (SELECT doc_id, list_filter(a, lambda x, i: list_position(a, x) = i AND NOT regexp_matches(x, '^(19|20)[0-9]{2}$')) AS s FROM m)
    SELECT doc_id, len(s) AS n_references, array_to_string(s, ',') AS refs FROM u WHERE len(s) > 0"""


def html_strip(spark: SparkSession, sf: str) -> DataFrame:
    bare = table(spark, sf, "pages").select("page_id", strip_markup(F.col("html")).alias("t"))
    return bare.select("page_id", F.length("t").cast("long").alias("n_chars"), F.md5("t").alias("digest"))


HTML_STRIP = r"""SELECT page_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT page_id,
    trim(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?s)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS t FROM pages)"""


def parent_child(spark: SparkSession, sf: str) -> DataFrame:
    nation = table(spark, sf, "nation")
    links = D.parent_links(nation, "n_nationkey", "n_regionkey").unionByName(D.sibling_links(nation, "n_nationkey", "n_regionkey"))
    return links.select(F.col("source").cast("long").alias("source"), F.col("target").cast("long").alias("target"), "relation")


PARENT_CHILD = """SELECT CAST(n_nationkey AS BIGINT) AS source, CAST(n_regionkey AS BIGINT) AS target, 'PARENT_CONTEXT' AS relation FROM nation
    UNION ALL SELECT source, target, 'SIBLING_CONTEXT' FROM (SELECT CAST(n_nationkey AS BIGINT) AS source, CAST(lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS BIGINT) AS target FROM nation) WHERE target IS NOT NULL"""


def _tree(spark: SparkSession, sf: str) -> DataFrame:
    """Orders under customers under nations under regions, as one tree of nodes."""
    node: list[tuple[str, Column, Column]] = [
        ("orders", F.concat(F.lit("o"), F.col("o_orderkey")), F.concat(F.lit("c"), F.col("o_custkey"))),
        ("customer", F.concat(F.lit("c"), F.col("c_custkey")), F.concat(F.lit("n"), F.col("c_nationkey"))),
        ("nation", F.concat(F.lit("n"), F.col("n_nationkey")), F.concat(F.lit("r"), F.col("n_regionkey"))),
        ("region", F.concat(F.lit("r"), F.col("r_regionkey")), F.lit(None).cast("string")),
    ]
    parts = [table(spark, sf, t).select(own.alias("node_id"), up.alias("parent_id"), F.lit(t).alias("node_type")) for t, own, up in node]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def ancestor(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators.shared import checkpoints

    checkpoints(spark)
    found = lineage.ancestor(_tree(spark, sf), "node_id", "parent_id", "node_type", "region")
    return found.where("node LIKE 'o%'").groupBy("ancestor").agg(F.count("*").alias("n_orders"))


ANCESTOR = """SELECT 'r' || n_regionkey AS ancestor, count(*) AS n_orders FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_regionkey"""


def governing_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The same tree as a law: regions are sections, some nations subsections, some customers clauses, and orders hang on them."""
    from ..operators.shared import checkpoints

    checkpoints(spark)
    n = F.substring("node_id", F.lit(2), F.lit(20)).cast("long")
    kind = F.when(F.col("node_type") == "region", "section").when(F.col("node_type") == "nation", F.when(n % 2 == 0, "subsection").otherwise("group")).when(F.col("node_type") == "customer", F.when(n % 3 > 0, "clause").otherwise("note"))
    law = _tree(spark, sf).withColumn("kind", kind.otherwise(F.element_at(F.array(*[F.lit(k) for k in ("proviso", "explanation", "table", "example")]), (n % 4 + 1).cast("int"))))
    return lineage.governing(law, "node_id", "parent_id", "kind")


GOVERNING_RULES = """WITH c AS (SELECT c_custkey, n_nationkey, n_regionkey, 'c' || c_custkey AS c, 'n' || n_nationkey AS n, 'r' || n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey),
    k AS (SELECT *, CASE WHEN c_custkey % 3 > 0 THEN c WHEN n_nationkey % 2 = 0 THEN n ELSE r END AS rule FROM c),
    o AS (SELECT 'o' || o_orderkey AS node, o_orderkey % 4 AS q, k.* FROM orders JOIN k ON o_custkey = c_custkey)
    SELECT 'r' || r_regionkey AS node, 'r' || r_regionkey AS reasoning_parent, 'r' || r_regionkey AS governing_rule FROM region
    UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'r' || n_regionkey FROM nation
    UNION ALL SELECT c, x, x FROM (SELECT c, CASE WHEN c_custkey % 3 > 0 AND n_nationkey % 2 > 0 THEN r ELSE n END AS x FROM k)
    UNION ALL SELECT node, CASE WHEN q < 2 THEN rule WHEN q = 2 THEN r ELSE c END, CASE WHEN q < 3 THEN rule ELSE c END FROM o"""


def keep_first_near_dup(spark: SparkSession, sf: str) -> DataFrame:
    """Documents dropped because an earlier kept one of the same source overlaps them."""
    from ..operators.shared import checkpoints

    checkpoints(spark)
    return D.keep_first(table(spark, sf, "documents"), "doc_id", "source", "text")


KEEP_FIRST_NEAR_DUP = f"""WITH RECURSIVE p AS ({JACCARD_NEAR_DUP}), n AS (SELECT doc_b, list(doc_a) AS earlier, row_number() OVER (ORDER BY doc_b) AS i FROM p GROUP BY doc_b),
    r AS (SELECT CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS dropped UNION ALL SELECT n.i, CASE WHEN len(list_filter(earlier, lambda x: NOT list_contains(dropped, x))) > 0 THEN list_append(dropped, doc_b) ELSE dropped END FROM r JOIN n ON n.i = r.i + 1),
    c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY source, t) AS first FROM (SELECT source, doc_id, list_sort(list_distinct({_TOKENS})) AS t FROM documents) WHERE len(t) > 0 AND source IS NOT NULL)
    SELECT unnest(dropped) AS doc_id FROM (SELECT dropped FROM r ORDER BY i DESC LIMIT 1) UNION ALL SELECT doc_id FROM c WHERE doc_id <> first"""


def jaccard_copies(spark: SparkSession, sf: str) -> DataFrame:
    """The documents that ``q_jaccard_near_dup`` folds into their representative."""
    return D.copies(table(spark, sf, "documents"), "doc_id", "source", "text")


JACCARD_COPIES = f"""SELECT source, doc_id, representative FROM (SELECT source, doc_id, min(doc_id) OVER (PARTITION BY source, t) AS representative
    FROM (SELECT source, doc_id, list_sort(list_distinct({_TOKENS})) AS t FROM documents) WHERE len(t) > 0 AND source IS NOT NULL) WHERE doc_id <> representative"""


QUERIES = {
    "q_bm25_topk": (bm25_topk, BM25_TOPK),
    "q_bm25_field_weighted": (bm25_field_weighted, BM25_FIELD_WEIGHTED),
    "q_metadata_filter": (metadata_filter, METADATA_FILTER),
    "q_authority_min": (authority_min, AUTHORITY_MIN),
    "q_quality_filter": (quality_filter, QUALITY_FILTER),
    "q_tokenize_stats": (tokenize_stats, TOKENIZE_STATS),
    "q_jaccard_near_dup": (jaccard_near_dup, JACCARD_NEAR_DUP),
    "q_jaccard_copies": (jaccard_copies, JACCARD_COPIES),
    "q_keep_first_near_dup": (keep_first_near_dup, KEEP_FIRST_NEAR_DUP),
    "q_dense_topk": (dense_topk, DENSE_TOPK),
    "q_cosine_minscore": (cosine_minscore, COSINE_MINSCORE),
    "q_channel_argmax": (channel_argmax, CHANNEL_ARGMAX),
    "q_rrf": (rrf, RRF),
    "q_multi_rrf": (multi_rrf, MULTI_RRF),
    "q_rerank": (rerank, RERANK),
    "q_conflicts": (conflicts, CONFLICTS),
    "q_chunk_fixed": (chunk_fixed, CHUNK_FIXED),
    "q_chunk_tokens": (chunk_tokens, CHUNK_TOKENS),
    "q_sentence_split": (sentence_split, SENTENCE_SPLIT),
    "q_claim_support": (claim_support, CLAIM_SUPPORT),
    "q_section_regex": (section_regex, SECTION_REGEX),
    "q_html_strip": (html_strip, HTML_STRIP),
    "q_parent_child": (parent_child, PARENT_CHILD),
    "q_ancestor": (ancestor, ANCESTOR),
    "q_governing_rules": (governing_rules, GOVERNING_RULES),
}
