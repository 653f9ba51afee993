"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import cross_polytope, curriculum, kd_shards, merkle, packing, page_diff, pii, quality_model, rules, simhash, spelling, sstable, topk
from .common import cut, table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op2_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = kd_shards.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op3_page_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_diff.extract(table(spark, sf_dir, "pages"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(packing.pieces(table(spark, sf_dir, "documents")))
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op5_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sstable.round_trip(table(spark, sf_dir, "documents"))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), "pii")
    counts = [F.size(F.col("pii")[k]).cast("long").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(pii.joined(pii.base_spans("pii")).cast("binary"), 256).alias("base_sha256"), pii.joined(pii.all_spans("pii")).alias("spans"))


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.ledger(table(spark, sf_dir, "documents").select("doc_id", "text"), "ledger")
    values = [F.col(f"ledger.{m}").alias(m) for m in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")]
    return judged.select("doc_id", *values, rules.rejected("ledger", "base").alias("base_failed"), (~rules.rejected("ledger")).alias("kept"))


def op8_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_duplicates(table(spark, sf_dir, "embeddings"))


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_model.score(docs, quality_model.train(docs, table(spark, sf_dir, "labels")))


def op10_curriculum(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    planned = curriculum.plan(cut(docs.select("doc_id", curriculum.sized(docs).alias("mix"))), "mix")
    first = F.when(F.col("mix.copies") > 0, F.round(curriculum.when_read("mix", F.lit(0)), 9))
    digest = planned.select("doc_id", "mix.size", "mix.source_size", "mix.target", "mix.taken", "mix.copies", first.alias("first_position"))
    return digest.repartitionByRange(F.col("first_position"), F.col("doc_id")).sortWithinPartitions("first_position", "doc_id")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"), damage=199)


def op12_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, 5)


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), merkle.without_newlines()).fold()


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_kd_shards": op2_kd_shards,
    "op3_page_diff": op3_page_diff,
    "op4_packing": op4_packing,
    "op5_sstable": op5_sstable,
    "op6_pii": op6_pii,
    "op7_rules": op7_rules,
    "op8_cross_polytope": op8_cross_polytope,
    "op9_quality": op9_quality,
    "op10_curriculum": op10_curriculum,
    "op11_spelling": op11_spelling,
    "op12_topk": op12_topk,
    "op13_merkle": op13_merkle,
    "pipeline": pipeline,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Every rule of the current policy, over measurements taken from the whole texts; rid tells repeated rows apart.
OP7_SQL = rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
    l AS (SELECT rid, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
    g AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d)),
    r AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS c FROM g) WHERE c > 1) GROUP BY rid),
    m AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words, len(list_filter(w, lambda x: length(x) > 1 AND x = upper(x) AND x <> lower(x))) AS n_shouted, len(list_filter(w, lambda x: regexp_matches(x, '[!?]$'))) AS n_marks
      FROM d JOIN l USING (rid) LEFT JOIN r USING (rid)),
    b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
      NOT (base_failed OR 10 * n_symbols > 3 * n_words OR (n_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines) OR 100 * n_shouted > 60 * n_words OR 100 * n_marks > 60 * n_words) AS kept FROM b"""

#: All rows of a label by brute force, and components by repeatedly taking the smallest id in reach.
OP8_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
    a AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_dot_product(e, e) > 0),
    p AS (SELECT x.vec_id AS s, y.vec_id AS t FROM a x JOIN a y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.e) = len(y.e) AND list_dot_product(x.e, y.e) / (x.n * y.n) >= 0.93),
    reach AS (SELECT vec_id AS s, vec_id AS t FROM v UNION SELECT r.s, p.t FROM reach r JOIN p ON r.t = p.s)
    SELECT vec_id, n_links, component_id, vec_id = component_id AS kept FROM (SELECT vec_id, (SELECT count(*) FROM p WHERE s = vec_id) AS n_links, (SELECT min(t) FROM reach WHERE s = vec_id) AS component_id FROM v)"""

OP10_SQL = rf"""WITH d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS z, CAST(row_number() OVER (ORDER BY source NULLS LAST) - 1 AS INTEGER) AS k FROM d GROUP BY source),
    w AS (SELECT *, [5, 2, 1][k % 3 + 1] AS w, [-0.5::DOUBLE, 0.0::DOUBLE, 0.5::DOUBLE][k % 3 + 1] AS slope, z * 3 AS lim FROM s),
    o AS (SELECT *, (CAST((SELECT sum(z) FROM s) AS DOUBLE) - coalesce(sum(lim) OVER x, 0)) / ((SELECT sum(w) FROM w) - coalesce(sum(w) OVER x, 0)) AS lvl
      FROM w WINDOW x AS (ORDER BY lim / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    t AS (SELECT source, z, slope, CASE WHEN lim / w <= lvl THEN CAST(lim AS DOUBLE) ELSE (SELECT lvl FROM o WHERE lim / w > lvl ORDER BY lim / w, source NULLS LAST LIMIT 1) * w END AS target FROM o),
    c AS (SELECT d.doc_id, d.size, t.z, t.target, t.slope, coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY h, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + d.size / 2.0 AS middle,
      CASE WHEN t.z > 0 THEN CAST(floor(t.target / t.z) AS BIGINT) ELSE 0 END AS passes FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    f AS (SELECT *, CAST(passes + CASE WHEN target - passes * z > 0 AND middle <= target - passes * z THEN 1 ELSE 0 END AS INTEGER) AS copies, least(CASE WHEN target > 0 THEN CAST(middle AS DOUBLE) / target ELSE 0.0 END, 1.0) AS share FROM c)
    SELECT doc_id, size, z AS source_size, target, size * copies AS taken, copies,
      CASE WHEN copies > 0 THEN round(CASE WHEN slope = 0 THEN share ELSE (sqrt((1 - slope) * (1 - slope) + 4 * slope * share) - (1 - slope)) / (2 * slope) END, 9) END AS first_position FROM f"""

#: The crc32 of a string: its table of 256 numbers, and a fold over the UTF-8 bytes.
_CRC_TABLE = "SELECT list_transform(range(256), lambda n: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n)) AS crc_table"


def _crc(s: str) -> str:
    byte = f"CAST('0x' || substring(hex(encode({s})), 2 * i + 1, 2) AS BIGINT)"
    return f"xor(4294967295, list_reduce(list_transform(range(strlen({s})), lambda i: {byte}), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1]), 4294967295))"


_A_TO_Z, _ACCENTED = "".join(map(chr, range(65, 91))), "".join(map(chr, range(0xC0, 0x100)))
_ONE_BYTE = "".join(map(chr, range(33, 97))).replace("'", "''")

#: All words against all of a like length. DuckDB's distance counts bytes, so accented letters are first written as one byte each.
OP11_SQL = f"""WITH RECURSIVE t AS ({_CRC_TABLE}),
    r AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') || ':' AS id, translate(run, '{_A_TO_Z}', '{_A_TO_Z.lower()}') AS run, count(*) AS n
      FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) GROUP BY ALL),
    h AS (SELECT run, n, {_crc("id || run")} AS h FROM r, t),
    w AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (SELECT n, CASE WHEN h % 199 = 0 THEN substring(run, 1, h % length(run)) || substring(run, h % length(run) + 2) ELSE run END AS word FROM h)
      WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
    b AS (SELECT *, length(word) AS l, translate(word, '{_ACCENTED}', '{_ONE_BYTE}') AS s FROM w),
    p AS (SELECT x.word, x.n, y.word AS near, y.n AS near_n FROM b x JOIN b y ON abs(x.l - y.l) <= 1 AND x.word <> y.word AND levenshtein(x.s, y.s) = 1),
    f AS (SELECT word, count(*) AS n_near, min(struct_pack(a := -near_n, b := near)) AS best FROM p GROUP BY word),
    v AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -best.a >= 5 * w.n THEN best.b END AS form, CASE WHEN -best.a >= 5 * w.n THEN -best.a END AS form_n FROM w LEFT JOIN f USING (word)),
    up AS (SELECT word, form AS top, 1 AS k FROM v WHERE form IS NOT NULL UNION ALL SELECT up.word, v.form, k + 1 FROM up JOIN v ON v.word = up.top WHERE v.form IS NOT NULL)
    SELECT v.word, form, coalesce(root, v.word) AS root, n, n_near, form_n FROM v LEFT JOIN (SELECT word, arg_max(top, k) AS root FROM up GROUP BY word) e USING (word)"""

OP12_SQL = """WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
      WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.rid <> c.rid AND len(q.e) = len(c.e)),
    o AS (SELECT *, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM o WHERE rank <= 5"""


def _part(s: str) -> str:
    return f"coalesce(strlen(CAST({s} AS VARCHAR)) || ':' || CAST({s} AS VARCHAR), '-')"


_EVEN = "coalesce(" + _crc("CAST(doc_id AS VARCHAR)") + " % 2 = 0, FALSE)"


def _levels(base: str, own: str) -> str:
    """All nodes of the trees of ``base`` (tree, pos, h); c is how many there are on a node's level."""
    return f"SELECT tree, 0 AS lvl, pos, h, count(*) OVER (PARTITION BY tree) AS c FROM {base} UNION ALL SELECT tree, lvl + 1, pos // 3, sha256(string_agg(h, '' ORDER BY pos)), (min(c) + 2) // 3 FROM {own} WHERE c > 1 GROUP BY tree, lvl, pos // 3"


def _folds(base: str, nodes: str, own: str) -> str:
    """Values of ``base`` (rid, tree, pos, v, s) folded through the trees of ``nodes``; s gathers siblings."""
    return f"""SELECT rid, tree, 0 AS lvl, pos, v, s FROM {base} UNION ALL
      SELECT f.rid, f.tree, f.lvl + 1, f.pos // 3, sha256(string_agg(CASE WHEN n.pos = f.pos THEN f.v ELSE n.h END, '' ORDER BY n.pos)), f.s || coalesce(string_agg(n.h, '' ORDER BY n.pos) FILTER (n.pos <> f.pos), '')
      FROM {own} f JOIN {nodes} n ON n.tree = f.tree AND n.lvl = f.lvl AND n.pos // 3 = f.pos // 3 WHERE n.c > 1 GROUP BY f.rid, f.tree, f.lvl, f.pos, f.v, f.s"""


OP13_SQL = f"""WITH RECURSIVE t AS ({_CRC_TABLE}),
    a AS (SELECT doc_id, coalesce('1' || source, '0') AS tree, {" || ".join(_part(c) for c in ("doc_id", "source", "lang", "n_chars"))} AS fields, text, CASE WHEN {_EVEN} THEN replace(text, chr(10), '') ELSE text END AS other FROM documents, t),
    o AS (SELECT row_number() OVER () AS rid, doc_id, tree, h, v, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, h) - 1 AS pos FROM (SELECT doc_id, tree, sha256(fields || {_part("text")}) AS h, sha256(fields || {_part("other")}) AS v FROM a)),
    n AS ({_levels("o", "n")}),
    u AS (SELECT tree AS source_tree, 'all' AS tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos FROM n WHERE c = 1),
    m AS ({_levels("u", "m")}),
    f AS ({_folds("(SELECT *, '' AS s FROM o)", "n", "f")}),
    e AS (SELECT e.rid, u.tree, u.pos, e.v, e.s FROM (SELECT rid, any_value(tree) AS tree, arg_max(v, lvl) AS v, arg_max(s, lvl) AS s FROM f GROUP BY rid) e JOIN u ON u.source_tree = e.tree),
    g AS ({_folds("e", "m", "g")}),
    z AS (SELECT rid, arg_max(v, lvl) AS folded_root, sha256(arg_max(s, lvl)) AS proof_sha256 FROM g GROUP BY rid)
    SELECT o.doc_id, o.h AS leaf, u.h AS subroot, root, proof_sha256, folded_root, folded_root = root AS verified
    FROM o JOIN u ON u.source_tree = o.tree JOIN z USING (rid), (SELECT h AS root FROM m WHERE c = 1)"""

SQL = {"op7_rules": OP7_SQL, "op8_cross_polytope": OP8_SQL, "op10_curriculum": OP10_SQL, "op11_spelling": OP11_SQL, "op12_topk": OP12_SQL, "op13_merkle": OP13_SQL}
