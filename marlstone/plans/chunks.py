"""Registered queries of the chunkers, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunkers as K
from ..sources.tables import table


def _pages(spark: SparkSession, sf: str) -> DataFrame:
    """A page of law for each customer: its orders as lines, by status and priority headings, examples, clauses, parts and page numbers."""
    o = table(spark, sf, "orders").withColumn("k", F.col("o_orderkey").cast("string"))
    urgent, low = F.startswith("o_orderpriority", F.lit("1")), F.startswith("o_orderpriority", F.lit("5"))
    line = (
        F.when(urgent & (F.col("o_orderstatus") == "F"), F.concat(F.lit("CHAPTER "), F.col("k")))
        .when(urgent, F.concat("k", F.lit(". Definitions of terms.")))
        .when(low & (F.col("o_orderstatus") == "O"), F.concat(F.lit("Example "), F.col("k")))
        .when(low, F.lpad(F.col("k"), 5, "1"))
        .when(F.col("o_orderstatus") == "O", F.concat(F.lit("("), F.col("k"), F.lit(") “term” means this")))
        .otherwise(F.concat(F.lit("plain line "), F.col("k")))
    )
    rows = o.select("o_custkey", F.struct("o_orderkey", line.alias("l")).alias("x")).groupBy("o_custkey").agg(F.array_sort(F.collect_list("x")).alias("x"))
    return rows.select("o_custkey", F.array_join(F.transform("x", lambda x: x["l"]), "\n").alias("t"))


_LINE = """CASE WHEN starts_with(o_orderpriority, '1') AND o_orderstatus = 'F' THEN 'CHAPTER ' || o_orderkey WHEN starts_with(o_orderpriority, '1') THEN o_orderkey || '. Definitions of terms.'
    WHEN starts_with(o_orderpriority, '5') AND o_orderstatus = 'O' THEN 'Example ' || o_orderkey WHEN starts_with(o_orderpriority, '5') THEN lpad(CAST(o_orderkey AS VARCHAR), 5, '1')
    WHEN o_orderstatus = 'O' THEN '(' || o_orderkey || ') “term” means this' ELSE 'plain line ' || o_orderkey END"""


def page_blocks(spark: SparkSession, sf: str) -> DataFrame:
    rows = K.page_blocks(_pages(spark, sf), "o_custkey", "t")
    return rows.select("o_custkey", "kind", "heading", F.col("n_lines").cast("long").alias("n_lines"), F.md5("chunk").alias("digest"))


PAGE_BLOCKS = f"""WITH l AS (SELECT o_custkey, o_orderkey AS place, {_LINE} AS line FROM orders), r AS (SELECT * FROM l WHERE NOT regexp_matches(line, '^[0-9]{{4,6}}$')),
    f AS (SELECT *, regexp_matches(line, '^(?i)CHAPTER\\s+[IVXLC0-9]+\\s*$') AS ctx, regexp_matches(line, '^[0-9]+\\. Def') AS sec FROM r),
    h AS (SELECT *, last_value(CASE WHEN ctx THEN line END IGNORE NULLS) OVER w AS c, last_value(CASE WHEN sec THEN line WHEN ctx THEN '' END IGNORE NULLS) OVER w AS s, coalesce(lag(ctx) OVER (PARTITION BY o_custkey ORDER BY place), true) AS after
      FROM f WINDOW w AS (PARTITION BY o_custkey ORDER BY place ROWS UNBOUNDED PRECEDING)),
    n AS (SELECT *, concat_ws(' > ', c, nullif(s, '')) AS heading, starts_with(line, 'Example') AS ex FROM h),
    b AS (SELECT *, sum(CASE WHEN sec OR ex OR (starts_with(line, '(') AND contains(lower(heading), 'definitions')) OR (after AND NOT ctx) THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY place ROWS UNBOUNDED PRECEDING) AS block FROM n)
    SELECT o_custkey, CASE WHEN bool_or(ex) THEN 'example' WHEN bool_or(sec) OR max(heading) <> '' THEN 'section' ELSE 'text' END AS kind, max(heading) AS heading, count(*) AS n_lines, md5(string_agg(line, chr(10) ORDER BY place)) AS digest
    FROM b WHERE NOT ctx GROUP BY o_custkey, block"""


def cleaned_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages without their edges, and whether anything is left to say."""
    text = F.col("t")
    return _pages(spark, sf).select("o_custkey", F.md5(K.cleaned(text)).alias("digest"), K.low_value(text).alias("low_value"))


CLEANED_PAGES = f"""WITH l AS (SELECT o_custkey, o_orderkey AS place, {_LINE} AS line FROM orders), f AS (SELECT *, regexp_matches(line, '^[0-9]{{4,6}}$') AS num, regexp_matches(line, '^[0-9]{{4,6}}$|^(?i)CHAPTER\\s+[IVXLC0-9]+\\s*$') AS edge FROM l),
    e AS (SELECT o_custkey, min(place) FILTER (NOT edge) AS lo, max(place) FILTER (NOT edge) AS hi, bool_and(num) AS bare FROM f GROUP BY 1)
    SELECT o_custkey, md5(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (place BETWEEN lo AND hi), '')) AS digest, any_value(bare) AS low_value FROM f JOIN e USING (o_custkey) GROUP BY o_custkey"""


def table_rows(spark: SparkSession, sf: str) -> DataFrame:
    rows = K.table_rows(_pages(spark, sf), "o_custkey", "t")
    return rows.select("o_custkey", F.col("row").cast("long").alias("row"), F.md5("chunk").alias("digest"))


TABLE_ROWS = f"""WITH l AS (SELECT o_custkey, list({_LINE} ORDER BY o_orderkey) AS l FROM orders GROUP BY 1), r AS (SELECT o_custkey, CASE WHEN len(l) <= 2 THEN [array_to_string(l, chr(10))] ELSE list_transform(l[2:], lambda x: l[1] || chr(10) || x) END AS r FROM l)
    SELECT o_custkey, CAST(i - 1 AS BIGINT) AS row, md5(r[i]) AS digest FROM (SELECT o_custkey, r, unnest(range(1, len(r) + 1)) AS i FROM r)"""


def structured_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Order lines as a page of serials, codes and text for each order."""
    n = F.col("l_linenumber").cast("string")
    lines = F.concat_ws("\n", F.concat(n, F.lit(".")), F.concat(F.lpad((F.col("l_partkey") % 100).cast("string"), 2, "0"), F.lit("."), F.lpad((F.col("l_suppkey") % 100).cast("string"), 2, "0")), F.concat(F.lit("goods "), F.col("l_returnflag")))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    pages = table(spark, sf, "lineitem").select("l_orderkey", F.struct(*order, lines.alias("l")).alias("x")).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["l"]), "\n").alias("t"))
    rows = K.structured_rows(pages, "l_orderkey", "t")
    return rows.select("l_orderkey", "block", "codes", F.md5("chunk").alias("digest"))


STRUCTURED_ROWS = """WITH r AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS block, lpad(CAST(l_partkey % 100 AS VARCHAR), 2, '0') || '.' || lpad(CAST(l_suppkey % 100 AS VARCHAR), 2, '0') AS codes, l_linenumber, l_returnflag FROM lineitem)
    SELECT l_orderkey, block, codes, md5(l_linenumber || '.' || chr(10) || codes || chr(10) || 'goods ' || l_returnflag) AS digest FROM r"""

def page_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of a source as the pages of one, some of which open a part or a section; no SQL: blocks are folded."""
    from ..operators.shared import checkpoints
    from ..operators.spans import page_chunks as chunks

    checkpoints(spark)
    opens = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("PART "), F.col("doc_id") % 5 + 1, F.lit("\n"))).when(F.col("doc_id") % 7 == 2, F.concat(F.col("doc_id"), F.lit(". Levy of tax\n"))).otherwise("")
    pages = table(spark, sf, "documents").where("source IS NOT NULL AND doc_id IS NOT NULL").select("source", "doc_id", F.concat(opens, "text").alias("text"))
    return chunks(pages, "source", "doc_id", "text").select("source", "doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "kind", "heading", "chunk")


PAGE_CHUNKS = None


_NAMES = "page_chunks page_blocks cleaned_pages table_rows structured_rows".split()
QUERIES = {f"q_{n}": (globals()[n], globals()[n.upper()]) for n in _NAMES}


def long_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Documents packed from whole sentences up to 200 tokens; a fold, so without SQL."""
    rows = K.long_segments(table(spark, sf, "documents"), "doc_id", "text")
    return rows.select("doc_id", F.col("piece").cast("long").alias("piece"), F.col("n_tokens").cast("long").alias("n_tokens"), F.md5("chunk").alias("digest"))


QUERIES["q_long_segments"] = (long_segments, None)
