"""Registered queries of catalog, scoring and analytics operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores as S
from ..operators import analytics as A
from ..operators import catalog as C
from ..operators import filters
from ..sources.tables import table


def _parts(spark: SparkSession, sf: str) -> DataFrame:
    """Parts with a stock stand-in: the lines ordered of a part, by 7."""
    part = table(spark, sf, "part")
    return part.withColumn("stock", F.pmod(F.col("p_partkey") * 7, F.lit(23)).cast("int"))


_PARTS = "(SELECT *, CAST((p_partkey * 7) % 23 AS INTEGER) AS stock FROM part)"


def browse(spark: SparkSession, sf: str) -> DataFrame:
    kept = filters.apply(_parts(spark, sf), {"p_retailprice": {"$lte": 1500.0}, "stock": {"$gte": 1}, "p_size": {"$in": [1, 5, 10, 20]}})
    return kept.orderBy(F.desc("p_retailprice"), "p_partkey").limit(25).select("p_partkey", "p_name", "p_retailprice", "stock")


BROWSE = f"SELECT p_partkey, p_name, p_retailprice, stock FROM {_PARTS} WHERE p_retailprice <= 1500.0 AND stock >= 1 AND p_size IN (1, 5, 10, 20) ORDER BY p_retailprice DESC, p_partkey LIMIT 25"


def relaxed_search(spark: SparkSession, sf: str) -> DataFrame:
    """Brand is required; the weakest test goes first: size, then price, then stock."""
    soft = [F.col("p_size") == 7, F.col("p_retailprice") < 901, F.col("stock") > 21]
    return filters.relaxed(_parts(spark, sf), F.col("p_brand") == "Brand#11", soft).select("p_partkey", F.col("level").cast("long").alias("level"))


RELAXED_SEARCH = f"""WITH l AS (SELECT p_partkey, CASE WHEN NOT stock > 21 THEN 3 WHEN NOT p_retailprice < 901 THEN 2 WHEN NOT p_size = 7 THEN 1 ELSE 0 END AS level FROM {_PARTS} WHERE p_brand = 'Brand#11')
    SELECT p_partkey, CAST(level AS BIGINT) AS level FROM l WHERE level = (SELECT min(level) FROM l)"""


def _lexical(terms: list[str]):
    text = F.lower(F.concat_ws(" ", "p_name", "p_brand", "p_type"))
    return sum((F.when(F.contains(F.lower("p_name"), F.lit(t)), 3.0).when(F.contains(F.lower("p_type"), F.lit(t)), 2.0).when(F.contains(text, F.lit(t)), 1.0).otherwise(0.0) for t in terms), F.lit(0.0))


_TERMS = ["part", "brass", "brand#1", "large"]
_LEXICAL = " + ".join(f"CASE WHEN contains(lower(p_name), '{t}') THEN 3.0 WHEN contains(lower(p_type), '{t}') THEN 2.0 WHEN contains(lower(concat_ws(' ', p_name, p_brand, p_type)), '{t}') THEN 1.0 ELSE 0.0 END" for t in _TERMS)


def lexical_score(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select("p_partkey", _lexical(_TERMS).alias("score")).where("score > 3")


LEXICAL_SCORE = f"SELECT p_partkey, CAST(score AS DOUBLE) AS score FROM (SELECT p_partkey, {_LEXICAL} AS score FROM part) WHERE score > 3"


def semantic_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Gates narrow the candidates only where some candidate passes: type, then a price cap, then an anchor on the lexical score."""
    rows = _parts(spark, sf).withColumn("score", _lexical(_TERMS)).where("score > 0")
    rows = filters.keep_or_all(rows, F.contains(F.lower("p_type"), F.lit("brass")))
    rows = filters.keep_or_all(rows, F.col("p_retailprice") <= 1200)
    rows = filters.keep_or_all(rows, F.col("p_brand") == "Brand#99")
    best = rows.agg(F.max("score").alias("_best"))
    return rows.crossJoin(F.broadcast(best)).where("score >= greatest(4.0, 0.6 * _best)").select("p_partkey", "score")


SEMANTIC_GATES = f"""WITH a AS (SELECT *, {_LEXICAL} AS score FROM {_PARTS}), b AS (SELECT * FROM a WHERE score > 0),
    c AS (SELECT * FROM b WHERE contains(lower(p_type), 'brass') OR NOT EXISTS (SELECT 1 FROM b WHERE contains(lower(p_type), 'brass'))),
    d AS (SELECT * FROM c WHERE p_retailprice <= 1200 OR NOT EXISTS (SELECT 1 FROM c WHERE p_retailprice <= 1200)),
    e AS (SELECT * FROM d WHERE p_brand = 'Brand#99' OR NOT EXISTS (SELECT 1 FROM d WHERE p_brand = 'Brand#99'))
    SELECT p_partkey, CAST(score AS DOUBLE) AS score FROM e WHERE score >= greatest(4.0, 0.6 * (SELECT max(score) FROM e))"""


def evidence_score(spark: SparkSession, sf: str) -> DataFrame:
    """The linear evidence score of every part, for a wish of type, brand and budget."""
    rows = _parts(spark, sf)
    lexical = S.clamp(_lexical(_TERMS) / 12.0)
    kind = F.when(F.contains(F.lower("p_type"), F.lit("brass")), 1.0).otherwise(0.0)
    brand = F.when(F.col("p_brand") == "Brand#12", 1.0).otherwise(0.0)
    stock = F.when(F.col("stock") > 0, 1.0).otherwise(0.0)
    raw = lexical * 0.14 + kind * 0.18 + brand * 0.05 + S.price_fit(F.col("p_retailprice"), 1000.0, 1400.0) * 0.07 + stock * 0.03 - (1 - kind) * 0.2 - F.when(F.col("stock") <= 0, 0.25).otherwise(0.0)
    return rows.select("p_partkey", F.round(S.clamp(raw), 4).alias("score"))


_FIT = "CASE WHEN p_retailprice < 1000 THEN greatest(0.0, least(1.0, 1.0 - (1000.0 - p_retailprice) / 1000.0)) WHEN p_retailprice > 1400 THEN greatest(0.0, least(1.0, 1.0 - (p_retailprice - 1400.0) / 1400.0)) ELSE 1.0 END"
EVIDENCE_SCORE = f"""SELECT p_partkey, round(greatest(0.0::DOUBLE, least(1.0::DOUBLE, least(CAST({_LEXICAL} AS DOUBLE) / 12.0, 1.0) * 0.14::DOUBLE + k * 0.18::DOUBLE + (CASE WHEN p_brand = 'Brand#12' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) * 0.05::DOUBLE
    + CAST({_FIT} AS DOUBLE) * 0.07::DOUBLE + (CASE WHEN stock > 0 THEN 0.03::DOUBLE ELSE 0.0::DOUBLE END) - (1 - k) * 0.2::DOUBLE - (CASE WHEN stock <= 0 THEN 0.25::DOUBLE ELSE 0.0::DOUBLE END))), 4) AS score
    FROM (SELECT *, CASE WHEN contains(lower(p_type), 'brass') THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS k FROM {_PARTS})"""


def recommend(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of middling size scored by fit, evidence, availability and price; limits over the set are one broadcast row."""
    rows = _parts(spark, sf).where("p_size BETWEEN 10 AND 20")
    over = rows.agg(F.max("stock").alias("_most"), F.min("p_retailprice").alias("_low"), F.max("p_retailprice").alias("_high"))
    rows = rows.crossJoin(F.broadcast(over))
    cheap = 1 - S.price_position(F.col("p_retailprice"), F.col("_low"), F.col("_high"))
    score = S.recommendation_score(F.col("p_size") / 50.0, F.lit(1.0), F.lit(0.5), S.availability(F.col("stock"), F.col("_most")), cheap, F.col("stock") <= 0)
    return rows.select("p_partkey", F.round(score, 4).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(50)


RECOMMEND = f"""WITH r AS (SELECT * FROM {_PARTS} WHERE p_size BETWEEN 10 AND 20), o AS (SELECT max(stock) AS most, min(p_retailprice) AS low, max(p_retailprice) AS high FROM r),
    s AS (SELECT p_partkey, stock, p_size / 50.0::DOUBLE * 0.52::DOUBLE + 0.18::DOUBLE + 0.5::DOUBLE * 0.1::DOUBLE + (CASE WHEN stock <= 0 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, 0.45::DOUBLE + least(stock / greatest(most, 1), 1.0::DOUBLE) * 0.55::DOUBLE) END) * 0.12::DOUBLE
      + (1 - (p_retailprice - low) / (high - low)) * 0.08::DOUBLE AS t FROM r, o)
    SELECT p_partkey, round(least(1.0::DOUBLE, CASE WHEN stock <= 0 THEN t * 0.65::DOUBLE ELSE t END), 4) AS score FROM s ORDER BY score DESC, p_partkey LIMIT 50"""


def _signals(spark: SparkSession, sf: str) -> DataFrame:
    """Sales signals of each part from order lines: units, orders, share returned, days to ship, margin."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    per = lines.groupBy(F.col("l_partkey").alias("p_partkey")).agg(
        F.sum("l_quantity").cast("long").alias("units"), F.count("*").alias("orders"), (F.count_if(F.col("l_returnflag") == "R") / F.count("*")).alias("returns"),
        F.max(F.datediff("l_shipdate", "o_orderdate")).alias("lead"), F.avg("l_discount").alias("discount"),
    )
    return per.join(_parts(spark, sf).select("p_partkey", "stock"), "p_partkey")


_SIGNALS = f"""(SELECT p_partkey, stock, units, orders, returns, lead, discount FROM (SELECT l_partkey AS p_partkey, CAST(sum(l_quantity) AS BIGINT) AS units, count(*) AS orders,
    count(*) FILTER (l_returnflag = 'R') / count(*) AS returns, max(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE))) AS lead, avg(l_discount) AS discount
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_partkey) JOIN {_PARTS} USING (p_partkey))"""


def restock(spark: SparkSession, sf: str) -> DataFrame:
    rows = _signals(spark, sf)
    over = rows.agg(F.max("units").alias("_u"), F.max("orders").alias("_o"), F.max("lead").alias("_l"))
    rows = rows.crossJoin(F.broadcast(over))
    demand = F.greatest(S.share_of_max(F.col("units"), F.col("_u")), S.share_of_max(F.col("orders"), F.col("_o")))
    score = S.restock_score(F.col("stock"), demand, S.share_of_max(F.col("lead"), F.col("_l")), F.col("discount"), F.lit(0.3), F.col("returns"))
    return rows.select("p_partkey", F.round(score, 4).alias("score")).orderBy(F.desc("score"), "p_partkey").limit(100)


_PRESSURE = "CASE WHEN stock <= 0 THEN 1.0 WHEN stock <= 2 THEN 0.95 WHEN stock <= 5 THEN 0.82 WHEN stock <= 10 THEN 0.58 ELSE 0.24 END"
_CLAMP = "greatest(0.0::DOUBLE, least(1.0::DOUBLE, {0}))"
RESTOCK = f"""WITH s AS (SELECT * FROM {_SIGNALS}), o AS (SELECT max(units) AS u, max(orders) AS n, max(lead) AS l FROM s)
    SELECT p_partkey, round({_CLAMP.format(f"CAST({_PRESSURE} AS DOUBLE) * 0.33::DOUBLE + greatest(units / u, orders / n) * 0.27::DOUBLE + {_CLAMP.format('lead / l')} * 0.16::DOUBLE + discount * 0.14::DOUBLE + 0.3::DOUBLE * 0.08::DOUBLE - returns * 0.08::DOUBLE")}, 4) AS score
    FROM s, o ORDER BY score DESC, p_partkey LIMIT 100"""


def business_priority(spark: SparkSession, sf: str) -> DataFrame:
    rows = _signals(spark, sf)
    score = S.business_priority(F.col("discount"), F.col("units"), F.col("stock"), F.col("lead"), F.col("returns"), 0.2)
    return rows.select("p_partkey", F.round(score, 9).alias("priority"))


BUSINESS_PRIORITY = f"""SELECT p_partkey, round(greatest(0.0::DOUBLE, least(0.99::DOUBLE, 0.12::DOUBLE + discount * 0.35::DOUBLE + least(units / 80.0::DOUBLE, 1.0::DOUBLE) * 0.25::DOUBLE
    + CASE WHEN stock <= 0 THEN 0.28::DOUBLE WHEN stock <= 5 THEN 0.22::DOUBLE WHEN stock <= 10 THEN 0.14::DOUBLE ELSE 0.0::DOUBLE END
    + least(lead / 45.0::DOUBLE, 1.0::DOUBLE) * 0.2::DOUBLE - returns * 0.12::DOUBLE)), 9) AS priority FROM {_SIGNALS}"""


def bundle(spark: SparkSession, sf: str) -> DataFrame:
    """The cheapest part in stock of each type; a type's choice may not exist."""
    rows = _parts(spark, sf).where("stock > 0")
    return C.best_of_each(rows, "p_type", [F.col("p_retailprice"), F.col("p_partkey")], ["p_partkey", "p_retailprice"])


BUNDLE = f"SELECT p_type, p_partkey, p_retailprice FROM {_PARTS} WHERE stock > 0 QUALIFY row_number() OVER (PARTITION BY p_type ORDER BY p_retailprice, p_partkey) = 1"


def alternatives(spark: SparkSession, sf: str) -> DataFrame:
    return C.nearest_by(table(spark, sf, "part"), "p_type", "p_retailprice", "p_partkey").select("p_partkey", F.col("other").alias("alternative"), "distance")


ALTERNATIVES = """WITH w AS (SELECT p_partkey AS k, p_retailprice AS v, lag(p_retailprice) OVER x AS pv, lag(p_partkey) OVER x AS pk, lead(p_retailprice) OVER x AS nv, lead(p_partkey) OVER x AS nk
      FROM part WINDOW x AS (PARTITION BY p_type ORDER BY p_retailprice, p_partkey)),
    s AS (SELECT k, pk AS o, round(abs(pv - v), 4) AS d FROM w WHERE pk IS NOT NULL UNION ALL SELECT k, nk, round(abs(nv - v), 4) FROM w WHERE nk IS NOT NULL)
    SELECT k AS p_partkey, o AS alternative, d AS distance FROM s QUALIFY row_number() OVER (PARTITION BY k ORDER BY d, o) = 1"""


def cross_sell(spark: SparkSession, sf: str) -> DataFrame:
    """For each brand the cheapest parts in stock of the brand that goes with it: the next by number."""
    rows = _parts(spark, sf).where("stock > 0 AND p_retailprice <= 1500")
    goes = F.concat(F.lit("Brand#"), (F.regexp_extract("p_brand", "[0-9]+", 0).cast("int") - 1).cast("string"))
    return C.best_of_each(rows.withColumn("for_brand", goes), "for_brand", [F.col("p_retailprice"), F.col("p_partkey")], ["p_brand", "p_partkey"])


CROSS_SELL = f"""SELECT for_brand, p_brand, p_partkey FROM (SELECT *, 'Brand#' || (CAST(regexp_extract(p_brand, '[0-9]+') AS INTEGER) - 1) AS for_brand FROM {_PARTS} WHERE stock > 0 AND p_retailprice <= 1500)
    QUALIFY row_number() OVER (PARTITION BY for_brand ORDER BY p_retailprice, p_partkey) = 1"""


def variant_siblings(spark: SparkSession, sf: str) -> DataFrame:
    return C.siblings(table(spark, sf, "part"), ["p_brand", "p_type"], "p_partkey").select("p_partkey", "n_siblings", "first_sibling")


VARIANT_SIBLINGS = "SELECT p_partkey, count(*) OVER w AS n_siblings, min(p_partkey) OVER w AS first_sibling FROM part WINDOW w AS (PARTITION BY p_brand, p_type)"


def sync_diff(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").alias("p_partkey"))
    return C.sync_diff(table(spark, sf, "part"), lines, "p_partkey")


SYNC_DIFF = """SELECT p_partkey, 'right' AS missing FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)
    UNION ALL SELECT DISTINCT l_partkey, 'left' FROM lineitem WHERE l_quantity > 45 AND l_partkey NOT IN (SELECT p_partkey FROM part)"""


def _copy(spark: SparkSession, sf: str) -> DataFrame:
    """A staged copy of parts in which some prices, sizes, stocks and keys have changed."""
    rows = _parts(spark, sf)
    return rows.select(
        F.when(F.col("p_partkey") % 11 == 0, F.col("p_partkey") + 10_000_000).otherwise(F.col("p_partkey")).alias("p_partkey"),
        F.when(F.col("p_partkey") % 7 == 0, F.col("p_retailprice") + 1).otherwise(F.col("p_retailprice")).alias("p_retailprice"),
        F.when(F.col("p_partkey") % 5 == 0, None).otherwise(F.col("p_size")).alias("p_size"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("stock") + 2).otherwise(F.col("stock")).alias("stock"),
    )


_COPY = f"""(SELECT CASE WHEN p_partkey % 11 = 0 THEN p_partkey + 10000000 ELSE p_partkey END AS p_partkey, CASE WHEN p_partkey % 7 = 0 THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice,
    CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE p_size END AS p_size, CASE WHEN p_partkey % 3 = 0 THEN stock + 2 ELSE stock END AS stock FROM {_PARTS})"""


def stale_rows(spark: SparkSession, sf: str) -> DataFrame:
    return C.changed_fields(_parts(spark, sf), _copy(spark, sf), "p_partkey", ["p_retailprice", "p_size", "stock"])


STALE_ROWS = f"""SELECT p_partkey, changed FROM (SELECT a.p_partkey, concat_ws(',', CASE WHEN a.p_retailprice IS DISTINCT FROM b.p_retailprice THEN 'p_retailprice' END,
    CASE WHEN a.p_size IS DISTINCT FROM b.p_size THEN 'p_size' END, CASE WHEN a.stock IS DISTINCT FROM b.stock THEN 'stock' END) AS changed FROM {_PARTS} a JOIN {_COPY} b USING (p_partkey)) WHERE changed <> ''"""


def upsert_actions(spark: SparkSession, sf: str) -> DataFrame:
    done = C.upsert_actions(_parts(spark, sf), _copy(spark, sf), "p_partkey", ["stock", "p_retailprice"])
    return done.groupBy("action").agg(F.count("*").alias("n_rows"), F.count_if("restocked").alias("n_restocked"))


UPSERT_ACTIONS = f"""SELECT action, count(*) AS n_rows, count(*) FILTER (restocked) AS n_restocked FROM (SELECT CASE WHEN a.p_partkey IS NULL THEN 'inserted' WHEN a.stock IS DISTINCT FROM b.stock THEN 'stock_changed'
    WHEN a.p_retailprice IS DISTINCT FROM b.p_retailprice THEN 'updated' ELSE 'skipped' END AS action, coalesce(a.stock <= 0 AND b.stock > 0, false) AS restocked FROM {_COPY} b LEFT JOIN {_PARTS} a USING (p_partkey)) GROUP BY action"""


def catalog_audit(spark: SparkSession, sf: str) -> DataFrame:
    rows = _copy(spark, sf)
    rules = {"missing_size": F.col("p_size").isNull(), "out_of_stock": F.col("stock") <= 0, "high_price": F.col("p_retailprice") > 1800, "odd_key": F.col("p_partkey") > 10_000_000}
    return C.audit(rows, "p_partkey", rules).groupBy("issue").agg(F.count("*").alias("n_rows"), F.min("p_partkey").alias("first_key"))


CATALOG_AUDIT = f"""SELECT issue, count(*) AS n_rows, min(p_partkey) AS first_key FROM (SELECT p_partkey, unnest([CASE WHEN p_size IS NULL THEN 'missing_size' END, CASE WHEN stock <= 0 THEN 'out_of_stock' END,
    CASE WHEN p_retailprice > 1800 THEN 'high_price' END, CASE WHEN p_partkey > 10000000 THEN 'odd_key' END]) AS issue FROM {_COPY}) WHERE issue IS NOT NULL GROUP BY issue"""


def funnel(spark: SparkSession, sf: str) -> DataFrame:
    return A.funnel(table(spark, sf, "events"), "view", "purchase", "error", days=7)


FUNNEL = """WITH e AS (SELECT * FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY),
    t AS (SELECT count(*) FILTER (event_type = 'view') AS s, count(*) FILTER (event_type = 'purchase') AS o, count(*) FILTER (event_type = 'error') AS a FROM e)
    SELECT s AS shown_total, o AS ordered_total, a AS abstain_total, round(o / nullif(s, 0), 3) AS conversion_rate, round(a / nullif(s + a, 0), 3) AS abstain_rate FROM t"""


def dropoff(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("event_type", F.get_json_object("props", "$.k").cast("long").alias("product"), F.col("user_id").alias("session")).where("product IS NOT NULL")
    return A.drop_off(events, "view", "purchase")


DROPOFF = """WITH e AS (SELECT event_type, user_id AS session, CAST(json_extract_string(props, '$.k') AS BIGINT) AS product FROM events WHERE event_type IN ('view', 'purchase')),
    p AS (SELECT product, session, count(*) FILTER (event_type = 'view') AS s, count(*) FILTER (event_type = 'purchase') AS o FROM e WHERE product IS NOT NULL GROUP BY ALL),
    q AS (SELECT product, CAST(sum(s) AS BIGINT) AS shown, count(*) FILTER (s > 0) AS shown_in_sessions, count(*) FILTER (s > 0 AND o > 0) AS ordered_in_sessions FROM p GROUP BY product)
    SELECT product, shown, shown_in_sessions, ordered_in_sessions, round(ordered_in_sessions / shown, 3) AS session_conversion_ratio FROM (SELECT * FROM q WHERE shown > 0 ORDER BY shown DESC, product LIMIT 20) WHERE shown >= 3"""


def _votes(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").select("lang", (F.col("quality") == 1).alias("up"))


def feedback_report(spark: SparkSession, sf: str) -> DataFrame:
    return A.feedback(_votes(spark, sf), "up", "lang")


FEEDBACK_REPORT = """SELECT lang, count(*) AS total, count(*) FILTER (quality = 1) AS up, count(*) FILTER (quality <> 1) AS down, round(count(*) FILTER (quality = 1) / count(*), 3) AS satisfaction
    FROM labels JOIN documents USING (doc_id) GROUP BY lang"""


def worst_intents(spark: SparkSession, sf: str) -> DataFrame:
    return A.worst(A.feedback(_votes(spark, sf), "up", "lang"), "lang", "down", 5)


WORST_INTENTS = "SELECT lang, count(*) AS down FROM labels JOIN documents USING (doc_id) WHERE quality <> 1 GROUP BY lang ORDER BY down DESC, lang LIMIT 5"


def preferences(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey")).join(table(spark, sf, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    return A.preferences(lines, "o_custkey", "p_brand", "l_extendedprice", 3, 5)


PREFERENCES = """WITH l AS (SELECT o_custkey, p_brand, l_extendedprice FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey),
    n AS (SELECT o_custkey, p_brand, count(*) AS n FROM l GROUP BY ALL HAVING count(*) >= 3),
    f AS (SELECT o_custkey, string_agg(p_brand, ',' ORDER BY n DESC, p_brand) AS favourites FROM (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, p_brand) <= 5) GROUP BY o_custkey),
    t AS (SELECT o_custkey, CASE WHEN count(l_extendedprice) >= 2 THEN round(median(l_extendedprice), 4) END AS typical FROM l GROUP BY o_custkey)
    SELECT o_custkey, typical, favourites FROM t LEFT JOIN f USING (o_custkey)"""


def escalation(spark: SparkSession, sf: str) -> DataFrame:
    return A.streaks(table(spark, sf, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error").where("longest >= 2")


ESCALATION = """WITH m AS (SELECT user_id, event_type = 'error' AS f, sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS run FROM events),
    r AS (SELECT user_id, run, count(*) AS n FROM m WHERE f GROUP BY ALL) SELECT user_id, count(*) AS n_streaks, max(n) AS longest FROM r GROUP BY user_id HAVING max(n) >= 2"""


def rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    marked = A.over_limit(table(spark, sf, "events"), "user_id", "ts", 3600, 2)
    return marked.where("rejected").select("event_id", "user_id", "in_window")


RATE_LIMIT = """SELECT event_id, user_id, n AS in_window FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 2"""


def regression_diff(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of quality as one run, and whether a document isn't toxic and isn't short as the next; each knows documents that the other doesn't."""
    labels, docs = table(spark, sf, "labels"), table(spark, sf, "documents")
    base = labels.where("quality IS NOT NULL").select("doc_id", (F.col("quality") == 1).alias("passed"))
    now = docs.where("n_chars > 400").join(labels.where("toxic IS NOT NULL"), "doc_id").select("doc_id", ((F.col("toxic") == 0) & (F.col("n_chars") > 1500)).alias("passed"))
    now = now.unionByName(docs.join(labels, "doc_id", "left_anti").select("doc_id", F.lit(True).alias("passed")))
    return A.regression_diff(now, base, "doc_id").groupBy("change").agg(F.count("*").alias("n_cases"))


REGRESSION_DIFF = """WITH b AS (SELECT doc_id, quality = 1 AS passed FROM labels WHERE quality IS NOT NULL),
    c AS (SELECT doc_id, toxic = 0 AND n_chars > 1500 AS passed FROM documents JOIN labels USING (doc_id) WHERE n_chars > 400 AND toxic IS NOT NULL UNION ALL SELECT doc_id, true FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
    SELECT CASE WHEN b.passed IS NULL THEN 'new' WHEN c.passed IS NULL THEN 'removed' WHEN b.passed = c.passed THEN 'unchanged' WHEN c.passed THEN 'improved' ELSE 'regressed' END AS change, count(*) AS n_cases
    FROM c FULL JOIN b USING (doc_id) GROUP BY ALL"""


def family_summary(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    per = events.groupBy(F.col("event_type").alias("family")).agg(F.count("*").alias("total"), F.count_if(F.col("value") > 50).alias("passed"), F.round(F.avg("value"), 2).alias("avg_value"))
    return per.withColumn("accuracy", F.round(F.col("passed") / F.col("total"), 3))


FAMILY_SUMMARY = "SELECT event_type AS family, count(*) AS total, count(*) FILTER (value > 50) AS passed, round(avg(value), 2) AS avg_value, round(count(*) FILTER (value > 50) / count(*), 3) AS accuracy FROM events GROUP BY event_type"


def session_state(spark: SparkSession, sf: str) -> DataFrame:
    turns = table(spark, sf, "conversations")
    return turns.groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"), F.max_by("role", "turn").alias("last_role"))


SESSION_STATE = "SELECT conv_id, count(*) AS n_turns, count(*) FILTER (role = 'user') AS n_user, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id"


def order_total(spark: SparkSession, sf: str) -> DataFrame:
    sums = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_extendedprice")), 2).alias("subtotal"))
    rows = sums.join(table(spark, sf, "orders").select("o_orderkey", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    charge = S.delivery_charge(F.col("subtotal"), F.startswith("o_orderpriority", F.lit("1")))
    return rows.select("o_orderkey", "subtotal", charge.alias("delivery"), F.round(F.col("subtotal") + charge, 2).alias("grand_total"))


ORDER_TOTAL = """WITH s AS (SELECT l_orderkey AS o_orderkey, round(sum(l_quantity * l_extendedprice), 2) AS subtotal FROM lineitem GROUP BY l_orderkey),
    d AS (SELECT o_orderkey, subtotal, CASE WHEN starts_with(o_orderpriority, '1') AND subtotal >= 5000 THEN 0.0::DOUBLE WHEN starts_with(o_orderpriority, '1') THEN 80.0::DOUBLE ELSE 150.0::DOUBLE END AS delivery FROM s JOIN orders USING (o_orderkey))
    SELECT o_orderkey, subtotal, delivery, round(subtotal + delivery, 2) AS grand_total FROM d"""


def eval_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled documents that the searchable part of the corpus lacks."""
    known = table(spark, sf, "documents").where("n_chars >= 1000").select("doc_id")
    return C.delete(table(spark, sf, "labels"), known, "doc_id").select("doc_id", "quality")


EVAL_OVERLAP = "SELECT doc_id, quality FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents WHERE n_chars >= 1000)"

_NAMES = (
    "browse relaxed_search lexical_score semantic_gates evidence_score recommend restock business_priority bundle alternatives cross_sell variant_siblings sync_diff stale_rows upsert_actions catalog_audit "
    "funnel dropoff feedback_report worst_intents preferences escalation rate_limit regression_diff family_summary session_state order_total eval_overlap"
).split()
QUERIES = {f"q_{n}": (globals()[n], globals()[n.upper()]) for n in _NAMES}
