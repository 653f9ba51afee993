"""Registered queries of specifications and the product ontology, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import specs
from ..operators import ontology as O
from ..operators import wishes as W
from ..sources.tables import table

#: What sellers write; parts have no such facts.
VALUES = (
    "Yes", "off", "Disabled", "unsupported", "N", "Passive isolation", "not supported", "built-in", "Active ANC", "phone-connected GPS", "multi-band GPS", "no gps", "Wi-Fi 6 mesh", "wifi 5", "2.4GHz dongle", "USB-C hub", "type c, xlr",
    "IPX4 splash", "not water proof", "OLED 144 Hz", "60 Hz", "120hz", "without anc", " ... ", "none at all", "Enabled", "y", "leather", "3.5mm jack", "resistant, passive",
)
KEYS = (*specs.SPEC_WORDS, "high_refresh_support", "stylus_support")


def spec_support(spark: SparkSession, sf: str) -> DataFrame:
    said = F.element_at(F.array(*[F.lit(v) for v in VALUES], F.lit(None)), F.expr(f"cast(p_partkey % {len(VALUES) + 1} + 1 as int)"))
    return table(spark, sf, "part").select("p_partkey", *[specs.spec_bool(said, k).alias(k) for k in KEYS])


def _has(*words: str) -> str:
    return "(" + " OR ".join(f"contains(n, '{w}')" for w in words) + ")"


_SUPPORT = {
    "anc_support": f"NOT {_has('passive', 'none', 'no anc', 'without anc')} AND {_has('active', 'anc', 'noise cancel', 'mic filtering')}",
    "gps_support": f"NOT {_has('none', 'no gps', 'without gps')} AND {_has('gps', 'built in', 'built-in', 'phone connected', 'phone-connected', 'multi band', 'multi-band')}",
    "built_in_gps_support": f"NOT {_has('phone connected', 'phone-connected', 'none', 'no gps')} AND {_has('built in', 'built-in', 'multi band', 'multi-band', 'gps')}",
    "wireless_support": _has("wireless", "bluetooth", "wi-fi", "wifi", "2 4ghz", "5g", "cellular"),
    "wired_support": _has("wired", "usb", "type c", "xlr", "ethernet", "hdmi", "3 5mm", "lan"),
    "usb_input": _has("usb", "type c"),
    "usb_c_input": _has("usb-c", "usb c", "type c"),
    "xlr_input": _has("xlr"),
    "water_resistance_support": f"NOT {_has('none', 'not water', 'no water')} AND {_has('water', 'splash', 'ipx', 'atm', 'resistant')}",
    "oled_support": _has("oled"),
    "wifi6_support": _has("wi-fi 6", "wifi 6", "wifi6", "ax"),
    "mesh_support": _has("mesh"),
    "high_refresh_support": "coalesce(TRY_CAST(nullif(regexp_extract(lower(v), '-?[0-9]+(?:\\.[0-9]+)?'), '') AS DOUBLE) >= 120, FALSE)",
    "stylus_support": "TRUE",
}
_ALWAYS = """WHEN n IN ('0', 'disabled', 'false', 'n', 'no', 'none', 'not supported', 'off', 'passive', 'passive isolation', 'unsupported') THEN FALSE
      WHEN n IN ('1', 'active', 'available', 'built in', 'built-in', 'enabled', 'included', 'on', 'supported', 'true', 'y', 'yes') THEN TRUE"""
SPEC_SUPPORT = rf"""WITH v AS (SELECT p_partkey, [{", ".join(f"'{x}'" for x in VALUES)}, NULL][p_partkey % {len(VALUES) + 1} + 1] AS v FROM part),
    n AS (SELECT *, trim(regexp_replace(regexp_replace(lower(v), '[^a-z0-9\s+-]', ' ', 'g'), '\s+', ' ', 'g')) AS n FROM v)
    SELECT p_partkey, {", ".join(f"CASE WHEN v IS NULL OR n = '' THEN NULL {_ALWAYS} ELSE {_SUPPORT[k]} END AS {k}" for k in KEYS)} FROM n"""

#: Kinds of parts by their names' words.
KINDS = O.Ontology(
    synonyms={"ring": ("ring", "small ring"), "plate": ("plate", "hot plate", "cold plate"), "gizmo": ("gizmo", "new gizmo"), "widget": ("widget", "red widget", "widgets"), "hardware": ("bolt", "rod", "gear"), "novelty": ("new", "economy"), "anvil": ("anvil", "large anvil")},
    families={"ring": "trinkets", "gizmo": "gadgets", "widget": "gadgets", "hardware": "metal", "plate": "metal", "anvil": "metal"},
    categories={"ring": "PROMO", "widget": "ECONOMY", "anvil": "LARGE", "novelty": "Medium"},
    sold_with={"ring": ("gizmo",), "anvil": ("hardware", "plate"), "widget": ("gizmo", "novelty")},
    signals=(("novelty", "promo", ("new", "red"), 4),),
)


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    parts = table(spark, sf, "part").withColumn("tags", F.array(F.lower("p_type"), F.split("p_name", " ")[0]))
    return O.detect(parts, KINDS, "p_name", "p_type", "p_brand", "tags", [])


def ontology_types(spark: SparkSession, sf: str) -> DataFrame:
    rows = _typed(spark, sf)
    return rows.select("p_partkey", "product_type", KINDS.map(KINDS.families, F.col("product_type")).alias("family"), O.relation_score(KINDS, "widget", F.col("product_type"), F.col("p_type")).alias("relation"))


def _points(kind: str, first: str, *more: str) -> str:
    """The points of a type's phrases, one after the other."""

    def bonus(s: str) -> str:
        return f"CASE WHEN {_held('name', s)} THEN 2 ELSE 0 END + CASE WHEN {_held('kind', s)} THEN 2 ELSE 0 END + CASE WHEN {_held('brand', s)} THEN 1 ELSE 0 END + CASE WHEN {_held('tag1', s)} OR {_held('tag2', s)} THEN 3 ELSE 0 END"

    points = "0"
    for s in (first, *more):
        points = f"CASE WHEN {_held('words', s)} THEN greatest({points}, {3 * len(s.split())}) + {bonus(s)} ELSE {points} END"
    own = {"ring": "promo", "widget": "economy", "anvil": "large", "novelty": "medium"}.get(kind)
    return f"{points} + CASE WHEN tag1 = '{kind}' OR tag2 = '{kind}' THEN 3 ELSE 0 END" + (f" + CASE WHEN kind = '{own}' THEN 2 ELSE 0 END" if own else "") + (" + CASE WHEN tag1 = 'promo' AND tag2 IN ('new', 'red') THEN 4 ELSE 0 END" if kind == "novelty" else "")


def _held(text: str, phrase: str) -> str:
    return f"contains({text}, '{phrase}')" if " " in phrase else rf"regexp_matches({text}, '\b{phrase}\b')"


_ORDER = (("ring", "ring", "small ring"), ("plate", "plate", "hot plate", "cold plate"), ("gizmo", "gizmo", "new gizmo"), ("widget", "widget", "red widget", "widgets"), ("hardware", "bolt", "rod", "gear"), ("novelty", "new", "economy"), ("anvil", "anvil", "large anvil"))
_TYPED = f"""d AS (SELECT *, lower(p_name) AS name, lower(p_type) AS kind, replace(lower(p_brand), '#', ' ') AS brand, lower(p_type) AS tag1, split_part(p_name, ' ', 1) AS tag2 FROM part), w AS (SELECT *, name || ' ' || kind || ' ' || brand || ' ' || tag1 || ' ' || tag2 AS words FROM d),
    s AS (SELECT *, list_sort(list_filter([{", ".join(f"{{'p': CAST({_points(*t)} AS INTEGER), 'r': {-i}, 't': '{t[0]}'}}" for i, t in enumerate(_ORDER))}], lambda x: x.p > 0), 'DESC')[1].t AS product_type FROM w)"""
ONTOLOGY_TYPES = f"""WITH {_TYPED} SELECT p_partkey, product_type, CASE WHEN product_type = 'ring' THEN 'trinkets' WHEN product_type IN ('gizmo', 'widget') THEN 'gadgets' WHEN product_type IN ('hardware', 'plate', 'anvil') THEN 'metal' END AS family,
    CASE WHEN product_type = 'widget' THEN 3 WHEN product_type = 'gizmo' THEN 2 WHEN p_type = 'ECONOMY' THEN 1 ELSE 0 END AS relation FROM s"""


def ontology_cross_sell(spark: SparkSession, sf: str) -> DataFrame:
    """For every part what is sold with it: how many parts, and the three dearest of them by turns."""
    found = O.cross_sells(_typed(spark, sf), KINDS, "product_type", [F.desc("p_retailprice")], "p_partkey", 3)
    return found.select("p_partkey", "n_cross_sell", F.array_join(F.transform("cross_sell", lambda k: k.cast("string")), ",").alias("cross_sell"))


ONTOLOGY_CROSS_SELL = f"""WITH {_TYPED}, c AS (SELECT * FROM (VALUES ('ring', 'gizmo'), ('gizmo', 'ring'), ('anvil', 'hardware'), ('hardware', 'anvil'), ('anvil', 'plate'), ('plate', 'anvil'), ('widget', 'gizmo'), ('gizmo', 'widget'), ('widget', 'novelty'), ('novelty', 'widget')) x(a, b)),
    r AS (SELECT product_type, p_partkey, row_number() OVER (PARTITION BY product_type ORDER BY p_retailprice DESC, p_partkey) AS place FROM s WHERE product_type IS NOT NULL),
    m AS (SELECT a, count(*) AS n, list(CAST(p_partkey AS VARCHAR) ORDER BY place, b, p_partkey) AS best FROM c JOIN r ON r.product_type = c.b GROUP BY a)
    SELECT p_partkey, coalesce(n, 0) AS n_cross_sell, array_to_string(best[1:3], ',') AS cross_sell FROM s LEFT JOIN m ON m.a = s.product_type"""

#: A wish for parts, with a column and an SQL condition for each slot, and what each counts.
_WISH = {
    "kind": ("p_type = 'PROMO'", 3.0), "size": ("p_size >= 25", 2.0), "budget": ("p_retailprice <= 1400", 2.5), "colour": ("p_name LIKE '%red%' OR p_name LIKE '%blue%'", 1.5), "maker": ("p_brand IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#12')", 1.0),
    "thing": ("p_name LIKE '%ring%'", 0.5),
}


def _slots() -> dict:
    return {n: F.expr(c) for n, (c, _) in _WISH.items()}


def wish_relaxations(spark: SparkSession, sf: str) -> DataFrame:
    return W.relaxations(table(spark, sf, "part"), _slots())


def _subset(mask: int) -> str:
    names = [n for i, n in enumerate(_WISH) if mask >> i & 1]
    where = " AND ".join(f"({_WISH[n][0]})" for n in names) or "TRUE"
    return f"SELECT {mask} AS kept, '{','.join(names)}' AS slots, {len(names)} AS n_slots, count(*) AS items FROM part WHERE {where}"


WISH_RELAXATIONS = " UNION ALL ".join(_subset(m) for m in range(1 << len(_WISH)))


def wish_top(spark: SparkSession, sf: str) -> DataFrame:
    """The best parts for the wish, within the budget."""
    found = W.best(table(spark, sf, "part"), _slots(), {n: w for n, (_, w) in _WISH.items()}, [F.col("p_retailprice"), F.col("p_partkey")], 25, ("budget",))
    return found.select("p_partkey", "score", "missed")


WISH_TOP = f"""SELECT p_partkey, round({" + ".join(f"CASE WHEN {c} THEN {w}::DOUBLE ELSE 0 END" for c, w in _WISH.values())}, 6) AS score,
    array_to_string(list_filter([{", ".join(f"CASE WHEN NOT ({c}) THEN '{n}' END" for n, (c, _) in _WISH.items())}], lambda x: x IS NOT NULL), ',') AS missed FROM part WHERE {_WISH["budget"][0]} ORDER BY score DESC, p_retailprice, p_partkey LIMIT 25"""

QUERIES = {f"q_{n}": (globals()[n], globals()[n.upper()]) for n in ("spec_support", "ontology_types", "ontology_cross_sell", "wish_relaxations", "wish_top")}
