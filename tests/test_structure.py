"""Document trees, records and profiles on small rows."""

from pyspark.sql import functions as F

from marlstone.functions import pages
from marlstone.operators import ranking, records, structure

LINES = ["Preface", "Part I", "Chapter 1", "1. Title. Words", "more words", "(1) first", "(a) clause a", "(b) clause b", "(2) second", "2. Next", "Chapter 2", "3. Last"]


def test_build_structure(spark):
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(LINES)] + [("e", 0, "no heading"), ("e", 1, None)], "doc string, n int, t string")
    nodes = structure.build_structure(lines, "doc", "n", "t")
    got = {(r["doc"], r["node"]): (r["parent"], r["node_type"], r["number"]) for r in nodes.collect()}
    assert got["d", 0] == (None, "preamble", None) and got["d", 1] == (None, "part", "i") and got["d", 2] == (1, "chapter", "1")
    assert got["d", 3] == (2, "section", "1") and got["d", 4] == (3, "subsection", "1") and got["d", 5] == got["d", 6][:0] + (4, "clause", "a") and got["d", 6] == (4, "clause", "b")
    assert got["d", 7] == (3, "subsection", "2") and got["d", 8] == (2, "section", "2") and got["d", 9] == (1, "chapter", "2") and got["d", 10] == (9, "section", "3")
    assert got["e", 0] == (None, "preamble", None)
    text = {r["node"]: r["text"] for r in nodes.where("doc = 'd'").collect()}
    assert text[3] == "1. Title. Words\nmore words"
    chunks = structure.section_chunks(nodes, "doc", 1, 2, 3).collect()
    assert all(len(c["chunk"].split()) <= 3 for c in chunks) and {c["key"] for c in chunks} >= {"d#0", "d#10"}


def test_merge_small(spark):
    blocks = spark.createDataFrame([("d", 1, "ab", "p"), ("d", 2, "cd", "p"), ("d", 3, "a long one", "p"), ("d", 4, "x", "p"), ("d", 5, "y", "t")], "doc string, n int, t string, s string")
    assert [r["t"] for r in structure.merge_small(blocks, "doc", "n", "t", F.col("s"), 5).orderBy("block").collect()] == ["ab\ncd\na long one", "x", "y"]


def test_orders_and_waitlist(spark):
    orders = spark.createDataFrame([("o1", "new", None, None, None), ("o2", "dispatched", "t0", "t1", None)], "order_id string, status string, confirmed_at string, dispatched_at string, delivered_at string")
    changes = spark.createDataFrame([("o1", "confirmed", "t5"), ("o2", "dispatched", "t9")], "order_id string, status string, at string")
    got = {r["order_id"]: tuple(r)[1:] for r in records.advance_orders(orders, changes).collect()}
    assert got == {"o1": ("confirmed", "t5", None, None), "o2": ("dispatched", "t0", "t1", None)}
    wait = spark.createDataFrame([("p", "pending"), ("p", "notified"), ("q", "pending")], "product_id string, status string")
    assert sorted(map(tuple, records.mark_notified(wait, spark.createDataFrame([("p",), ("p",)], "product_id string")).collect())) == [("p", "notified"), ("p", "notified"), ("q", "pending")]


def test_profiles(spark):
    old = spark.createDataFrame([("a", ["x", "y", "z", "u"], "m"), ("b", ["q"], None)], "id string, likes array<string>, size string")
    new = spark.createDataFrame([("a", ["y", "n", "o"], None), ("c", None, "l")], "id string, likes array<string>, size string")
    got = {r["id"]: (r["likes"], r["size"]) for r in records.merge_profiles(old, new, "id", ["likes"], ["size"]).collect()}
    assert got == {"a": (["y", "n", "o", "x", "z"], "m"), "b": (["q"], None), "c": ([], "l")}


def test_ranking_pieces(spark):
    one = spark.createDataFrame([("40", "40(1)", "anchor", "40. Heading of it", "x")], "s string, ss string, v string, t string, o string")
    assert one.select(ranking.section_boost(F.col("s"), F.col("ss"), F.col("v"), F.col("t"), "40")).first()[0] == 3.2 + 1.6 + 2.2
    assert one.select(ranking.section_boost(F.col("s"), F.col("ss"), F.col("v"), F.col("t"), "4")).first()[0] == 0
    assert ranking.order_asked("The cheapest one?") == "cheapest" and ranking.order_asked("hello") == "default"
    assert one.select(ranking.rules_score([(F.lit(True), 1.5), (F.lit(None).cast("boolean"), 9.0)], F.lit(1.0))).first()[0] == 2.5
    assert one.select(pages.search_text([F.lit("a"), F.lit(" "), F.lit("b")], twice=1)).first()[0] == "a a b"
    assert one.select(pages.snippet(F.lit(""), F.lit(None).cast("string"), F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))).first()[0] == "a: 1, b: 2"
