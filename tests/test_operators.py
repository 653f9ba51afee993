"""Operators that the registered queries don't reach, on small rows made here."""

import json

import pytest
from pyspark.sql import functions as F

from marlstone.functions import scores, text
from marlstone.operators import analytics, catalog, documents, filters, search
from marlstone.operators.shared import checkpoints
from marlstone.sources import sinks, tables
from marlstone.streaming import funnel


def test_jsonl_strict_and_tolerant(spark, tmp_path):
    path = tmp_path / "e.jsonl"
    path.write_text('{"event":"shown","session_id":"a","product_ids":["p"]}\n\n{broken\n{"event":"ordered","session_id":"b"}\n')
    rows = tables.read_jsonl(spark, str(path), tables.EVENT, strict=False).collect()
    assert [r["event"] for r in rows] == ["shown", "ordered"] and rows[1]["product_ids"] is None
    with pytest.raises(Exception):
        tables.read_jsonl(spark, str(path), tables.EVENT).collect()


def test_folders_of_documents_and_graphs(spark, tmp_path):
    for d in ("a", "b"):
        (tmp_path / d / "chunks").mkdir(parents=True)
        (tmp_path / d / "chunks" / "c.jsonl").write_text(json.dumps({"chunk_id": f"{d}1", "text": "x"}) + "\n")
    rows = tables.read_documents(spark, str(tmp_path), "chunks/c.jsonl", tables.CHUNK)
    assert sorted((r["document_folder"], r["chunk_id"]) for r in rows.collect()) == [("a", "a1"), ("b", "b1")]
    graph = {"nodes": [{"node_id": "n", "document_id": "d", "node_type": "act"}, {"node_id": "m", "document_id": "d", "node_type": "clause", "parent_id": "n"}], "links": [{"source_node_id": "m", "target_node_id": "n", "relation": "PARENT_CONTEXT"}]}
    (tmp_path / "g.json").write_text(json.dumps(graph, indent=1))
    nodes, links = tables.read_graph(spark, str(tmp_path / "g.json"))
    assert nodes.count() == 2 and links.count() == 1
    sinks.write_document(nodes, links, str(tmp_path / "out"), ["act"])
    assert spark.read.parquet(str(tmp_path / "out/parent_nodes")).count() == 1 == spark.read.parquet(str(tmp_path / "out/retrieval_nodes")).count()


def test_last_row_and_later_file_win(spark, tmp_path):
    rows = spark.createDataFrame([("p", 1, 5.0), ("p", 2, None), ("q", 1, 1.0)], "id string, line int, price double")
    assert sorted(map(tuple, tables.last_wins(rows, ["id"], ["line"]).collect())) == [("p", 2, None), ("q", 1, 1.0)]
    later = spark.createDataFrame([("q", 9, 9.0)], "id string, line int, price double")
    assert {r["id"]: r["line"] for r in tables.merge_sources([rows.where("line = 1"), later], "id").collect()} == {"p": 1, "q": 9}
    sinks.write_jsonl(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    assert [r["line"] for r in tables.tail(rows, ["line", "id"], 2).collect()] == [1, 2]
    assert {r["line"] for r in tables.first_of_each(rows, ["id"], ["line"]).collect()} == {1}


def test_csv_aliases_and_webhook(spark, tmp_path):
    (tmp_path / "p.csv").write_text("id,SKU,product_name,price,quantity,tags,color\n1,s1,Red,10.5,3,\"a, b,\",red\n2,,No key,1,1,,\n3,s3,Bad,x,y,,\n")
    rows = {r["product_id"]: r for r in tables.read_products_csv(spark, str(tmp_path / "p.csv")).collect()}
    assert set(rows) == {"1", "3"} and rows["1"]["tags"] == ["a", "b"] and rows["1"]["attributes"] == {"color": "red"}
    assert rows["3"]["price"] == 0 and rows["3"]["stock"] == 0 and rows["3"]["attributes"] == {}
    hook = spark.createDataFrame([(json.dumps({"event": "stock_updated", "items": [{"sku": "s1", "stock": 0}, {"sku": "s2", "price": 2.5}]}),)], "payload string")
    items = tables.read_webhook(hook)
    assert items.count() == 2
    stock = spark.createDataFrame([("s1", 4, 1.0), ("s9", 1, 1.0)], "sku string, stock int, price double")
    assert sorted(map(tuple, catalog.patch(stock, items, "sku", ["stock", "price"]).collect())) == [("s1", 0, 1.0), ("s9", 1, 1.0)]
    assert sorted(map(tuple, catalog.upsert(stock, spark.createDataFrame([("s1", 7, 7.0)], stock.schema), "sku").collect())) == [("s1", 7, 7.0), ("s9", 1, 1.0)]


def test_filters(spark):
    rows = spark.createDataFrame([(1, "a", None, {"year": "2023"}), (2, "b", 5, {}), (3, None, 9, None)], "id int, kind string, n int, meta map<string,string>")
    ids = lambda f: sorted(r["id"] for r in filters.apply(rows, f, "meta").collect())
    assert ids({"kind": None}) == [3] and ids({"n": {"$gte": 5, "$lte": 8}}) == [2] and ids({"kind": ["a", "b"]}) == [1, 2]
    assert ids({"year": "2023"}) == [1] and ids({}) == [1, 2, 3]
    with pytest.raises(ValueError):
        filters.apply(rows, {"n": {"$near": 1}})
    with pytest.raises(ValueError):
        filters.apply(rows, {"nowhere": 1})
    assert filters.keep_or_all(rows, F.col("n") > 100).count() == 3 and filters.keep_or_all(rows, F.col("n") > 5).count() == 1
    found = filters.relaxed(rows, F.col("id") > 0, [F.col("kind") == "a", F.col("n") == 9]).collect()
    assert [(r["id"], r["level"]) for r in found] == [(3, 1)]


def test_text_functions(spark):
    row = spark.createDataFrame([("Hi there. You? Yes!\nSection 12.3 and article 7; 2023 or 4.5.6", "<p>a<script>x<b></script> b</p>")], "t string, h string")
    got = row.select(text.sentences(F.col("t")), text.section_references(F.col("t")), text.strip_markup(F.col("h")), text.count_vector(F.col("t"), ["yes", "e"])).first()
    assert got[0] == ["Hi there.", "You?", "Yes!", "Section 12.3 and article 7; 2023 or 4.5.6"]
    assert got[1] == ["12.3", "7", "4.5.6"] and got[2] == "a b" and got[3][0] == 1
    assert row.select(text.overlap_ratio(F.array(F.lit("a"), F.lit("b")), F.array(F.lit("b"), F.lit("c")))).first()[0] == pytest.approx(1 / 3)
    q = spark.createDataFrame([("",), (None,), ("12 (3) / 4",), ("A proper sentence with a good many words in it, which goes on for quite some while. " * 4,)], "t string").select(text.quality_score(F.col("t"))).collect()
    assert q[0][0] == q[1][0] == q[2][0] == 0 and q[3][0] > 0.95


def test_scores(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(scores.stock_pressure(F.lit(None).cast("int"))) == 0.35 and value(scores.stock_pressure(F.lit(2))) == 0.95
    assert value(scores.availability(F.lit(5), F.lit(10))) == pytest.approx(0.725) and value(scores.share_of_max(F.lit(3), F.lit(0))) == 0
    assert value(scores.price_fit(F.lit(50.0), 100.0, 200.0)) == 0.5 and value(scores.price_fit(F.lit(300.0), 100.0, 200.0)) == 0.5
    assert value(scores.authority_value(F.lit("Statute"))) == 4 and value(scores.authority_value(F.lit("none"))) == 0
    assert value(scores.answer_confidence(F.lit(5.0), F.lit(3), F.lit(True), F.lit(0))) == pytest.approx(0.95)
    assert value(scores.delivery_charge(F.lit(5000.0), F.lit(True))) == 0 and value(scores.delivery_charge(F.lit(10.0), F.lit(False))) == 150


def test_near_duplicates_are_kept_greedily(spark):
    checkpoints(spark)
    pairs = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (10, 11), (10, 12), (11, 12)], "a long, b long")
    assert sorted(r[0] for r in documents.greedy_keep(pairs).collect()) == [2, 4, 11, 12]


def test_overlapping_equals_brute_force(spark):
    import random

    random.seed(1)
    base = [[f"w{random.randrange(60)}" for _ in range(30)] for _ in range(12)]
    rows = [(i, "g" if i % 2 else "h", " ".join(w if random.random() > 0.05 else f"x{random.randrange(99)}" for w in base[i % 12])) for i in range(150)] + [(999, "g", None), (998, "g", "")]
    got = {(r["a"], r["b"]) for r in documents.overlapping(spark.createDataFrame(rows, "id long, grp string, t string"), "id", "grp", "t").collect()}
    sets: dict = {}
    for i, g, t in rows:
        if t:
            sets.setdefault((g, frozenset(t.split())), i)
    items = sorted((i, g, s) for (g, s), i in sets.items())
    want = {(i, j) for i, g, s in items for j, h, u in items if i < j and g == h and len(s & u) / len(s | u) >= 0.82}
    assert got == want and len(want) > 20


def test_packed_segments(spark):
    rows = spark.createDataFrame([(1, "a b c\nd e\nf\n\ng h i j k l m n"), (2, None), (3, "x")], "id long, t string")
    got = {(r["id"], r["piece"]): r["chunk"] for r in documents.packed_segments(rows, "id", "t", 2, 4, 6).collect()}
    assert got == {(1, 0): "a b c d e", (1, 1): "f", (1, 2): "g h i j k l", (1, 3): "m n", (3, 0): "x"}
    assert all(len(c.split()) <= 6 for c in got.values())
    lines = spark.createDataFrame([("d", 1, "H1"), ("d", 2, None), ("d", 3, "H2"), ("d", 4, None)], "doc string, n int, head string")
    assert [r["heading"] for r in documents.carried_heading(lines, "doc", "n", F.col("head")).orderBy("n").collect()] == ["H1", "H1", "H2", "H2"]


def test_reranking_that_adds(spark):
    hits = spark.createDataFrame([(1, 5.0, 1, "none"), (2, 4.0, 2, "alpha beta"), (3, 3.9, 3, "alpha")], "id long, score double, rank int, t string")
    order = lambda **k: [r["id"] for r in search.rerank(hits, "t", ["alpha", "beta"], 2, "id", **k).orderBy("rank").collect()]
    assert order() == [2, 1, 3] and order(replace=False) == [2, 1, 3]


def test_bm25_prefers_the_shorter_and_the_rarer(spark):
    docs = spark.createDataFrame([(1, "tax rate"), (2, "tax rate and many more words to make it long"), (3, "tax law"), (4, "other words"), (5, "rate of nothing"), (6, None), (7, "x"), (8, "y")], "id long, t string")
    hits = search.Bm25(docs, "id", "t").search(["rate", "law"], 10).orderBy("rank").collect()
    assert hits[0]["id"] == 3 and [h["id"] for h in hits].index(1) < [h["id"] for h in hits].index(2) and {h["id"] for h in hits} == {1, 2, 3, 5}


def test_stream_changes_and_streaks(spark, tmp_path):
    for k, rows in enumerate([[("a", 1, 1), ("b", 1, 1)], [("a", 2, 7), ("c", 1, 3), ("a", 1, 0)]]):
        spark.createDataFrame(rows, "id string, at int, v int").coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    stream = spark.readStream.schema("id string, at int, v int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))
    funnel.apply_changes(stream, str(tmp_path / "out"), "id", "at")
    assert {r["id"]: r["v"] for r in funnel.current_rows(spark, str(tmp_path / "out")).collect()} == {"a": 7, "b": 1, "c": 3}
    events = spark.createDataFrame([("u", 1, True), ("u", 2, True), ("u", 3, False), ("u", 4, True), ("w", 1, False)], "k string, n int, bad boolean")
    assert [tuple(r) for r in analytics.streaks(events, "k", ["n"], F.col("bad")).collect()] == [("u", 2, 2)]


def test_embedders(spark):
    from marlstone.functions import embedders

    df = spark.createDataFrame([("red silk red",), (None,), ("red silk red",)], "t string")
    rows = df.select(embedders.build_embedder("hash", 16)(F.col("t")).alias("v"), embedders.build_embedder("keyword", ["red", "silk"])(F.coalesce("t", F.lit(""))).alias("k")).collect()
    assert rows[0]["v"] == rows[2]["v"] != rows[1]["v"] and sum(x * x for x in rows[0]["v"]) == pytest.approx(1, abs=1e-5)
    assert rows[0]["k"] == [2.0, 1.0] and rows[1]["k"] == [0.0, 0.0]
    with pytest.raises(ValueError):
        embedders.build_embedder("none")
    got = spark.range(1).select(embedders.blend(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(1.0)), 0.5).alias("b"), embedders.unit(F.array(F.lit(0.0))).alias("z"), embedders.sigmoid(F.lit(0.0)).alias("s")).first()
    assert got["b"] == pytest.approx([0.5**0.5] * 2) and got["z"] == [0.0] and got["s"] == 0.5


def test_question_functions(spark):
    from marlstone.functions import questions as q

    text = F.col("t")
    rows = spark.createDataFrame([("What is the definition of income?",), ("How many (a) one (b) two",), ("Compare the rate of 5% and Taka 300 lakh by 30th day of June",), ("২০২৩",)], "t string")
    got = rows.select(q.question_kind(text).alias("k"), q.phrases(text, q.AMOUNTS).alias("a"), q.phrases(text, q.DATES).alias("d"), q.enumerated_items(text).alias("n"), q.normalize_digits(text).alias("x"), q.language(text).alias("l")).collect()
    assert [g["k"] for g in got] == ["definition", "count_lookup", "comparison", "general"] and got[1]["n"] == 2
    assert got[2]["a"] == ["taka 300 lakh", "5%"] and got[2]["d"] == ["30th day of june"] and got[3]["x"] == "2023" and got[3]["l"] == "bn"
    years = spark.createDataFrame([("2023-2024",), ("soon",)], "y string").select(q.tax_year_range(F.col("y")).alias("r")).collect()
    assert str(years[0]["r"]["start"]) == "2023-07-01" and str(years[0]["r"]["end"]) == "2024-06-30" and years[1]["r"] is None
    assert rows.select(q.spec_number(F.lit("2 TB"), "storage_gb")).first()[0] == 2048 and rows.select(q.truncate(F.lit("abc def"), 4)).first()[0] == "abc..."


def test_written_index_answers_alike(spark, tmp_path, sf):
    index = search.Bm25(tables.table(spark, sf, "documents"), "doc_id", "text")
    sinks.write_index(index.postings(), index.vocabulary(), index.statistics(), str(tmp_path))
    terms = ["was", "thing", "thing"]
    assert [tuple(r) for r in search.search_index(spark, str(tmp_path), terms, 7, "doc_id").orderBy("rank").collect()] == [tuple(r) for r in index.search(terms, 7).orderBy("rank").collect()]
