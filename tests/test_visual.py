"""Decisions on pictures, case by case."""

from marlstone.operators import visual


def decided(spark, rows, k=5):
    """rows: (product, score, channels, stock, category, kind, is_reference) of one question."""
    hits = spark.createDataFrame([(1, *r) for r in rows], "question int, product string, score double, channels array<string>, stock int, category string, kind string, is_reference boolean")
    return [(r["product"], r["label"], r["gate"]) for r in visual.decide(hits, k).orderBy("place").collect()]


FULL = ["full_visual", "pattern_visual"]


def test_labels_gates_and_order(spark):
    clear = ("a", 0.95, FULL, 3, "saree", "product_photo", False)
    assert decided(spark, [clear, ("b", 0.84, FULL, 0, "saree", "product_photo", False), ("c", 0.5, FULL, 1, None, None, None), ("d", 0.1, FULL, 1, "saree", None, True)]) == [
        ("a", "confirmed_exact", None), ("b", "likely_same_design", None), ("d", "no_confident_match", None),
    ]
    near = ("b", 0.93, FULL, 0, "saree", "product_photo", False)
    assert decided(spark, [clear, near])[0] == ("a", "likely_same_design", "thin_top_margin")
    assert decided(spark, [("a", 0.95, ["text_visual_tags"], 3, "x", "product_photo", False)]) == [("a", "likely_same_design", "no_visual_channel")]
    assert decided(spark, [("a", 0.95, ["pattern_visual"], 3, "x", "product_photo", False)]) == [("a", "likely_same_design", "pattern_only")]
    assert decided(spark, [("a", 0.99, FULL, 3, "x", "drawing", False), ("b", 0.97, FULL, 3, "x", "product_photo", True)]) == [("a", "similar_style", None), ("b", "similar_style", None)]
    assert decided(spark, [("a", 0.1, FULL, None, None, None, None)]) == [("a", "no_confident_match", None)]


def test_a_photo_beats_a_reference_that_is_hardly_better(spark):
    rows = [("ref", 0.83, FULL, 1, "x", "product_photo", True), ("own", 0.825, FULL, 1, "x", "product_photo", False), ("sold", 0.826, FULL, 0, "x", "product_photo", False)]
    assert [p for p, *_ in decided(spark, rows)] == ["own", "sold", "ref"] and len(decided(spark, rows, 2)) == 2


def test_best_vectors(spark):
    vectors = spark.createDataFrame([("p", "full_visual", [1.0, 0.0]), ("p", "pattern_visual", [0.0, 1.0]), ("q", "full_visual", [1.0, 1.0]), ("q", "full_visual", [0.0, 0.0]), ("z", "full_visual", [1.0, 0.0])], "product string, channel string, embedding array<double>")
    queries = spark.createDataFrame([(1, "full_visual", [2.0, 0.0]), (1, "pattern_visual", [1.0, 1.0])], "question int, channel string, embedding array<double>")
    products = spark.createDataFrame([("p", 1, "c", "k", False), ("q", None, "c", "k", False), ("z", 0, "c", "k", False)], "product string, stock int, category string, kind string, is_reference boolean")
    got = {r["product"]: (r["score"], r["channels"]) for r in visual.best_vectors(vectors, queries, products).collect()}
    assert got == {"p": (1.0, ["full_visual", "pattern_visual"]), "q": (0.7071, ["full_visual"]), "z": (0.3, ["full_visual"])}
