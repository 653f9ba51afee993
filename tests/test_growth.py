"""What a step moves and holds as its input grows."""

import numpy as np

from marlstone.operators import documents, postings
from marlstone.operators.shared import checkpoints


def moved(spark, run) -> int:
    """Rows that ``run`` has shuffled, with every exchange that its plan names."""

    def written() -> int:
        context = spark.sparkContext
        context._jsc.sc().listenerBus().waitUntilEmpty()
        stages = context._jsc.sc().statusStore().stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))

    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    held = {name: spark.conf.get(name) for name in plain}
    before = written()
    try:
        for name, value in plain.items():
            spark.conf.set(name, value)
        run()
    finally:
        for name, value in held.items():
            spark.conf.set(name, value)
    return written() - before


def test_near_duplicates_move_what_grows_with_the_input(spark):
    """Sets whose rarest tokens many others share, and few near ones: pairs that can't be near are never moved."""
    checkpoints(spark)
    rng = np.random.default_rng(3)

    def run(n):
        rows = [(i, "g", " ".join(f"w{w}" for w in rng.permutation(150)[:50])) for i in range(n)]
        rows += [(n + i, "g", rows[i][2] + " more") for i in range(0, n, 100)]
        got = documents.overlapping(spark.createDataFrame(rows, "id long, grp string, t string"), "id", "grp", "t").collect()
        assert {(r["a"], r["b"]) for r in got} == {(i, n + i) for i in range(0, n, 100)}

    few, many = moved(spark, lambda: run(200)), moved(spark, lambda: run(800))
    assert many < 4.5 * few, (few, many)


def test_batch_search_moves_neither_pairs_nor_their_postings(spark):
    """Twice the documents and the questions: what is moved grows no faster, though each question meets every document."""
    checkpoints(spark)
    rng = np.random.default_rng(5)

    def run(n):
        docs = spark.createDataFrame([(i, " ".join(f"w{w}" for w in rng.integers(0, 30, 20))) for i in range(n)], "id long, t string").repartition(4)
        asked = docs.where("id % 4 = 0").selectExpr("id AS question", "t AS text")
        assert postings.search(postings.build(docs, "id", "t"), asked, 3).count() == 3 * n // 4

    few, many = moved(spark, lambda: run(400)), moved(spark, lambda: run(1600))
    assert many < 4.5 * few, (few, many)
