"""Changing indexes against rebuilt ones, and counts of relaxed wishes against plain counting."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.operators import postings, wishes
from marlstone.operators.segments import SegmentedIndex


def held(index, asked, **how):
    return {(r["question"], r["key"], round(r["score"], 6), r["rank"]) for r in index.search(asked, 6, **how).collect()}


def rebuilt(spark, docs, asked):
    table = spark.createDataFrame(sorted(docs.items()), "key long, text string")
    return {(r["question"], r["key"], round(r["score"], 6), r["rank"]) for r in postings.search(postings.build(table, "key", "text"), asked, 6).collect()}


def test_changes_equal_a_rebuilt_index(spark, tmp_path):
    """Additions, replacements, removals, unknown and repeated keys, texts without terms; a reader of a version sees that version; compaction changes nothing."""
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(40)]
    text = lambda: " ".join(rng.choice(words, size=int(rng.integers(0, 12))))
    asked = spark.createDataFrame([(q, " ".join(rng.choice(words, size=3))) for q in range(12)] + [(99, "unknown")], "question int, text string")
    index = SegmentedIndex(spark, str(tmp_path / "index"))
    assert held(index, asked) == set() and index.latest() == (0, [])
    docs, states = {}, []
    for turn in range(4):
        fresh = {int(k): text() for k in rng.choice(120, size=50, replace=False)}
        if turn == 1:
            fresh[121] = None
        index.upsert(spark.createDataFrame([(k, v) for k, v in fresh.items()] + [(None, "w1")], "key long, text string").repartition(3))
        docs |= fresh
        gone = [int(k) for k in rng.choice(140, size=15, replace=False)]
        states.append((index.delete(spark.createDataFrame([(k,) for k in gone * 2], "key long")), dict(docs := {k: v for k, v in docs.items() if k not in gone})))
    assert held(index, asked) == rebuilt(spark, docs, asked) != set()
    assert held(index, asked, version=states[1][0]) == rebuilt(spark, states[1][1], asked)
    last = index.compact()
    assert index.latest() == (last, [last]) and held(index, asked) == rebuilt(spark, docs, asked)
    assert held(index, asked, version=states[2][0]) == rebuilt(spark, states[2][1], asked)
    rows = index.vocabulary().collect()
    assert {r["term"]: r["df"] for r in rows} == {w: n for w in words if (n := sum(w in (t or "").split() for t in docs.values()))}


def test_a_change_that_fails_is_not_seen(spark, tmp_path):
    """A segment without its row in the manifest belongs to no version and is written over; of two writers of one version one fails."""
    one = spark.createDataFrame([(1, "a b"), (2, "b"), (4, "c"), (5, "d"), (6, "d"), (8, "e")], "key long, text string")
    asked = spark.createDataFrame([(0, "a")], "question int, text string")
    index = SegmentedIndex(spark, str(tmp_path / "index"))
    index.upsert(one)
    spark.createDataFrame([(7, "a", 1, 1, True)], "key long, term string, tf long, dl int, lead boolean").write.parquet(str(tmp_path / "index/segment-0000000002/counted"))
    assert {k for _, k, *_ in held(index, asked)} == {1}
    assert index.upsert(spark.createDataFrame([(3, "a")], "key long, text string")) == 2 and {k for _, k, *_ in held(index, asked)} == {1, 3}
    index.latest = lambda: (1, [1])
    with pytest.raises(Exception, match="already exists"):
        index.delete(one)


def test_relaxations(spark):
    rng = np.random.default_rng(1)
    rows = [(i, *(None if v > 8 else int(v) for v in rng.integers(0, 10, 4))) for i in range(500)]
    df = spark.createDataFrame(rows, "id int, a int, b int, c int, d int")
    slots = {"a": F.col("a") > 3, "b": F.col("b") < 5, "c": F.col("c") == 1, "d": F.col("d").isin(1, 2, 3)}
    tests = [lambda r: r[1] is not None and r[1] > 3, lambda r: r[2] is not None and r[2] < 5, lambda r: r[3] == 1, lambda r: r[4] in (1, 2, 3)]
    want = {m: sum(all(t(r) for i, t in enumerate(tests) if m >> i & 1) for r in rows) for m in range(16)}
    found = wishes.relaxations(df, slots)
    assert {r["kept"]: r["items"] for r in found.collect()} == want
    assert {r["slots"]: r["n_slots"] for r in found.collect()}["a,c,d"] == 3
    assert [r["n_slots"] for r in wishes.least_relaxed(found, 501).collect()] == []
    assert {r["kept"] for r in wishes.least_relaxed(found).collect()} == {m for m in want if want[m] and bin(m).count("1") == max(bin(x).count("1") for x in want if want[x])}
    assert {r["items"] for r in wishes.relaxations(df.where("false"), slots).collect()} == {0}
    top = wishes.best(df, slots, {"a": 1.0, "b": 2.0, "c": 4.0}, [F.col("id")], 10, ("d",)).collect()
    score = lambda r: sum(w for t, w in zip(tests, (1.0, 2.0, 4.0, 0.0), strict=True) if t(r))
    assert [r["id"] for r in top] == [r[0] for r in sorted((r for r in rows if tests[3](r)), key=lambda r: (-score(r), r[0]))[:10]]
    with pytest.raises(ValueError):
        wishes.met({})
