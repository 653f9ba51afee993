"""Copies and long chains of near-duplicates against brute force."""

from marlstone.operators import documents
from marlstone.operators.shared import checkpoints


def test_copies_are_listed_and_dropped(spark):
    checkpoints(spark)
    words = [f"w{i}" for i in range(40)]
    texts = [words, words[::-1], words[1:], words[2:], words[5:], words[1:] * 2, [], words[9:]]
    rows = [(i, g, " ".join(t)) for g in "gh" for i, t in enumerate(texts, 100 * (g == "h"))]
    docs = spark.createDataFrame(rows, "id long, grp string, t string")
    assert {tuple(r) for r in documents.copies(docs, "id", "grp", "t").collect()} == {("g", 1, 0), ("g", 5, 2), ("h", 101, 100), ("h", 105, 102)}
    kept: list = []
    dropped = set()
    for i, g, t in rows:
        s = set(t.split())
        if s and any(g == h and len(s & u) >= 0.82 * len(s | u) for h, u in kept):
            dropped.add(i)
        elif s:
            kept.append((g, s))
    got = [r["id"] for r in documents.keep_first(docs, "id", "grp", "t").collect()]
    assert sorted(got) == sorted(dropped) and {1, 5} <= dropped


def test_chain_of_more_than_fifty(spark):
    checkpoints(spark)
    pairs = spark.createDataFrame([(i, i + 1) for i in range(60)], "a long, b long").coalesce(1)
    assert sorted(r[0] for r in documents.greedy_keep(pairs).collect()) == list(range(1, 61, 2))
