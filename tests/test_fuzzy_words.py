"""Corrections of whole words, long ones included."""

from marlstone.plans import QUERIES


def test_long_words_are_whole(spark, tmp_path):
    at = str(tmp_path)
    spark.createDataFrame([("measurement uncertainty reading",)], "text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([("measuremnet uncertaintty readin unrelatedword",)], "text string").write.parquet(f"{at}/conversations.parquet")
    got = {tuple(r) for r in QUERIES["q_fuzzy_words"][0](spark, at).collect()}
    assert got == {("measuremnet", "measurement", 2), ("uncertaintty", "uncertainty", 1), ("readin", "reading", 1)}


def test_corrections_by_brute_force(spark):
    """Short alphabets, so that parts meet at many places; lengths from the least on; accents; ties."""
    import numpy as np
    from marlstone.functions.fuzzy import corrections

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            last, row[0] = row[0], i + 1
            for j, y in enumerate(b):
                last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
        return row[-1]

    rng = np.random.default_rng(12)
    make = lambda n: sorted({"".join(rng.choice(list("abcé"), size=int(k))) for k in rng.integers(3, 12, n)})
    words, known = make(150), make(60)
    got = corrections(spark.createDataFrame([(w,) for w in words], "w string"), "w", spark.createDataFrame([(k,) for k in known], "k string"), "k")
    want = set()
    for w in words:
        if len(w) >= 4 and w not in known:
            near = sorted((distance(w, k), k) for k in known if len(k) >= 4 and distance(w, k) <= 2)
            want |= {(w, near[0][1], near[0][0])} if near else set()
    assert {tuple(r) for r in got.collect()} == want and len(want) > 25
