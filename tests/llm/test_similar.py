"""The pipeline's near-duplicate stage against brute force over five-word sets."""

import random

import pytest

import corpus_pipeline as pipe
from marlstone.llm import similar


def shingles(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def kept_brute(rows):
    """Smallest doc_id of each component of rows (doc_id, text) whose Jaccard is 0.8 or more; and the linked pairs of different sets."""
    least, held, pairs = {}, {}, []
    for d, t in rows:
        s = shingles(t)
        least[s] = min(d, least.get(s, d))
    for s in least:
        for w in s:
            held.setdefault(w, []).append(s)
    root = {s: s for s in least}

    def find(s):
        while root[s] != s:
            s = root[s]
        return s

    for s in least:
        for u in {u for w in s for u in held[w]}:
            if least[u] < least[s] and 10 * len(s & u) >= 8 * len(s | u):
                pairs.append((least[u], least[s]))
                root[find(s)] = find(u)
    out = {}
    for s, d in least.items():
        out[find(s)] = min(d, out.get(find(s), d))
    return sorted(out.values()), pairs


@pytest.mark.parametrize("heavy", [0, 7])
def test_planted_copies(spark, monkeypatch, heavy):
    """Copies edited so that their Jaccard lies at 0.6 to 1.0, copies of copies, one large group, and exact copies."""
    if heavy:
        for name in ("BUCKET", "GROUP", "HOT"):
            monkeypatch.setattr(similar, name, heavy)
    random.seed(5)
    new = lambda: f"w{random.randrange(10**6)}"
    rows = []
    for n, edits in [(200, k) for k in range(1, 8)] * 25 + [(500, 10)] * 30 + [(60, 1)] * 30:
        base = [new() for _ in range(n)]
        rows.append(base)
        for _ in range(2):
            at = set(random.sample(range(n), edits))
            base = [new() if i in at else w for i, w in enumerate(base)]
            rows.append(base)
    one = [new() for _ in range(150)]
    rows += [[new() if i == k % 150 else w for i, w in enumerate(one)] for k in range(300)] + [one] * 20
    random.shuffle(rows)
    rows = [(i, " ".join(r)) for i, r in enumerate(rows)]
    want, pairs = kept_brute(rows)
    got = sorted(r[0] for r in pipe.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), "").collect())
    assert got == want and len(pairs) > 300


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    want, pairs = kept_brute([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert sorted(r[0] for r in pipe.near_duplicates(spark, docs, sf).collect()) == want and pairs
