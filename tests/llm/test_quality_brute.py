"""The quality classifier's statistics and trees, recomputed text by text and node by node."""

import math
import re
from collections import Counter

import numpy as np

from marlstone.llm import quality_model, queries
from marlstone.llm.gbt import Forest, fit


def walk(forest: Forest, row) -> float:
    """One row down every tree, a node at a time."""
    total = forest.base
    inner = len(forest.feature[0])
    for tree in range(len(forest.leaf)):
        node = 0
        while node < inner:
            node = 2 * node + (2 if row[forest.feature[tree][node]] > forest.threshold[tree][node] else 1)
        total += forest.leaf[tree][node - inner]
    return 1 / (1 + math.exp(-total))


def plain_statistics(text):
    """The features by their definitions, character by character and word by word."""
    text = text or ""
    words = text.split()
    if not words:
        return dict.fromkeys(quality_model.FEATURES, 0.0)
    lines = [x for x in text.split("\n") if x.strip() != ""]
    lower, n, chars = text.lower(), len(words), len(text)
    share = {c: k / chars for c, k in Counter(lower).items()}
    count = Counter(words)
    return {
        "log_words": math.log(1 + n), "mean_word": sum(len(w) for w in words) / n, "long_words": len([w for w in words if len(w) > 14]) / n, "unique_words": len(set(words)) / n,
        "upper": len([1 for c in text if c != c.lower()]) / chars, "upper_words": len([w for w in words if w.isupper()]) / n, "digits": len([c for c in lower if c in "0123456789"]) / chars,
        "symbols": len(re.findall(r"[#*$%&<>{}\[\]\\^~_=+@/]", text)) / n, "marks": len([c for c in text if c in "!?"]) / n, "pipes": len([c for c in text if c == "|"]) / n, "commas": len([c for c in text if c in ",."]) / n,
        "non_ascii": len([c for c in lower if ord(c) > 127]) / chars, "spaces": (chars - sum(len(w) for w in words)) / chars, "log_lines": math.log(1 + len(lines)), "mean_line": n / len(lines),
        "short_lines": len([x for x in lines if len(x) < 30]) / len(lines), "same_lines": 1 - len(set(lines)) / len(lines), "top_word": max(count.values()) / n, "run_word": len([1 for i in range(1, n) if words[i] == words[i - 1]]) / n,
        "same_pairs": 1 - len({(words[i], words[i + 1]) for i in range(n - 1)}) / max(1, n - 1), "stops": len([w for w in words if len(w) <= 3]) / n, "entropy": -sum(p * math.log2(p) for p in share.values()),
        "ends_well": len([x for x in lines if x.rstrip()[-1] in '.!?":']) / len(lines),
    }


def test_every_score_by_brute_force(spark, sf):
    """The query's rows over the whole table: statistics by their definitions, trees walked node by node."""
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    forest = quality_model.train(docs, labels)
    got = {r["doc_id"]: r for r in queries.op9_quality(spark, sf).collect()}
    rows = docs.select("doc_id", "text").collect()
    assert set(got) == {r["doc_id"] for r in rows} and len(rows) == 200
    for r in rows:
        plain = plain_statistics(r["text"])
        row = [plain[f] for f in quality_model.FEATURES]
        assert np.allclose(row, quality_model.statistics(r["text"]), atol=1e-9)
        want = walk(forest, quality_model.statistics(r["text"]))
        assert math.isclose(got[r["doc_id"]]["score"], want, abs_tol=1e-9) and got[r["doc_id"]]["predicted"] == int(want >= 0.7)


def test_forests_by_walking():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 5)).round(1)
    forest = fit(x, (x[:, 1] > x[:, 3]).astype(float), trees=12, depth=3)
    assert np.allclose(forest.predict(x), [walk(forest, r) for r in x])
