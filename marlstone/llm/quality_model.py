"""A quality classifier: histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, slices
from .gbt import Forest, fit

#: Labelled documents to which the trees are fitted, at most, chosen by a hash; trees and their depth.
SAMPLE, TREES, DEPTH = 12_000, 80, 4
THRESHOLD = 0.7
FEATURES = (
    "log_words", "mean_word", "long_words", "unique_words", "upper", "upper_words", "digits", "symbols", "marks", "pipes", "commas", "non_ascii", "spaces",
    "log_lines", "mean_line", "short_lines", "same_lines", "top_word", "run_word", "same_pairs", "stops", "entropy", "ends_well",
)
_SYMBOLS = re.compile(r"[#*$%&<>{}\[\]\\^~_=+@/]")


def statistics(text: str | None) -> list[float]:
    """The features of one whole text; an empty one has zeros."""
    text = text or ""
    words = text.split()
    n, chars = len(words), len(text)
    if not n:
        return [0.0] * len(FEATURES)
    count = Counter(words)
    lines = [x for x in text.split("\n") if x.strip()]
    lower = text.lower()
    upper = sum(map(str.isupper, words))
    pairs = len(set(zip(words, words[1:], strict=False)))
    letters = Counter(lower)
    p = np.array(list(letters.values())) / chars
    changed = chars - sum(1 for a, b in zip(text, lower, strict=False) if a == b) if len(lower) == chars else sum(c.isupper() for c in text)
    runs = sum(a == b for a, b in zip(words, words[1:], strict=False))
    digits = sum(letters.get(d, 0) for d in "0123456789")
    return [
        np.log1p(n), sum(map(len, words)) / n, sum(len(w) > 14 for w in words) / n, len(count) / n, changed / chars, upper / n, digits / chars,
        len(_SYMBOLS.findall(text)) / n, (text.count("!") + text.count("?")) / n, text.count("|") / n, (text.count(",") + text.count(".")) / n,
        sum(v for c, v in letters.items() if c > "\x7f") / chars, (chars - sum(map(len, words))) / chars,
        np.log1p(len(lines)), n / len(lines), sum(len(x) < 30 for x in lines) / len(lines), 1 - len(set(lines)) / len(lines), max(count.values()) / n, runs / n,
        1 - pairs / max(1, n - 1), sum(v for w, v in count.items() if len(w) <= 3) / n, float(-(p * np.log2(p)).sum()), sum(x.rstrip().endswith((".", "!", "?", '"', ":")) for x in lines) / len(lines),
    ]


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"quality": batch["quality"], "f": [np.asarray(statistics(t)) for t in batch["text"]]})


def held_out(doc_id: str = "doc_id"):
    """Rows that no model sees: crc32 of the doc_id as text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest:
    """The trees, fitted to ``quality`` of at most ``sample`` labelled rows that aren't held out. Only features and labels reach the driver."""
    bound_batches(docs.sparkSession)
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max("quality").alias("quality"))
    some = known.orderBy(F.xxhash64("doc_id", F.lit(11)), "doc_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(some), "doc_id")  # of a bounded size
    rows = rows.groupBy("doc_id").agg(F.max("quality").alias("quality"), F.min("text").alias("text")).select("quality", "text")  # repeats of a doc_id count once
    got = rows.mapInPandas(_features, "quality int, f array<double>").collect()
    got.sort(key=lambda r: (r["quality"], r["f"]))
    x = np.array([r["f"] for r in got]).reshape(-1, len(FEATURES))
    return fit(x, np.array([float(r["quality"] > 0) for r in got]), trees=TREES, depth=DEPTH)


def _score(forest: Forest):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in (piece for whole in batches for piece in slices(whole)):
            x = np.array([statistics(t) for t in batch["text"]]).reshape(-1, len(FEATURES))
            yield pd.DataFrame({"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": forest.predict(x)})

    return run


def score(docs: DataFrame, forest: Forest) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from the whole text alone.

    Null text counts as empty, a null doc_id isn't held out; repeated rows each give their row; texts of any length are
    read whole; an empty table gives no rows; other columns don't matter.
    """
    bound_batches(docs.sparkSession)
    # A long beside a null would reach pandas as a floating-point number, so identifiers go there as text.
    rows = docs.select(F.col("doc_id").cast("string"), "text", held_out().alias("held_out"))
    scored = rows.mapInPandas(_score(forest), "doc_id string, held_out boolean, score double")
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
