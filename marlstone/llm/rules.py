"""Quality rules as a bitmask ledger: rules run once, policies are masks applied later."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fresh_names

MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_shouted", "n_marks")
#: Rule: what fails it, over the measurements. Its bit is its place. Never reorder: append, so that old ledgers stay readable.
RULES = {
    "few_words": "n_words < 50",
    "repeated_windows": "100 * n_repeat_words > 50 * n_words",
    "symbols": "10 * n_symbols > 3 * n_words",
    "duplicate_lines": "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines",
    "shouting": "100 * n_shouted > 60 * n_words",
    "exclamations": "100 * n_marks > 60 * n_words",
    "no_words": "n_words < 1",
}
BITS = {name: 1 << k for k, name in enumerate(RULES)}
#: Version: the rules whose failure rejects a document.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "v2": ("few_words", "repeated_windows", "symbols", "duplicate_lines", "shouting", "exclamations"),
    # For training corpora: a short text isn't a bad one.
    "corpus": ("no_words", "repeated_windows", "symbols", "duplicate_lines", "shouting", "exclamations"),
}
CURRENT = "v2"
_SYMBOL = re.compile(r"[#*$%&|<>]")


def mask(policy: str) -> int:
    return sum(BITS[r] for r in POLICIES[policy])


def repeated_words(words: list[str]) -> int:
    """Words that stand in a three-word window found at least twice, the first occurrence included."""
    if len(words) < 4:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=len(words))
    n = len(number)
    pair = ids[:-1] * n + ids[1:]
    if n < 2_000_000:
        triple = pair[:-1] * n + ids[2:]
    else:  # three ids don't fit in 63 bits
        triple = np.unique(pair, return_inverse=True)[1][:-1] * n + ids[2:]
    _, where, count = np.unique(triple, return_inverse=True, return_counts=True)
    twice = count[where] > 1
    inside = np.zeros(len(words), dtype=bool)
    for k in range(3):
        inside[k : len(words) - 2 + k] |= twice
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, ...]:
    """The measurements of one text, in the order of MEASURES."""
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    shouted = sum(len(w) > 1 and w.isupper() for w in words)
    marks = sum(w.endswith(("!", "?")) for w in words)
    return len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines), len(lines) - len(set(lines)), repeated_words(words), shouted, marks


def _measures(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in text], columns=list(MEASURES))


def ledger(docs: DataFrame, out: str, text: str = "text") -> DataFrame:
    """``docs`` with the struct ``out``: every measurement and ``failed``, the mask of the rules that the text fails.

    Null text counts as empty (it fails few_words). Repeated rows are judged alike; texts of any length are measured
    whole; an empty table stays empty; columns of ``docs`` are kept, as everything new is inside ``out``.
    """
    bound_batches(docs.sparkSession)
    measured = docs.withColumn(out, F.pandas_udf(_measures, ", ".join(f"{m} long" for m in MEASURES))(F.col(text)))
    failed = F.lit(0)
    for name, rule in RULES.items():
        inner = re.sub(r"\b(n_\w+|word_chars)\b", rf"{out}.\1", rule)
        failed = failed.bitwiseOR(F.when(F.expr(inner), F.lit(BITS[name])).otherwise(F.lit(0)))
    return measured.withColumn(out, F.col(out).withField("failed", failed))


def rejected(out: str, policy: str = CURRENT) -> Column:
    """Whether a ledger's mask fails one of the policy's rules; the text isn't read again."""
    return F.col(f"{out}.failed").bitwiseAND(F.lit(mask(policy))) != 0


def keep(docs: DataFrame, policy: str = CURRENT, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the policy doesn't reject."""
    (out,) = fresh_names(docs, "ledger")
    return ledger(docs, out, text).where(~rejected(out, policy)).select(*docs.columns)


def ablation(ledgered: DataFrame, out: str, policy: str = CURRENT) -> DataFrame:
    """(rule, failing, only): rows that fail each rule of the policy, and rows that would be kept without it.

    Works on the counts of the distinct masks, at most two to the number of rules.
    """
    masks = ledgered.groupBy(F.col(f"{out}.failed").bitwiseAND(F.lit(mask(policy))).alias("m")).count()
    rows = masks.select(F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).alias("bit")) for r in POLICIES[policy]])).alias("r"), "m", "count")
    hit = F.col("m").bitwiseAND(F.col("r.bit")) != 0
    return rows.groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("count"))), F.lit(0)).alias("failing"),
        F.coalesce(F.sum(F.when(F.col("m") == F.col("r.bit"), F.col("count"))), F.lit(0)).alias("only"),
    )
