"""Guardrails on answers: what may be said, what is dropped, when nothing is said."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Lines that an answer's checks leave alone, and what is put in place of an answer.
LABELS = ("Legal basis:", "Reasoning:", "Missing facts:", "Citations:", "Verification:")
REFUSAL = "Information not found in retrieved evidence."


#: Up to so many prices all their sums are columns of one matrix for many answers; above, an answer's sums are made on their own.
FEW = 10
#: Numbers of such a matrix.
BLOCK = 1 << 20


def _sums(prices: np.ndarray, most: int) -> np.ndarray:
    """All sums of one to ``most`` of the prices, each once: what so many of the prices so far make, with and without the next."""
    by_count = [np.zeros(1, dtype=np.int64)] + [np.zeros(0, dtype=np.int64)] * most
    for price in prices:
        for n in range(most, 0, -1):
            by_count[n] = np.union1d(by_count[n], by_count[n - 1] + price)
    return np.unique(np.concatenate(by_count[1:]))


def _offered(prices: np.ndarray, most: int) -> np.ndarray:
    """For rows of equally many prices the sums of one to ``most`` and the differences of two."""
    sums, counts = np.zeros((len(prices), 1), dtype=np.int64), np.zeros(1, dtype=np.int64)
    for k in range(prices.shape[1]):
        sums, counts = np.hstack([sums, sums + prices[:, k : k + 1]]), np.r_[counts, counts + 1]
    gaps = np.abs(prices[:, :, None] - prices[:, None, :]).reshape(len(prices), -1)
    return np.hstack([sums[:, (counts > 0) & (counts <= most)], gaps])


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each row's numbers start, the numbers, and where they are null."""
    size, flat = pc.fill_null(pc.list_value_length(column), 0), column.flatten()
    return np.r_[0, np.cumsum(size.to_numpy(zero_copy_only=False).astype(np.int64))], pc.fill_null(flat, 0).to_numpy(), flat.is_null().to_numpy(zero_copy_only=False)


def _backed(said: pa.ListArray, cents: pa.ListArray, most: int) -> pa.ListArray:
    """For each row's numbers whether its prices make them, to one; null where a price or the number is."""
    (to, number, none), (at, price, missing) = _lists(said), _lists(cents)
    held = np.zeros(len(number), dtype=bool)
    unknown = cents.is_null().to_numpy(zero_copy_only=False)
    unknown[np.repeat(np.arange(len(cents)), np.diff(at))[missing]] = True
    n_said, n_prices = np.diff(to), np.diff(at)
    for size in np.unique(n_prices).tolist():
        rows = np.flatnonzero((n_prices == size) & ~unknown)
        step = max(1, BLOCK // (2**size + size * size)) if size <= FEW else 1
        for block in (rows[i : i + step] for i in range(0, len(rows), step)):
            prices = price[at[block][:, None] + np.arange(size)]
            offered = _offered(prices, most) if size <= FEW else np.r_[_sums(prices[0], most), np.abs(prices[0][:, None] - prices[0]).ravel()][None]
            for k in range(n_said[block].max(initial=0)):
                own = n_said[block] > k
                place = to[block[own]] + k
                held[place] = (np.abs(offered[own] - number[place][:, None]) <= 1).any(axis=1)
    return pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(held, mask=none | np.repeat(unknown, n_said)))


def _cents(prices: Column) -> Column:
    return F.transform(prices, lambda p: F.round(p * 100).cast("long"))


def reachable_sums(prices: Column, most: int = 5) -> Column:
    """All sums of one to ``most`` of an answer's few prices, in whole hundredths, each once; null if a price is."""

    @F.arrow_udf("array<bigint>")
    def sums(cents: pa.Array) -> pa.Array:
        return pa.array([None if row is None or None in row else _sums(np.array(row, dtype=np.int64), most) for row in cents.to_pylist()], pa.list_(pa.int64()))

    return sums(_cents(prices))


def unsupported_prices(mentioned: Column, prices: Column) -> Column:
    """Mentioned prices that are no sum of up to five given ones and no difference of two, to a hundredth. Where a price is null none is named.

    Sums are columns of a matrix, made for all answers of a batch that have equally many prices.
    """

    @F.arrow_udf("array<boolean>")
    def backed(said: pa.Array, cents: pa.Array) -> pa.Array:
        return _backed(said, cents, 5)

    pairs = F.arrays_zip(mentioned.alias("m"), backed(_cents(mentioned), _cents(prices)).alias("ok"))
    return F.transform(F.filter(pairs, lambda x: ~x["ok"]), lambda x: x["m"])


def stock_claim_faults(text: Column, stock: Column) -> Column:
    """Whether a text promises what isn't in stock, or says sold out of what is."""
    lower = F.lower(text)
    out = F.rlike(lower, F.lit(r"out of stock|sold out|unavailable|not available"))
    in_ = ~out & F.rlike(lower, F.lit(r"in stock|available now|ready to ship"))
    return (in_ & (F.coalesce(stock, F.lit(0)) <= 0)) | (out & (F.coalesce(stock, F.lit(0)) > 0))


def answer_policy(claims: DataFrame, key: str, at: str, claim: str, supported: str) -> DataFrame:
    """(key, final, n_removed, refused): each answer with its unsupported claims left out, refused if no other is left.

    Labelled lines stay, but don't count as an answer. The claims of one answer are few, so its text is put together in one row.
    """
    labelled = F.lit(False)
    for label in LABELS:
        labelled = labelled | F.startswith(F.col(claim), F.lit(label))
    keep = labelled | F.col(supported)
    per = claims.groupBy(key).agg(
        F.array_sort(F.collect_list(F.when(keep, F.struct(F.col(at).alias("at"), F.col(claim).alias("c"))))).alias("_kept"),
        F.count_if(~keep).alias("n_removed"), F.count_if(keep & ~labelled).alias("_said"),
    )
    refused = (F.col("n_removed") > 0) & (F.col("_said") == 0)
    text = F.array_join(F.transform("_kept", lambda x: x["c"]), " ")
    return per.select(key, F.when(refused, F.lit(REFUSAL)).otherwise(text).alias("final"), "n_removed", refused.alias("refused"))


def abstentions(hits: DataFrame, query: str, score: str, level: str, conflict: str, least: float) -> DataFrame:
    """(query, abstained, reason): a question isn't answered if its best hit is weak, or its hits conflict and not one alone has the highest authority."""
    per = hits.groupBy(query).agg(
        F.max(score).alias("_top"), F.max(level).alias("_high"), F.count_distinct(level).alias("_levels"), F.bool_or(conflict).alias("_conflict")
    )
    winners = hits.join(per.select(query, F.col("_high").alias(level)), [query, level]).groupBy(query).agg(F.count("*").alias("_winners"))
    rows = per.join(winners, query, "left")
    open_ = F.col("_conflict") & ((F.col("_levels") <= 1) | (F.coalesce("_winners", F.lit(0)) != 1))
    reason = F.when(F.col("_top") < least, "weak").when(open_, "conflict")
    return rows.select(query, reason.isNotNull().alias("abstained"), reason.alias("reason"))


def cited_sentences(sentences: DataFrame, key: str, at: str, text: str, citations: DataFrame, marker: str, snippet: str) -> DataFrame:
    """(key, at, verdict): whether each sentence cites, cites what exists, and shares a word with what it cites (short ones needn't).

    Citations are few for an answer; they meet their sentences by key and marker.
    """
    marks = F.array_distinct(F.regexp_extract_all(text, F.lit(r"\[([0-9]+)\]"), F.lit(1)))
    rows = sentences.select(key, at, F.col(text).alias("_t"), F.explode_outer(marks).alias("_m"))
    met = rows.join(citations.select(key, F.col(marker).cast("string").alias("_m"), F.col(snippet).alias("_s")), [key, "_m"], "left")
    words = lambda c: F.array_distinct(F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"\s+"), lambda w: w != ""))
    shared = F.size(F.array_intersect(words(F.col("_t")), words(F.col("_s")))) > 0
    per = met.groupBy(key, at).agg(F.count("_m").alias("_n"), F.count_if(F.col("_m").isNotNull() & F.col("_s").isNull()).alias("_bad"), F.bool_or(shared).alias("_shared"), F.max(F.size(words(F.col("_t")))).alias("_words"))
    verdict = F.when(F.col("_n") == 0, "uncited").when(F.col("_bad") > 0, "invalid").when(F.col("_shared") | (F.col("_words") <= 4), "supported").otherwise("weak")
    return per.select(key, at, verdict.alias("verdict"))
