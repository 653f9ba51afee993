"""Lexical and vector search, fusion and reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from copy import copy
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scores import rrf_gain
from ..functions.text import tokens
from .shared import checkpoints

K1, B, FLOOR = 1.5, 0.75, 0.25
#: Field weights of a general query; scores are scaled to this most.
WEIGHTS = {"body": 0.5, "heading": 0.22, "structure": 0.28}
SCALE = 12.0


class Bm25:
    """Okapi BM25 over one text column. Statistics are those of the whole corpus; filters apply to what a search returns.

    A search reads the texts once and keeps, of each document, its length and the tokens that are asked: from these come the
    counts of the terms, in one row, and the scores. The whole vocabulary is counted, by another reading, only where a
    term is in over half of the corpus, as its weight is then a share of the mean. For many questions, or the same
    corpus again and again, ``postings`` keeps an index.
    """

    def __init__(self, docs: DataFrame, key: str, text: str | Column):
        self.key = key
        # A generator's column is computed once; a projected one would be again in each place that reads it.
        self.docs = docs.select(key, F.explode(F.array(tokens(text))).alias("_tokens"))
        self.length: Column = F.size("_tokens")
        self.idf: dict[str, float] = {}
        self.average = 0.0
        self.whole = self

    def narrow(self, terms: list[str]) -> Bm25:
        """This index for ``terms`` alone, of which it has all counts and weights; its rows are written once."""
        checkpoints(self.docs.sparkSession)
        rows = self.docs.select(self.key, self.length.alias("_dl"), F.filter("_tokens", lambda t: t.isin(terms)).alias("_tokens"))
        return self._over(rows.checkpoint(), terms)

    def _over(self, rows: DataFrame, terms: list[str]) -> Bm25:
        """An index of this corpus whose rows (key, _dl, _tokens) hold no tokens but ``terms``."""
        other = copy(self)
        other.docs, other.length, other.idf = rows, F.col("_dl"), {}
        other.learn(terms)
        return other

    def vocabulary(self) -> DataFrame:
        """(term, df, idf): a term in over half of the corpus has a share of the mean idf in place of its negative one."""
        n = self.docs.agg(F.count("*").alias("_n"))
        df = self.docs.select(F.explode(F.array_distinct("_tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        raw = df.crossJoin(F.broadcast(n)).withColumn("_idf", F.log(F.col("_n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
        mean = raw.agg(F.avg("_idf").alias("_mean"))  # one row
        return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("_idf") < 0, FLOOR * F.col("_mean")).otherwise(F.col("_idf")).alias("idf"))

    def mean_idf(self, n: int) -> float:
        """The mean weight of the vocabulary of ``n`` documents: one row, from one reading of the texts."""
        df = self.docs.select(F.explode(F.array_distinct("_tokens")).alias("term")).groupBy("term").agg(F.count("*").alias("df"))
        return df.agg(F.avg(F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))).first()[0]

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(key, term, tf, dl). With ``terms`` other tokens are dropped before anything is exploded."""
        wanted = F.filter("_tokens", lambda t: t.isin(terms)) if terms else F.col("_tokens")
        rows = self.docs.select(self.key, F.size("_tokens").alias("dl"), F.explode(wanted).alias("term"))
        return rows.groupBy(self.key, "term").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))

    def statistics(self) -> DataFrame:
        """One row: (n_docs, avg_length)."""
        return self.docs.agg(F.count("*").alias("n_docs"), F.avg(F.size("_tokens")).alias("avg_length"))

    def learn(self, terms: list[str]) -> None:
        """Looks up the weights of terms not met before, in one pass for all of them."""
        new = sorted(set(terms) - set(self.idf))
        if not new:
            return
        n, average, *df = self.docs.agg(F.count("*"), F.avg(self.length), *[F.count_if(F.array_contains("_tokens", t)) for t in new]).first()
        self.average = average or 0.0
        raw = {t: log(n - d + 0.5) - log(d + 0.5) for t, d in zip(new, df, strict=True) if d}
        if any(w < 0 for w in raw.values()):
            floor = FLOOR * self.whole.mean_idf(n)
            raw = {t: floor if w < 0 else w for t, w in raw.items()}
        self.idf |= {t: raw.get(t, 0.0) for t in new}

    def score(self, terms: list[str]) -> Column:
        """The score of a row of ``self.docs``; a repeated term counts again."""
        self.learn(terms)
        norm = K1 * (1 - B + B * self.length / F.lit(self.average or 1.0))

        def gain(term: str) -> Column:
            tf = F.size(F.filter("_tokens", lambda t: t == term))
            return F.when(F.array_contains("_tokens", term), terms.count(term) * self.idf[term] * tf * (K1 + 1) / (tf + norm)).otherwise(F.lit(0.0))

        return reduce(lambda a, b: a + b, [gain(t) for t in dict.fromkeys(terms)], F.lit(0.0))

    def overlap(self, terms: list[str]) -> Column:
        """The share of the distinct terms that a row of ``self.docs`` holds."""
        return sum((F.array_contains("_tokens", t).cast("int") for t in dict.fromkeys(terms)), F.lit(0)) / len(set(terms))

    def scores(self, terms: list[str]) -> DataFrame:
        """(key, score) of documents that hold a term."""
        return self.docs.select(self.key, self.score(terms).alias("score"), self.overlap(terms).alias("_share")).where("_share > 0").drop("_share")

    def search(self, terms: list[str], k: int) -> DataFrame:
        """(key, score, rank): the k best scores over 0, ties by key."""
        return top_k(self.narrow(terms).scores(terms).where("score > 0"), "score", k, self.key)

    def rankings(self, columns: dict[str, Column], k: int) -> DataFrame:
        """(list, key, score, rank): for several scores of a row of ``self.docs``, the k best over 0 of each, in one pass."""
        lists = F.array(*[F.struct(F.lit(name).alias("list"), c.alias("score")) for name, c in columns.items()])
        rows = self.docs.select(self.key, F.explode(lists).alias("_s")).select(self.key, "_s.list", "_s.score").where("score > 0")
        return top_k_each(rows, "list", "score", k, self.key)


def okapi(postings: DataFrame, vocabulary: DataFrame, statistics: DataFrame, terms: list[str], key: str) -> DataFrame:
    """(key, score) from BM25 tables, computed or written before; only the terms' rows are read."""
    repeats = F.create_map(*[x for t in set(terms) for x in (F.lit(t), F.lit(terms.count(t)))])
    idf = vocabulary.where(F.col("term").isin(terms)).select("term", "idf")  # a row for each term asked
    rows = postings.where(F.col("term").isin(terms)).join(F.broadcast(idf), "term").crossJoin(F.broadcast(statistics.select("avg_length")))
    norm = F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_length"))
    return rows.groupBy(key).agg(F.sum(F.element_at(repeats, F.col("term")) * F.col("idf") * F.col("tf") * (K1 + 1) / norm).alias("score"))


def search_index(spark: SparkSession, path: str, terms: list[str], k: int, key: str) -> DataFrame:
    """(key, score, rank) from an index that ``sinks.write_index`` wrote: the corpus isn't read, and of the postings only the files that hold the terms."""
    read = lambda t: spark.read.parquet(f"{path}/{t}")
    return top_k(okapi(read("postings"), read("vocabulary"), read("statistics"), terms, key).where("score > 0"), "score", k, key)


def top_k(rows: DataFrame, score: str, k: int, key: str) -> DataFrame:
    """The k best rows ranked from 1: a distributed top-k, then a window over k rows."""
    best = rows.withColumn(score, F.round(score, 6)).orderBy(F.desc(score), key).limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key)))


def top_k_each(rows: DataFrame, query: str, score: str, k: int, key: str) -> DataFrame:
    """The k best rows of each query ranked from 1; Spark cuts each task's rows to k a query before they move."""
    best = Window.partitionBy(query).orderBy(F.desc(score), key)
    return rows.withColumn(score, F.round(score, 6)).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def field_parts(docs: DataFrame, key: str, fields: dict[str, str | Column], terms: list[str]) -> DataFrame:
    """(key, a column for each field): each field's BM25 over its own best, for documents with any.

    The fields' lengths and the tokens asked are written once, so that the texts aren't read again for counts, scores and bests.
    """
    checkpoints(docs.sparkSession)
    read = docs.select(key, F.inline(F.array(F.struct(*[tokens(text).alias(name) for name, text in fields.items()]))))
    kept = read.select(key, *[c for name in fields for c in (F.size(name).alias(f"_n_{name}"), F.filter(name, lambda t: t.isin(terms)).alias(f"_t_{name}"))]).checkpoint()
    rows = kept
    for name, text in fields.items():
        own = Bm25(docs.select(key, (F.col(text) if isinstance(text, str) else text).alias("_field")), key, "_field")
        index = own._over(kept.select(key, F.col(f"_n_{name}").alias("_dl"), F.col(f"_t_{name}").alias("_tokens")), terms)
        rows = rows.withColumnsRenamed({f"_n_{name}": "_dl", f"_t_{name}": "_tokens"}).withColumn(name, index.score(terms)).drop("_dl", "_tokens")
    most = rows.agg(*[F.max(name).alias(name) for name in fields]).first()
    held = reduce(lambda a, b: a | b, [F.col(name) > 0 for name in fields])
    return rows.where(held).select(key, *[F.when(F.col(name) > 0, F.col(name) / F.lit(most[name] or 1.0)).otherwise(F.lit(0.0)).alias(name) for name in fields])


def weighted(weights: dict[str, float]) -> Column:
    """The score of a row of ``field_parts``."""
    return reduce(lambda a, b: a + b, [F.col(name) * w for name, w in weights.items()]) * SCALE


def field_search(docs: DataFrame, key: str, fields: dict[str, str | Column], terms: list[str], weights: dict[str, float] | None = None) -> DataFrame:
    """(key, score): each field's BM25 over its own best, weighted and scaled. Normalized before any filter."""
    return field_parts(docs, key, fields, terms).select(key, weighted(weights or WEIGHTS).alias("score"))


def dot(left: Column, right: Column) -> Column:
    """In double precision, in the vectors' order."""
    return F.aggregate(F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double")), F.lit(0.0), lambda a, x: a + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def similar(vectors: DataFrame, query: DataFrame, vector: str = "embedding", cosine: bool = False, many: bool = False) -> DataFrame:
    """``vectors`` with ``score`` against the one row of ``query`` (column ``_query``): dot product, or cosine.

    ``many``: against each row of ``query``, whose other columns are kept; the rows are broadcast only if Spark finds them small, else blocks are paired.
    """
    rows = vectors.crossJoin(query if many else F.broadcast(query))
    score = dot(F.col(vector), F.col("_query"))
    return rows.withColumn("score", score / (norm(F.col(vector)) * norm(F.col("_query"))) if cosine else score).drop("_query")


def meet(vectors: DataFrame, queries: DataFrame, keep: Callable[..., dict], schema: str, vector: str = "embedding", cosine: bool = False, zero: float = -np.inf, near: list[str] | None = None) -> DataFrame:
    """What ``keep`` takes of the scores of each block of ``vectors`` against each block of ``queries`` (with ``_query`` and other columns).

    Blocks are rows, and a pair of blocks is scored in a task by one product of matrices in double precision: no pair of
    vectors is a row unless ``keep`` makes it one. ``keep`` gets the columns of both sides but the vectors, as Arrow tables, and
    the scores (a row a query), and returns columns for ``schema``. A vector that is null, holds a null or has another length than
    the query's has no score (minus infinity); a cosine with a zero vector is ``zero``. ``near``: columns by which vectors lie together in blocks.
    """
    checkpoints(vectors.sparkSession)
    parts = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = vectors.repartitionByRange(parts, *near).sortWithinPartitions(*near) if near else vectors.repartition(parts)
    left = dealt.mapInArrow(lambda b: _packed(b, vector, 2048), "_rows binary").checkpoint()  # each side is read again for every part of the other
    right = queries.repartition(4).mapInArrow(lambda b: _packed(b, "_query", 1024), "_asked binary").checkpoint()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, asked in zip(batch.column("_rows"), batch.column("_asked"), strict=True):
                own, ask = (pa.ipc.open_stream(side.as_py()).read_all().combine_chunks() for side in (rows, asked))
                scores = np.full((ask.num_rows, own.num_rows), -np.inf)
                for length, at in _lengths(ask.column("_query")).items():
                    to = _lengths(own.column(vector)).get(length)
                    if to is not None:
                        x, y = _matrix(ask.column("_query"), at, length), _matrix(own.column(vector), to, length)
                        product = x @ y.T
                        if cosine:
                            norms = np.sqrt((x * x).sum(axis=1))[:, None] * np.sqrt((y * y).sum(axis=1))
                            product = np.where(norms > 0, product / np.where(norms > 0, norms, 1), zero)
                        scores[np.ix_(at, to)] = product
                found = keep(ask.drop_columns("_query"), own.drop_columns(vector), scores)
                yield pa.RecordBatch.from_arrays([c.combine_chunks() if isinstance(c, pa.ChunkedArray) else pa.array(c) for c in found.values()], names=list(found))

    return left.crossJoin(right).mapInArrow(run, schema)


def _packed(batches: Iterator[pa.RecordBatch], vector: str, most: int) -> Iterator[pa.RecordBatch]:
    """Blocks of rows, each one value: an Arrow stream."""
    for batch in batches:
        for start in range(0, batch.num_rows, most):
            out = pa.BufferOutputStream()
            with pa.ipc.new_stream(out, batch.schema) as stream:
                stream.write_batch(batch.slice(start, most))
            yield pa.RecordBatch.from_arrays([pa.array([out.getvalue().to_pybytes()], pa.binary())], names=["_asked" if vector == "_query" else "_rows"])


def _lengths(column: pa.ChunkedArray) -> dict[int, np.ndarray]:
    """The places of whole vectors by their length."""
    size = np.array([-1 if v is None or None in v else len(v) for v in column.to_pylist()] if column.null_count or column.combine_chunks().flatten().null_count else pc.list_value_length(column).to_numpy())
    return {int(n): np.flatnonzero(size == n) for n in np.unique(size) if n >= 0}


def _matrix(column: pa.ChunkedArray, at: np.ndarray, length: int) -> np.ndarray:
    flat = column.take(pa.array(at)).combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), length)


def first_each(scores: np.ndarray, keys: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k highest of each row of ``scores``, ties to the smaller key; not a number counts as highest, as Spark orders it."""
    value = np.where(np.isnan(scores), np.inf, scores)
    if value.shape[1] > k:
        q, d = np.nonzero(value >= np.partition(value, -k, axis=1)[:, -k][:, None])
    else:
        q, d = (x.ravel() for x in np.indices(value.shape))
    order = np.lexsort((keys[d], -value[q, d], q))
    q, d = q[order], d[order]
    start = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.r_[start, len(q)]))
    return q[rank < k], d[rank < k]


def fuse(rankings: list[DataFrame], key: str) -> DataFrame:
    """Reciprocal rank fusion: (key, score, n_lists) summed over every ranking that holds the key."""
    rows = rankings[0].select(key, "rank")
    for more in rankings[1:]:
        rows = rows.unionByName(more.select(key, "rank"))
    return rows.groupBy(key).agg(F.sum(rrf_gain(F.col("rank"))).alias("score"), F.count("*").alias("n_lists"))


def term_overlap(rows: DataFrame, text: str | Column, terms: list[str]) -> DataFrame:
    """``rows`` with ``overlap``: the share of the distinct terms that the text holds."""
    wanted = F.array(*[F.lit(t) for t in sorted(set(terms))])
    return rows.withColumn("overlap", F.size(F.array_intersect(F.array_distinct(tokens(text)), wanted)) / len(set(terms)))


def rerank(rows: DataFrame, text: str, terms: list[str], pool: int, key: str, replace: bool = True) -> DataFrame:
    """Reorders the first ``pool`` ranks by term overlap. ``replace``: it is their order; else four times it adds to the score."""
    scored = term_overlap(rows, text, terms)
    model = F.when(F.col("rank") <= pool, F.col("overlap"))
    order = [F.desc_nulls_last(model), F.col("rank")] if replace else [F.desc(F.col("score") + 4 * F.coalesce(model, F.lit(0.0))), F.col("rank")]
    return scored.withColumn("rank", F.row_number().over(Window.orderBy(*order, key)))
