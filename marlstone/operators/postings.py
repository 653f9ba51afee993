"""BM25 for many questions at once: postings in blocks with score bounds, so that most blocks of a question are never scored."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from .search import B, FLOOR, K1, top_k_each
from .shared import bound_batches, shared_folder

#: Documents of a range, the unit that is scored or left out. A block holds a term's postings in a range, so no more than these. A range of long documents ends with these postings.
RANGE, POSTINGS = 1024, 1 << 19
#: Bytes of the questions' different terms up to which they are broadcast to the blocks.
BROADCAST = 8 << 20
#: Bytes of questions that a task holds, rows that it holds of what they find (k a question at the end, as many again before the best are kept), and and, of a range, questions and meetings of a question's term and a document that it scores at once.
ASKED, POOL, CHUNK, PAIRS = 32 << 20, 1 << 18, 512, 1 << 20


def gain(tf, dl, average):
    """What one unit of a term's weight adds to a document's score."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / average))


@dataclass
class Index:
    """Written tables: ``blocks`` (term, range, keys, tfs, dls, bound, held), ``vocabulary`` (term, df, idf), ``statistics``, one row (n_docs, avg_length)."""

    blocks: DataFrame
    vocabulary: DataFrame
    statistics: DataFrame

    @staticmethod
    def read(spark: SparkSession, path: str) -> Index:
        return Index(*(spark.read.parquet(f"{path}/{t}") for t in ("blocks", "vocabulary", "statistics")))


def counted(docs: DataFrame, key: str, text: str | Column) -> DataFrame:
    """(key, dl, terms, tfs) of each row: its length in tokens, its different terms and how often each stands in it. Nothing moves."""
    rows = docs.select(F.col(key).alias("key"), F.explode(F.array(tokens(text))).alias("_tokens"))  # a generator's column is computed once
    return rows.mapInArrow(_count, f"key {dict(docs.dtypes)[key]}, dl int, terms array<string>, tfs array<int>")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for start in range(0, whole.num_rows, 1024):
            batch = whole.slice(start, 1024)
            lists = batch.column("_tokens")
            dl, coded = np.asarray(lists.value_lengths()).astype(np.int32), lists.flatten().dictionary_encode()
            of = np.repeat(np.arange(len(dl), dtype=np.int64), dl)
            pairs, tf = np.unique(of << 32 | np.asarray(coded.indices).astype(np.int64), return_counts=True)
            offsets = pa.array(np.r_[0, np.cumsum(np.bincount(pairs >> 32, minlength=len(dl)))].astype(np.int32))
            terms = coded.dictionary.take(pa.array(pairs & 0xFFFFFFFF))
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(dl), pa.ListArray.from_arrays(offsets, terms), pa.ListArray.from_arrays(offsets, pa.array(tf.astype(np.int32)))], names=["key", "dl", "terms", "tfs"])


def _like(dl):
    """Lengths that differ by under a half have one number."""
    return F.ceil(F.log2(dl + 1) * 2).cast("int")


def blocks(rows: DataFrame, average: float) -> DataFrame:
    """(term, range, keys, tfs, dls, bound, held): the postings of ``counted`` rows. A range is up to ``RANGE`` documents of one task and like length, and about ``POSTINGS`` at most, so nothing moves."""
    near = rows.where(F.size("terms") > 0).withColumn("_like", _like(F.col("dl"))).sortWithinPartitions("_like")
    kind = dict(rows.dtypes)["key"]
    return near.mapInArrow(lambda batches: _inverted(batches, average), f"term string, range long, keys array<{kind}>, tfs array<int>, dls array<int>, bound double, held long")


def _inverted(batches: Iterator[pa.RecordBatch], average: float) -> Iterator[pa.RecordBatch]:
    number, held, n, postings, like = TaskContext.get().partitionId() << 32, [], 0, 0, None

    def block() -> pa.RecordBatch:
        rows = pa.Table.from_batches(held).combine_chunks()
        size = np.asarray(pc.list_value_length(rows["terms"].chunk(0)))
        coded, tf = rows["terms"].chunk(0).flatten().dictionary_encode(), np.asarray(rows["tfs"].chunk(0).flatten())
        code = np.asarray(coded.indices).astype(np.int64)
        order = np.argsort(code, kind="stable")
        of, tf, count = np.repeat(np.arange(len(size)), size)[order], tf[order], np.bincount(code, minlength=len(coded.dictionary))
        dl, starts = np.asarray(rows["dl"].chunk(0))[of], np.r_[0, np.cumsum(count)]
        offsets = pa.array(starts.astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, v) for v in (rows["key"].chunk(0).take(pa.array(of)), pa.array(tf), pa.array(dl))]
        bound = np.maximum.reduceat(gain(tf, dl, average), starts[:-1])
        return pa.RecordBatch.from_arrays([coded.dictionary, pa.array(np.full(len(count), number)), *lists, pa.array(bound), pa.array(count)], names=["term", "range", "keys", "tfs", "dls", "bound", "held"])

    for batch in batches:
        of, ends = np.asarray(batch.column("_like")), np.r_[0, np.cumsum(pc.list_value_length(batch.column("terms")))]
        at = 0
        while at < len(of):
            if held and (of[at] != like or n == RANGE or postings >= POSTINGS):
                yield block()
                number, held, n, postings = number + 1, [], 0, 0
            like = of[at]
            take = int(min(np.searchsorted(of, like, side="right") - at, RANGE - n))
            take = max(1, min(take, int(np.searchsorted(ends, ends[at] + POSTINGS - postings, side="right")) - 1 - at))
            held.append(batch.slice(at, take))
            at, n, postings = at + take, n + take, postings + int(ends[at + take] - ends[at])
    if held:
        yield block()


def build(docs: DataFrame, key: str, text: str | Column, path: str | None = None) -> Index:
    """Reads ``docs`` once and writes its index to ``path``, by default a new folder among the checkpoints.

    A range is a set of documents of like length, so that its bounds are near its scores. A term in over half of the documents has a share of the mean idf in place of its negative one.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    path = path or f"{shared_folder(spark)}/postings-{uuid4().hex}"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    rows = kept(counted(docs, key, text), "counted")
    n, length = rows.agg(F.count("*"), F.sum("dl")).first()
    average = (length or 0) / n if n else 0.0
    statistics = kept(spark.createDataFrame([(n, float(average))], "n_docs long, avg_length double"), "statistics")
    df = rows.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = df.withColumn("_idf", F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5))
    mean = F.broadcast(raw.agg(F.avg("_idf").alias("_mean")))  # one row
    vocabulary = kept(raw.crossJoin(mean).select("term", "df", F.when(F.col("_idf") < 0, FLOOR * F.col("_mean")).otherwise(F.col("_idf")).alias("idf")).repartitionByRange("term").sortWithinPartitions("term"), "vocabulary")
    return Index(kept(blocks(rows, average), "blocks"), vocabulary, statistics)


def ranges(index: Index, asked: DataFrame) -> DataFrame:
    """(question, range, most, held): no document of the range has a higher score, and at least ``held`` have one."""
    met = index.blocks.select("term", "range", "bound", "held").join(asked, "term")
    return met.groupBy("question", "range").agg(F.sum(F.greatest("weight", F.lit(0.0)) * F.col("bound")).alias("most"), F.max("held").alias("held"))


def search(index: Index, questions: DataFrame, k: int, question: str = "question", text: str | Column = "text") -> DataFrame:
    """(question, key, score, rank): for every row of ``questions`` the k best documents over 0, ties by key; a repeated term counts again.

    Questions without known terms have no rows.
    """
    terms = questions.select(F.col(question).alias("question"), F.explode(tokens(text)).alias("term"))
    asked = terms.groupBy("question", "term").agg(F.count("*").alias("_times")).join(index.vocabulary, "term").select("question", "term", (F.col("_times") * F.col("idf")).alias("weight"))
    return best(index.blocks, asked.checkpoint(), index.statistics.first()["avg_length"], k)


def best(held: DataFrame, asked: DataFrame, average: float, k: int) -> DataFrame:
    """(question, key, score, rank) of ``blocks`` for ``asked`` (question, term, weight), which is read more than once.

    Each range goes whole to one task, once for each block of questions, which a task holds. Range after range the task adds
    up what its documents score, for those questions only whose bound reaches their kth score so far, and passes on k
    documents a question. So neither pairs of questions and postings nor pairs of questions and documents are ever moved.
    A block of questions is as large as what it finds fits in a task, so a task's memory doesn't grow with the questions,
    and the more blocks there are, the more ranges a task meets and the fewer rows are passed on for a question.
    """
    spark = held.sparkSession
    bound_batches(spark)
    size, count = asked.agg(F.sum(F.length("term") + 40), F.count_distinct("question")).first()
    parts = max(1, -(-(size or 0) // ASKED), -(-count * k // POOL))
    slices = -(-4 * int(spark.conf.get("spark.sql.shuffle.partitions")) // parts)
    part = F.pmod(F.xxhash64("question"), F.lit(parts)).cast("int").alias("_part")
    wanted = asked.select(part, "term").distinct()  # a block of questions is dealt the postings that it asks for
    if (wanted.agg(F.sum(F.length("term") + 40)).first()[0] or 0) < BROADCAST:
        wanted = F.broadcast(wanted)
    kinds = dict(asked.dtypes)["question"], dict(held.dtypes)["keys"].removeprefix("array<").removesuffix(">")
    wants = asked.groupBy("question").agg(F.collect_list(F.struct("term", "weight")).alias("_w")).select(part, F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("_slice"), "question", F.col("_w.term").alias("terms"), F.col("_w.weight").alias("weights"))
    rows = held.join(wanted, "term").select("_part", F.pmod(F.xxhash64("range"), F.lit(slices)).cast("int").alias("_slice"), "range", "term", "keys", "tfs", "dls", "bound")
    dealt = wants.unionByName(rows, allowMissingColumns=True).repartition(parts * slices, "_part", "_slice").sortWithinPartitions("_part", "_slice", F.asc_nulls_first("range"))
    found = dealt.mapInArrow(lambda batches: _best(batches, average, k), f"question {kinds[0]}, key {kinds[1]}, score double")
    return top_k_each(found, "question", "score", k, "key")


class _Asked:
    """The questions of a task by their terms, and the best documents of each so far."""

    def __init__(self, k: int):
        self.k, self.rows, self.of = k, [], None
        self.pool: list[tuple[np.ndarray, np.ndarray, pa.Array]] = []
        self.pooled = 0

    def add(self, rows: pa.RecordBatch) -> None:
        self.rows.append(rows)

    def ready(self) -> None:
        asked = pa.Table.from_batches(self.rows)
        self.rows, self.questions = [], asked["question"].combine_chunks()
        lists = asked["terms"].combine_chunks()
        size = np.asarray(lists.value_lengths())
        coded = lists.flatten().dictionary_encode()
        code, weight = np.asarray(coded.indices), np.asarray(asked["weights"].combine_chunks().flatten())
        order = np.argsort(code, kind="stable")
        self.of, self.weight = np.repeat(np.arange(len(size)), size)[order], weight[order]
        self.starts = np.r_[0, np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))]
        self.terms = coded.dictionary
        self.limit = np.full(len(size), 5e-7)  # what is rounded to 0 is never found

    def known(self, rows: pa.RecordBatch) -> pa.RecordBatch | None:
        """Those of a range's rows (term, keys, tfs, dls, bound) whose term is asked, by its number."""
        number = pc.index_in(rows.column("term"), self.terms)
        if number.null_count == len(number):
            return None
        columns = [number, *(rows.column(c) for c in ("keys", "tfs", "dls", "bound"))]
        return pa.RecordBatch.from_arrays(columns, names=["term", "keys", "tfs", "dls", "bound"]).filter(number.is_valid())

    def meet(self, rows: list[pa.RecordBatch], average: float) -> None:
        """One range: ``known`` rows of all its terms."""
        if not rows:
            return
        met = pa.Table.from_batches(rows).combine_chunks()
        term, bound = np.asarray(met["term"]), np.asarray(met["bound"])
        asked = self.starts[term + 1] - self.starts[term]
        row, entry = _spread(self.starts[term], asked)  # each asking of a term, by the term's row
        most = np.bincount(self.of[entry], np.maximum(self.weight[entry], 0) * bound[row], len(self.limit))  # a question has a term once
        open_ = most + 1e-6 >= self.limit
        kept = open_[self.of[entry]]
        row, entry = row[kept], entry[kept]
        if not len(row):
            return
        keys = met["keys"].combine_chunks()
        size = np.asarray(keys.value_lengths()).astype(np.int64)
        keys = keys.flatten().dictionary_encode(null_encoding="encode")
        place = np.asarray(pc.rank(keys.dictionary, sort_keys="ascending", null_placement="at_start", tiebreaker="first")).astype(np.int64) - 1
        own, sorted_ = place[np.asarray(keys.indices)], keys.dictionary.take(pa.array(np.argsort(place)))
        gains = gain(*(np.asarray(met[c].combine_chunks().flatten()) for c in ("tfs", "dls")), average)
        first = np.cumsum(size) - size
        order = np.argsort(self.of[entry], kind="stable")
        row, entry = row[order], entry[order]
        asks = np.flatnonzero(np.r_[True, np.diff(self.of[entry]) > 0, True])  # where each question's entries begin
        pairs = np.r_[0, np.cumsum(size[row])][asks]
        at = 0
        while at < len(asks) - 1:
            to = int(min(at + CHUNK, max(at + 1, np.searchsorted(pairs, pairs[at] + PAIRS, side="right") - 1), len(asks) - 1))
            here = slice(asks[at], asks[to])
            self.score(self.of[entry[asks[at:to]]], np.repeat(np.arange(to - at), np.diff(asks[at : to + 1])), self.weight[entry[here]], row[here], first, size, own, gains, sorted_)
            at = to

    def score(self, chunk: np.ndarray, of: np.ndarray, weight: np.ndarray, row: np.ndarray, first: np.ndarray, size: np.ndarray, own: np.ndarray, gains: np.ndarray, keys: pa.Array) -> None:
        """Some questions of one range, where ``of`` asks ``row`` with ``weight``: of each the k best documents not under its limit go to the pool, ties by key."""
        n, m = len(chunk), len(keys)
        pairs = np.bincount(row, minlength=len(size)) * size
        many = np.flatnonzero(pairs * 400 > n * m)  # what many of these questions share with many documents is a product of matrices
        few = np.ones(len(row), bool)
        scores = np.zeros((n, m))
        if len(many):
            number = np.full(len(size), -1)
            number[many] = np.arange(len(many))
            few = number[row] < 0
            to, pair = _spread(first[many], size[many])
            weights = np.bincount(of[~few] * len(many) + number[row[~few]], weight[~few], n * len(many)).reshape(n, -1)
            scores = weights @ np.bincount(to * m + own[pair], gains[pair], len(many) * m).reshape(-1, m)
        if few.any():
            entry, pair = _spread(first[row[few]], size[row[few]])
            scores += np.bincount(of[few][entry] * m + own[pair], weight[few][entry] * gains[pair], n * m).reshape(n, m)
        np.round(scores, 6, out=scores)
        hit = scores >= self.limit[chunk][:, None]
        over = np.flatnonzero(hit.sum(axis=1) > self.k)
        if len(over):
            kth = np.partition(scores[over], -self.k, axis=1)[:, -self.k]
            self.limit[chunk[over]] = kth
            hit[over] = scores[over] >= kth[:, None]
            tied = over[hit[over].sum(axis=1) > self.k]
            best = np.argsort(-scores[tied], axis=1, kind="stable")[:, : self.k]  # keys are in order
            hit[tied] = False
            hit[tied[:, None], best] = True
        q, d = np.nonzero(hit)
        self.pool.append((chunk[q], scores[q, d], keys.take(pa.array(d))))
        self.pooled += len(q)
        if self.pooled > POOL:
            self.settle()

    def settle(self) -> None:
        """Of the pool each question's k best stay, ties by key, and its kth score is a limit from here on."""
        q, score = (np.concatenate([p[i] for p in self.pool]) for i in (0, 1))
        key = pa.chunked_array([p[2] for p in self.pool]).combine_chunks()
        held = score >= self.limit[q]
        q, score, key = q[held], score[held], key.filter(pa.array(held))
        order = np.lexsort((np.asarray(pc.rank(key, sort_keys="ascending", null_placement="at_start", tiebreaker="dense")), -score, q))
        first = np.r_[True, q[order][1:] != q[order][:-1]]
        rank = np.arange(len(order)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        full = order[rank == self.k - 1]
        self.limit[q[full]] = np.maximum(self.limit[q[full]], score[full])
        kept = order[rank < self.k]
        self.pool, self.pooled = [(q[kept], score[kept], key.take(pa.array(kept)))], 0

    def found(self) -> pa.RecordBatch | None:
        if not self.pool:
            return None
        self.settle()
        q, score, key = self.pool[0]
        return pa.RecordBatch.from_arrays([self.questions.take(pa.array(q)), key, pa.array(score)], names=["question", "key", "score"])


def _spread(first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For runs of ``size`` places from ``first`` on: the run and the place of each."""
    run, ends = np.repeat(np.arange(len(size)), size), np.cumsum(size)
    return run, np.arange(len(run)) + (first - ends + size)[run]


def _best(batches: Iterator[pa.RecordBatch], average: float, k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, slice and range, questions before postings, to k documents a question of each part and slice."""
    own, at, range_, rows = None, None, None, []

    def close() -> pa.RecordBatch | None:
        if own is None or own.of is None:
            return None
        own.meet(rows, average)
        return own.found()

    for batch in batches:
        part, slice_, numbers = (np.asarray(batch.column(c).fill_null(-1)) for c in ("_part", "_slice", "range"))
        postings = np.asarray(batch.column("range").is_valid())
        runs = np.flatnonzero(np.r_[True, (np.diff(part) != 0) | (np.diff(slice_) != 0) | (np.diff(numbers) != 0) | (np.diff(postings.astype(np.int8)) != 0), True][: batch.num_rows]) if batch.num_rows else []
        for i, to in zip(runs, [*runs[1:], batch.num_rows], strict=True):
            if (part[i], slice_[i]) != at:
                if (out := close()) is not None:
                    yield out
                own, at, range_, rows = _Asked(k), (part[i], slice_[i]), None, []
            run = batch.slice(i, to - i)
            if not postings[i]:
                own.add(run)
                continue
            if own.of is None:
                if not own.rows:
                    continue
                own.ready()
            if numbers[i] != range_:
                own.meet(rows, average)
                range_, rows = numbers[i], []
            if (known := own.known(run)) is not None:
                rows.append(known)
    if (out := close()) is not None:
        yield out


def scored_share(index: Index, questions: DataFrame, k: int, question: str = "question", text: str | Column = "text") -> DataFrame:
    """One row (ranges, scored): how many ranges hold a term of a question, and how many of them a search would score."""
    terms = questions.select(F.col(question).alias("question"), F.explode(tokens(text)).alias("term"))
    asked = terms.groupBy("question", "term").agg(F.count("*").alias("_times")).join(index.vocabulary, "term").select("question", "term", (F.col("_times") * F.col("idf")).alias("weight"))
    best = search(index, questions, k, question, text).groupBy("question").agg(F.when(F.count("*") >= k, F.min("score")).alias("_limit"))
    bounds = ranges(index, asked).join(best, "question", "left")
    return bounds.agg(F.count("*").alias("ranges"), F.count_if(F.col("_limit").isNull() | (F.col("most") + 1e-6 >= F.col("_limit"))).alias("scored"))
