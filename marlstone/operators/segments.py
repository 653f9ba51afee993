"""A search index that changes: versions of segments with what they replace, merged as they are read."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import postings
from .search import FLOOR
from .shared import checkpoints

_SEGMENTS = "version long, segments array<long>"


class SegmentedIndex:
    """An index under ``path``: each change is a segment of its own, and a version is the list of segments that make it up.

    A segment holds the documents it brings, a row each with its terms and their numbers, the number of documents of each term, and the keys that it
    takes from all segments before it. Nothing is ever rewritten: a change writes its segment first and then one row in
    ``manifest``, which makes it visible; what fails before leaves the version before in force. A reader keeps the version
    that it started with. ``compact`` writes all that is live as one segment, and older ones may go.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "key", text: str = "text"):
        checkpoints(spark)
        self.spark, self.path, self.key, self.text = spark, path.rstrip("/"), key, text

    def versions(self) -> DataFrame:
        """(version, segments), none for a new index."""
        try:
            return self.spark.read.schema(_SEGMENTS).parquet(f"{self.path}/manifest")
        except AnalysisException:
            return self.spark.createDataFrame([], _SEGMENTS)

    def latest(self) -> tuple[int, list[int]]:
        row = self.versions().orderBy(F.desc("version")).first()
        return (row["version"], list(row["segments"])) if row else (0, [])

    def _commit(self, rows: DataFrame | None, dead: DataFrame | None, keep: bool) -> int:
        """Writes a segment of counted rows, which take their own keys, or of dead keys, and the version that adds it, or that consists of it alone."""
        last, segments = self.latest()
        version = last + 1
        at = f"{self.path}/segment-{version:010d}"
        # A segment that a failed change left behind belongs to no version, so it may be written over.
        if rows is not None:
            rows.write.mode("overwrite").parquet(f"{at}/counted")
            counted = self.spark.read.parquet(f"{at}/counted")
            counted.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).write.mode("overwrite").parquet(f"{at}/vocabulary")
            dead = counted.select("key") if keep else None
        if dead is not None:
            dead.select("key").distinct().write.mode("overwrite").parquet(f"{at}/dead")
        made = self.spark.createDataFrame([(version, [*(segments if keep else []), version])], _SEGMENTS)
        made.coalesce(1).write.mode("error").parquet(f"{self.path}/manifest/commit={version:010d}")  # two writers of one version: one of them fails
        return version

    def upsert(self, docs: DataFrame) -> int:
        """Adds ``docs``, in place of whatever has their keys; of rows with one key within ``docs`` one is kept. The new version."""
        rows = docs.select(F.col(self.key).alias("key"), F.col(self.text).alias("_text")).where("key IS NOT NULL")
        rows = rows.groupBy("key").agg(F.max(F.coalesce("_text", F.lit(""))).alias("_text"))
        return self._commit(postings.counted(rows, "key", "_text"), None, keep=True)

    def delete(self, keys: DataFrame) -> int:
        """Removes documents by key; unknown keys change nothing. The new version."""
        return self._commit(None, keys.select(F.col(self.key).alias("key")).where("key IS NOT NULL"), keep=True)

    def compact(self) -> int:
        """One segment of all that is live. Versions before it can still be read."""
        return self._commit(self.documents(), None, keep=False)

    def _tables(self, name: str, version: int | None) -> DataFrame | None:
        """A table of all segments of a version with ``_segment``; segments without it are left out."""
        held = None if version is None else self.versions().where(F.col("version") == version).first()
        segments = self.latest()[1] if version is None else held["segments"] if held else []
        found = None
        for s in segments:
            try:
                part = self.spark.read.parquet(f"{self.path}/segment-{s:010d}/{name}").withColumn("_segment", F.lit(s).cast("long"))
            except AnalysisException:
                continue
            found = part if found is None else found.unionByName(part)
        return found

    def _split(self, version: int | None) -> tuple[DataFrame | None, DataFrame | None]:
        """Counted rows of all segments, and for each key the last segment that takes it."""
        dead = self._tables("dead", version)
        return self._tables("counted", version), None if dead is None else dead.groupBy("key").agg(F.max("_segment").alias("_until"))

    def documents(self, version: int | None = None) -> DataFrame:
        """(key, dl, terms, tfs) of the live documents."""
        rows, dead = self._split(version)
        if rows is None:
            return self.spark.createDataFrame([], "key long, dl int, terms array<string>, tfs array<int>")
        if dead is not None:
            rows = rows.join(dead, "key", "left").where(F.col("_until").isNull() | (F.col("_segment") >= F.col("_until")))
        return rows.select("key", "dl", "terms", "tfs")

    def postings(self, version: int | None = None) -> DataFrame:
        """(key, term, tf, dl) of the live documents."""
        return self.documents(version).select("key", "dl", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf")))).select("key", "term", "tf", "dl")

    def vocabulary(self, version: int | None = None) -> DataFrame:
        """(term, df) of the live documents: the segments' own counts less the terms of what was taken from them."""
        counts = self._tables("vocabulary", version)
        if counts is None:
            return self.spark.createDataFrame([], "term string, df long")
        rows, dead = self._split(version)
        total = counts.select("term", "df")
        if dead is not None:
            gone = rows.join(dead, "key").where("_segment < _until").select(F.explode("terms").alias("term")).groupBy("term").agg((-F.count("*")).alias("df"))
            total = total.unionByName(gone)
        return total.groupBy("term").agg(F.sum("df").alias("df")).where("df > 0")

    def search(self, questions: DataFrame, k: int, question: str = "question", text: str | Column = "text", version: int | None = None) -> DataFrame:
        """(question, key, score, rank): what a search of an index built anew from the live documents returns, ties by key."""
        from ..functions.text import tokens

        version = self.latest()[0] if version is None else version
        live = self.documents(version)
        statistics = live.agg(F.count("*").alias("_n"), F.avg("dl").alias("_average")).checkpoint()  # one row
        raw = self.vocabulary(version).crossJoin(F.broadcast(statistics.select("_n"))).withColumn("_idf", F.log(F.col("_n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).checkpoint()
        mean = F.broadcast(raw.agg(F.avg("_idf").alias("_mean")))  # one row
        terms = questions.select(F.col(question).alias("question"), F.explode(tokens(text)).alias("term")).groupBy("question", "term").agg(F.count("*").alias("_times"))
        asked = terms.join(raw, "term").crossJoin(mean).select("question", "term", (F.col("_times") * F.when(F.col("_idf") < 0, FLOOR * F.col("_mean")).otherwise(F.col("_idf"))).alias("weight"))
        average = statistics.first()["_average"] or 0.0
        return postings.best(postings.blocks(live, average), asked.checkpoint(), average, k)
