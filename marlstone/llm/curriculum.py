"""Mixing sources to target weights with a time-varying curriculum. DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, dense_rank, fresh_names, global_order, partitions

#: Weights of the sources by code point, repeating; at most so many passes over a source.
WEIGHTS = (5, 2, 1)
PASSES = 3
#: How a source's weight changes over the run: w(t) = 1 + slope * (2 t - 1), by the same order, repeating.
SLOPES = (-0.5, 0.0, 0.5)
#: Documents that a bucket of a source may have on average.
BUCKET_ROWS = 10_000


def _cycle(values: tuple, rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.pmod(rank, F.lit(len(values))) + 1).cast("int"))


def source_plan(sizes: DataFrame, weights=WEIGHTS, slopes=SLOPES, passes: int = PASSES, share: float = 1.0) -> DataFrame:
    """(_src, source_size, target, _slope) from (_src, source_size): one row for each source.

    Targets are in proportion to the weights and sum to ``share`` of all words; where one would pass ``passes`` times its
    source it stops there and the rest is shared anew, until none is above. Each round is one aggregate over the sources,
    and more of them stop in each; sources are numbered by a range sort, so that however many there are, none gathers them.
    """
    ordered = global_order(sizes.withColumn("_all", F.lit(0)), ["_all", "_src"])
    ranked = dense_rank(ordered, ["_all"], "_rank").drop("_all").withColumn("_w", _cycle(weights, F.col("_rank"))).withColumn("_slope", _cycle(slopes, F.col("_rank")))
    ranked = cut(ranked.withColumn("_limit", F.col("source_size") * passes))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, stopped = None, -1
    while True:
        stops = F.lit(False) if level is None else F.col("_limit") / F.col("_w") <= F.lit(level)
        held, weight, many = ranked.agg(F.sum(F.when(stops, F.col("_limit"))), F.sum(F.when(~stops, F.col("_w"))), F.count(F.when(stops, 1))).first()
        if many == stopped or not weight:
            break
        stopped, level = many, (total * share - (held or 0)) / weight
    level = F.lit(0.0 if level is None else level)
    target = F.when(F.col("_limit") / F.col("_w") <= level, F.col("_limit").cast("double")).otherwise(level * F.col("_w"))
    return ranked.withColumn("target", target).select("_src", "source_size", "target", "_slope")


def position(share: Column, slope: Column) -> Column:
    """The time in 0..1 by which a source has served ``share`` of its words: its weight's integral, inverted.

    The integral of 1 + s (2 t - 1) is (1 - s) t + s t^2.
    """
    b = 1 - slope
    return F.when(slope == 0, share).otherwise((F.sqrt(b * b + 4 * slope * share) - b) / (2 * slope))


def sized(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> Column:
    """What the plan needs of a document: its size in words, its source (null last) and a hash of its doc_id."""
    src = F.when(F.col(source).isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), F.col(source)))
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return F.struct(size.alias("size"), src.alias("src"), F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).alias("hash"))


def plan(docs: DataFrame, key: str, **options) -> DataFrame:
    """``docs``, whose column ``key`` is from ``sized``, with more fields in it: source_size, target, taken, copies, middle and slope.

    Within a source, documents stand in the order of a hash of their doc_id. Whole passes take every document; of the
    last pass, those are taken whose middle comes before the words that remain, so a source misses its target by at
    most half a document. The running sums are those of hash buckets plus those within a bucket, and buckets are as many
    as the documents need, so that no source is gathered in one task. Null source: its own, last. Null doc_id: hashed
    as empty. Null text: size 0. Repeated rows count each. An empty table gives none. Columns keep their names.
    """
    slim = cut(docs.select(F.col(f"{key}.src").alias("_src"), F.col(f"{key}.hash").alias("_hash"), F.col(f"{key}.size").alias("_size")))
    n, digits = slim.count(), 3
    while 16**digits * BUCKET_ROWS < n and digits < 12:
        digits += 1
    buckets = cut(slim.groupBy("_src", F.substring("_hash", 1, digits).alias("_bucket")).agg(F.sum("_size").alias("_words")))
    plans = source_plan(buckets.groupBy("_src").agg(F.sum("_words").alias("source_size")), **options)
    ahead = Window.partitionBy("_src").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    buckets = buckets.withColumn("_ahead", F.coalesce(F.sum("_words").over(ahead), F.lit(0))).join(plans, "_src")
    src, bucket, at = fresh_names(docs, "src", "bucket", "at")
    placed = docs.withColumns({src: F.col(f"{key}.src"), bucket: F.substring(F.col(f"{key}.hash"), 1, digits)})
    inner = Window.partitionBy(src, bucket).orderBy(F.col(f"{key}.hash"), F.col(f"{key}.size")).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn(at, F.coalesce(F.sum(F.col(f"{key}.size")).over(inner), F.lit(0)))
    fields = F.struct("_ahead", "source_size", "target", F.col("_slope").alias("slope")).alias("_plan")
    (held,) = fresh_names(docs, "plan")
    placed = placed.join(buckets.select(F.col("_src").alias(src), F.col("_bucket").alias(bucket), fields.alias(held)), [src, bucket])
    size, target, whole = F.col(f"{key}.size"), F.col(f"{held}.target"), F.col(f"{held}.source_size")
    middle = F.col(f"{held}._ahead") + F.col(at) + size / 2.0
    passes = F.floor(F.when(whole > 0, target / whole).otherwise(F.lit(0.0)))
    rest = target - passes * whole
    copies = (passes + F.when((rest > 0) & (middle <= rest), 1).otherwise(0)).cast("int")
    more = {"source_size": whole, "target": target, "slope": F.col(f"{held}.slope"), "middle": middle, "copies": copies, "taken": size * copies}
    new = F.struct(*[F.col(f"{key}.{f}").alias(f) for f in ("size", "src", "hash")], *[c.alias(f) for f, c in more.items()])
    return placed.withColumn(key, new).select(*docs.columns)


def when_read(key: str, copy: Column) -> Column:
    """The training position in 0..1 of a planned document's copy, numbered from 0."""
    target = F.col(f"{key}.target")
    share = F.when(target > 0, (copy * F.col(f"{key}.source_size") + F.col(f"{key}.middle")) / target).otherwise(F.lit(0.0))
    return position(F.least(share, F.lit(1.0)), F.col(f"{key}.slope"))


def mix(docs: DataFrame, place: str | None = None, **options) -> DataFrame:
    """The training stream: each document as often as the mix takes it, range-sorted by position; the columns of ``docs``, and the position as ``place``."""
    key, copy, at = fresh_names(docs, "mix", "copy", "at")
    planned = plan(docs.withColumn(key, sized(docs)), key, **options).where(F.col(f"{key}.copies") > 0)
    copies = planned.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(f"{key}.copies") - 1)))
    copies = copies.withColumn(at, when_read(key, F.col(copy)))
    sort = [F.col(at), F.col(f"{key}.hash"), F.col(copy)]
    placed = copies.repartitionByRange(partitions(docs.sparkSession), *sort).sortWithinPartitions(*sort)
    return placed.select(*docs.columns, *([F.col(at).alias(place)] if place else []))
