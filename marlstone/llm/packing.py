"""Best-fit-decreasing packing of token sequences, certified by dual-feasible functions and repacked where a gap is left."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, cut, slices
from .tokens import default_tokenizer, encoder

LENGTH = 2048
#: The id that ends a document.
END = 0
#: Pieces that one task packs.
PIECES = 25_000
_TEXTUAL = "doc_id string, piece int, start long, length long, ids_crc32 long"
#: Pieces that a task packs at most once exchanging no longer helps.
MOST_PIECES = 8 * PIECES
#: Where a turn lowers the number of bins by a smaller share, the next one has larger tasks.
GAIN = 1e-4
#: Bits of a task among the tasks of a turn and of a bin in a task; the rest of a sequence_id tells turns apart.
TASK_BITS, BIN_BITS = 36, 20


def _pieces(path: str, length: int, end: int, order: bool):
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for batch in (piece for whole in batches for piece in slices(whole)):
            rows = []
            places = batch["_order"].tolist() if order else [0] * len(batch)
            for doc_id, place, ids in zip(batch["doc_id"].tolist(), places, enc.encode(batch["text"].tolist()), strict=True):
                ids += last
                for k, at in enumerate(range(0, len(ids), 4 * length)):
                    part = ids[at : at + 4 * length]
                    rows.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), place))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", "_order"])
            yield out

    return run


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END, order: Column | None = None) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut at ``length`` where longer.

    Null texts are empty: the end id alone. Null doc_ids stay null; repeated rows give their pieces each; texts of any
    length are encoded whole; an empty table gives no pieces; other columns are dropped. With ``order``, a string by which
    sequences shall follow each other, there is a column ``_order``.
    """
    bound_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    place = [] if order is None else [order.alias("_order")]
    # A long beside a null would reach pandas as a floating-point number, so identifiers go there as text.
    rows = docs.select(F.col("doc_id").cast("string"), F.coalesce("text", F.lit("")).alias("text"), *place)
    out = rows.mapInPandas(_pieces(path, length, end, order is not None), _TEXTUAL + (", _order string" if place else ", _order long"))
    out = out.withColumn("doc_id", F.col("doc_id").cast("long"))
    return out if place else out.drop("_order")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """The bin of each size, placed from the largest down into the fullest bin that has room; and the number of bins."""
    order = np.argsort(-sizes, kind="stable")
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    rooms, bins = 0, 0  # the bit of each room that some bin has
    out = np.empty(len(sizes), dtype=np.int64)
    for i in order.tolist():
        s = int(sizes[i])
        fits = rooms >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            b = open_[room].pop()
            if not open_[room]:
                rooms ^= 1 << room
        else:
            room, b, bins = capacity, bins, bins + 1
        out[i] = b
        open_[room - s].append(b)
        rooms |= 1 << (room - s)
    return out, bins


def lower_bound(sizes: np.ndarray, capacity: int) -> int:
    """No packing of ``sizes`` has fewer bins: the best of several dual-feasible functions.

    f_e drops sizes under e and rounds those over capacity - e up to a whole bin; u_k rounds (k + 1) x / capacity down
    unless it is whole. For both, sizes that fit a bin together never sum to more than the bin.
    """
    return bound_of(np.bincount(sizes, minlength=capacity + 1), capacity)


def bound_of(count: np.ndarray, capacity: int) -> int:
    """``lower_bound`` from the number of pieces of each length."""
    x = np.arange(capacity + 1)
    mass, many = np.cumsum(count * x), np.cumsum(count)
    best = -(-int(mass[-1]) // capacity)
    e = np.arange(1, capacity // 2 + 1)
    total = (many[-1] - many[capacity - e]) * capacity + mass[capacity - e] - mass[e - 1]
    best = max(best, -(-int(total.max()) // capacity))
    for k in range(1, 20):
        exact = (k + 1) * x % capacity == 0
        u = np.where(exact, x * k, (k + 1) * x // capacity * capacity)  # times k
        best = max(best, -(-int((count * u).sum()) // (k * capacity)))
    return best


_PACKED = _TEXTUAL + ", _bin long, _open boolean, offset long"


def _pack(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "doc_id", "piece", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        sizes = rows["length"].to_numpy()
        bins, n = best_fit(sizes, capacity)
        room = capacity - np.bincount(bins, sizes, n).astype(np.int64)
        by = np.argsort(bins, kind="stable")
        ahead = np.cumsum(sizes[by]) - sizes[by]
        first = np.flatnonzero(np.r_[True, np.diff(bins[by]) != 0])
        offset = np.empty(len(sizes), dtype=np.int64)
        offset[by] = ahead - np.repeat(ahead[first], np.diff(np.r_[first, len(by)]))
        return rows.assign(_bin=bins, _open=(room > 0)[bins], offset=offset)

    return run


def pack(parts: DataFrame, length: int = LENGTH, per_task: int = PIECES) -> DataFrame:
    """``parts`` (as from ``pieces``) with sequence_id and offset.

    Pieces are dealt to tasks by a hash, or in ranges of ``_order`` where that is given, and packed best-fit-decreasing. A
    task with more bins than its lower bound has a gap; one that meets it is certified, and what it can still give is less
    than a bin. Full bins stay. The bins with room are given up: their pieces are dealt anew and packed again. This goes on
    while it lowers the number of bins; where it hardly does, the pieces are dealt to fewer, larger tasks, of MOST_PIECES at
    most. It ends early where the number of bins is the lower bound of all pieces together, or all tasks are full.
    Only pieces of open bins move. Nulls, repeated rows and pieces of equal length are told apart by nothing, and needn't
    be; no pieces give no sequences.
    """
    ordered = "_order" in parts.columns
    columns = [c for c in parts.columns if c != "_order"]
    todo = cut(parts.withColumn("doc_id", F.col("doc_id").cast("string")))
    lengths = _lengths(todo, length)
    n, least, turn, most = int(lengths.sum()), bound_of(lengths, length), 0, max(MOST_PIECES, per_task)
    done, closed, best, open_ = None, 0, None, None  # bins that stay and their number; the number of all bins, and the open ones, as best so far
    while True:
        tasks = max(1, -(-n // per_task))
        if ordered and turn == 0:
            dealt = todo.repartitionByRange(tasks, "_order", "piece").withColumn("_part", F.spark_partition_id().cast("long"))
        else:
            dealt = todo.withColumn("_part", F.pmod(F.xxhash64("doc_id", "piece", F.monotonically_increasing_id(), F.lit(turn)), F.lit(tasks)) + (turn << TASK_BITS))
        packed = cut(dealt.select(*columns, "_part").groupBy("_part").applyInPandas(_packed(length), _PACKED + ", _part long"))
        first = F.col("offset") == 0  # one piece of each bin
        bins, still, released = packed.agg(F.count_if(first), F.count_if("_open"), F.count_if(first & F.col("_open"))).first()
        turn += 1
        if best is None or closed + bins < best:
            if best is not None and best - closed - bins < GAIN * best:
                per_task = min(most, 4 * per_task)
            best, n, open_ = closed + bins, still, packed.where("_open")
            fixed = packed.where("NOT _open")
            done = fixed if done is None else done.unionByName(fixed)
            closed, todo = best - released, open_.select(*columns)
            if best <= least or not n or tasks == 1:
                break
        elif tasks == 1 or per_task >= most or turn >= 1 << 63 - TASK_BITS - BIN_BITS:
            break
        else:
            per_task = min(most, 4 * per_task)
    result = done.unionByName(open_)
    return result.select(F.col("doc_id").cast("long").alias("doc_id"), *[c for c in columns if c != "doc_id"], (F.shiftleft("_part", BIN_BITS) + F.col("_bin")).alias("sequence_id"), "offset")


def _packed(capacity: int):
    pack_ = _pack(capacity)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pack_(rows.drop(columns="_part")).assign(_part=key[0])

    return run


def _lengths(parts: DataFrame, length: int) -> np.ndarray:
    """The number of pieces of each of the at most ``length`` different lengths."""
    count = np.zeros(length + 1, dtype=np.int64)
    for r in parts.groupBy("length").count().collect():
        count[r["length"]] = r["count"]
    return count


def certificate(parts: DataFrame, length: int = LENGTH) -> int:
    """The lower bound for all pieces together."""
    return bound_of(_lengths(parts, length), length)
