"""Token ids in sorted-string-table shards.

A shard is a file of documents in ascending key order:

* data blocks: entries of (bytes shared with the key before, rest of the key, the value's length, the value), lengths
  as LEB128; each block starts with a whole key and is deflated by zstd;
* an index: for each block its last key, offset and stored length;
* a Bloom filter over the keys;
* a footer of fixed size: where index and filter are, their lengths, documents, ids, and the magic number.

A key is the doc_id as 8 bytes that sort like the number, then 4 bytes that number repeats of a doc_id in the shard.
A value is the document's ids as little-endian unsigned 32-bit integers.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, partitions, shared_dir, slices
from .tokens import default_tokenizer, encoder

MAGIC = b"MSSTABL1"
FOOTER = struct.Struct("<QQQQQQ8s")
END = 2
#: Bytes of a block before compression; of a shard file; bits a key has in the filter; hash functions.
BLOCK, SHARD, FILTER_BITS, FILTER_HASHES = 64 << 10, 64 << 20, 10, 7
#: A null doc_id sorts first.
NULL = -(1 << 63)


def key_of(doc_id: int, repeat: int = 0) -> bytes:
    return struct.pack(">QI", doc_id + (1 << 63), repeat)


def _leb(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _unleb(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(doc_id: int, bits: int) -> list[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(struct.pack(">Q", doc_id + (1 << 63)))
    a, b = h >> 64, h & (1 << 64) - 1 | 1
    return [(a + i * b) % bits for i in range(FILTER_HASHES)]


class Writer:
    """Builds one shard in memory from entries in key order."""

    def __init__(self):
        from pyarrow import Codec

        self.codec = Codec("zstd", compression_level=1)
        self.file, self.index, self.keys = bytearray(), bytearray(), []
        self.block, self.last, self.ids = bytearray(), b"", 0
        self.before: tuple[int, int] = (NULL, -1)

    def add(self, doc_id: int, value: bytes) -> None:
        repeat = self.before[1] + 1 if self.before[0] == doc_id and self.keys else 0
        self.before = (doc_id, repeat)
        key = key_of(doc_id, repeat)
        shared = 0
        if self.block:
            while shared < len(key) and key[shared] == self.last[shared]:
                shared += 1
        self.block += _leb(shared) + _leb(len(key) - shared) + key[shared:] + _leb(len(value)) + value
        self.last = key
        self.keys.append(doc_id)
        self.ids += len(value) // 4
        if len(self.block) >= BLOCK:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            stored = _leb(len(self.block)) + self.codec.compress(bytes(self.block), asbytes=True)
            self.index += _leb(len(self.last)) + self.last + _leb(len(self.file)) + _leb(len(stored))
            self.file += stored
            self.block = bytearray()

    def finish(self) -> bytes:
        self._flush()
        bits = max(64, FILTER_BITS * len(self.keys))
        bloom = bytearray(-(-bits // 8))
        for k in self.keys:
            for p in _probes(k, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        at = len(self.file)
        foot = FOOTER.pack(at, len(self.index), at + len(self.index), bits, len(self.keys), self.ids, MAGIC)
        return bytes(self.file) + bytes(self.index) + bytes(bloom) + foot


class Reader:
    """A shard's bytes: ordered scans, and lookups by filter, binary search of the index and one block."""

    def __init__(self, raw: bytes):
        from pyarrow import Codec

        self.codec, self.raw = Codec("zstd"), raw
        at, length, self.bloom, self.bits, self.documents, self.ids, magic = FOOTER.unpack(raw[-FOOTER.size :])
        if magic != MAGIC:
            raise ValueError("not a shard, or cut short")
        self.index: list[tuple[bytes, int, int]] = []
        end = at + length
        while at < end:
            n, at = _unleb(raw, at)
            key, at = raw[at : at + n], at + n
            offset, at = _unleb(raw, at)
            stored, at = _unleb(raw, at)
            self.index.append((key, offset, stored))

    def _block(self, k: int) -> Iterator[tuple[int, bytes]]:
        _, offset, stored = self.index[k]
        size, at = _unleb(self.raw, offset)
        block = self.codec.decompress(self.raw[at : offset + stored], size, asbytes=True)
        at, key = 0, b""
        while at < size:
            shared, at = _unleb(block, at)
            n, at = _unleb(block, at)
            key, at = key[:shared] + block[at : at + n], at + n
            n, at = _unleb(block, at)
            yield struct.unpack(">Q", key[:8])[0] - (1 << 63), block[at : at + n]
            at += n

    def scan(self) -> Iterator[tuple[int, bytes]]:
        for k in range(len(self.index)):
            yield from self._block(k)

    def get(self, doc_id: int) -> list[bytes]:
        """The values of all rows with this doc_id; empty if there is none."""
        if any(not self.raw[self.bloom + (p >> 3)] >> (p & 7) & 1 for p in _probes(doc_id, self.bits)):
            return []
        low, high, first = 0, len(self.index), key_of(doc_id)
        while low < high:
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < first else (low, mid)
        out = []
        for k in range(low, len(self.index)):
            for d, value in self._block(k):
                if d > doc_id:
                    return out
                if d == doc_id:
                    out.append(value)
        return out


def _store(uri: str):
    """The file system of a URI, as tasks see it: local shared folders, and the stores that pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else "file://" + uri.removeprefix("file:"))


_MANIFEST = "task int, seq int, documents long, ids long"


def _write(path: str, uri: str, end: int):
    last = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        enc, task, seq, writer = encoder(path), TaskContext.get().partitionId(), 0, Writer()
        store, base = _store(uri)

        def close() -> pd.DataFrame:
            """A retried or doubled task writes the same bytes under the same name; the rename shows only whole files."""
            name, part = f"{base}/{task:08d}-{seq:06d}.sst", f"{base}/.{uuid4().hex}"
            store.create_dir(base, recursive=True)
            with store.open_output_stream(part) as out:
                out.write(writer.finish())
            store.move(part, name)
            return pd.DataFrame([(task, seq, len(writer.keys), writer.ids)], columns=["task", "seq", "documents", "ids"])

        for batch in (piece for whole in batches for piece in slices(whole)):
            for doc_id, ids in zip(batch["doc_id"].tolist(), enc.encode(batch["text"].tolist()), strict=True):
                writer.add(doc_id, ids + last)
                if len(writer.file) >= SHARD:
                    yield close()
                    seq, writer = seq + 1, Writer()
        if writer.keys:
            yield close()

    return run


def write(docs: DataFrame, uri: str, tokenizer: str | None = None, end: int = END) -> DataFrame:
    """Writes every row of ``docs`` to shards under ``uri`` and returns their manifest: (task, seq, documents, ids).

    Texts are encoded whole, null as empty, and ``end`` is appended. Shards hold ascending ranges of doc_id, null first;
    repeated doc_ids stand in the order of a hash of their text. An empty table writes no shard.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    placed = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order)
    made = placed.mapInPandas(_write(tokenizer or default_tokenizer(), uri, end), _MANIFEST).collect()  # a row for each file
    return spark.createDataFrame([tuple(r) for r in made], _MANIFEST)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for file, raw in zip(batch["path"], batch["content"], strict=True):
            task, seq = map(int, file.rsplit("/", 1)[1].removesuffix(".sst").split("-"))
            start, rows = 0, []
            for doc_id, value in Reader(raw).scan():
                rows.append((None if doc_id == NULL else doc_id, start, len(value) // 4, zlib.crc32(value)))
                start += len(value) // 4
                if len(rows) == 20_000:
                    yield _rows(task, seq, rows)
                    rows = []
            yield _rows(task, seq, rows)


def _rows(task: int, seq: int, rows: list) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "at", "n_tokens", "ids_crc32"])
    return out.assign(doc_id=out["doc_id"].astype("Int64"), task=task, seq=seq)


def read_digest(spark: SparkSession, uri: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the shards; start counts the ids of all documents before."""
    if not manifest.take(1):
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(uri).select("path", "content")
    rows = files.mapInPandas(_read, "doc_id long, at long, n_tokens long, ids_crc32 long, task int, seq int")
    ahead = Window.orderBy("task", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    starts = manifest.select("task", "seq", F.coalesce(F.sum("ids").over(ahead), F.lit(0)).alias("_before"))
    joined = rows.join(starts, ["task", "seq"])
    return joined.select("doc_id", (F.col("_before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes ``docs`` to the shared folder and digests what is read back."""
    uri = f"{shared_dir(docs.sparkSession)}/sst-{uuid4().hex}"
    return read_digest(docs.sparkSession, uri, write(docs, uri, tokenizer))
