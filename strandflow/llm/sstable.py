"""Token ids as sorted-string-table shards: prefix-compressed blocks, sparse index, Bloom filter, footer.

A shard is one file::

    block*  index  bloom  meta  footer

A block holds entries ``shared | rest | value length | rest of key | value`` (numbers as varints),
the first with its whole key, and is stored with zstd. The index has, for each block, its last key,
offset and length. The Bloom filter has BITS_A_KEY bits a key. meta is JSON (documents, tokens,
first and last key, id width). The footer is fixed: three (offset, length) pairs and MAGIC.
Keys are one byte for null (0) or a number (1) and the id as big-endian bytes that sort as signed
numbers do; a value is the document's ids, little-endian. Range partitioning by id makes the shards
disjoint and ascending in order of their names.
"""

from __future__ import annotations

import bisect
import json
import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import Scratch, fs_for, read_tokenizer, ship, slices
from .wordbpe import codec

MAGIC = b"SSTTOK01"
BLOCK = 64 << 10
BITS_A_KEY = 10
PROBES = 7
#: Bytes of text to a shard, about, a document counting DOC_BYTES at least; a table too small for a shard a core is cut down to LEAST_BYTES.
SHARD_BYTES, DOC_BYTES, LEAST_BYTES = 64 << 20, 64, 1 << 20
#: Shards whose tokens are summed up together when starts are worked out.
RUN = 1024
MANIFEST = "shard string, ord int, docs long, tokens long, first long, last long"
FOOTER = struct.Struct("<6Q8s")


def key_of(doc_id: int | None) -> bytes:
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def id_of(key: bytes) -> int | None:
    return None if key == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h >> 64, h & (1 << 64) - 1 | 1
    return [(a + i * b) % bits for i in range(PROBES)]


class Writer:
    """Entries must come in key order; equal keys may repeat."""

    def __init__(self, stream):
        self.stream, self.at, self.block, self.before = stream, 0, bytearray(), b""
        self.index: list[tuple[bytes, int, int]] = []
        self.hashes: list[bytes] = []
        self.pack = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.before)) and key[shared] == self.before[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += value
        self.before = key
        self.hashes.append(key)
        if len(self.block) >= BLOCK:
            self._flush()

    def _put(self, data: bytes) -> tuple[int, int]:
        self.stream.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def _flush(self) -> None:
        if self.block:
            self.index.append((self.before, *self._put(self.pack.compress(bytes(self.block)))))
            self.block = bytearray()

    def close(self, meta: dict) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + _varint(o) + _varint(n) for k, o, n in self.index)
        bits = max(64, BITS_A_KEY * len(self.hashes))
        bloom = bytearray((bits + 7) // 8)
        for key in self.hashes:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        parts = [self._put(x) for x in (index, struct.pack("<Q", bits) + bytes(bloom), json.dumps(meta).encode())]
        self._put(FOOTER.pack(*(x for p in parts for x in p), MAGIC))


class Reader:
    def __init__(self, uri: str):
        system, path = fs_for(uri)
        self.file = system.open_input_file(path)
        *parts, magic = FOOTER.unpack(self._at(self.file.size() - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no shard")
        index, self._bloom, meta = ((parts[i], parts[i + 1]) for i in (0, 2, 4))
        self.meta = json.loads(self._at(*meta))
        self.dtype = np.dtype(self.meta["dtype"])
        self.index, data, at = [], self._at(*index), 0
        while at < len(data):
            n, at = _read_varint(data, at)
            key, at = data[at : at + n], at + n
            offset, at = _read_varint(data, at)
            length, at = _read_varint(data, at)
            self.index.append((key, offset, length))

    def _at(self, offset: int, length: int) -> bytes:
        self.file.seek(offset)
        return self.file.read(length)

    def _block(self, offset: int, length: int):
        data, at, key = zstandard.ZstdDecompressor().decompress(self._at(offset, length)), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, data[at : at + size]
            at += size

    def __iter__(self):
        for _, offset, length in self.index:
            for key, value in self._block(offset, length):
                yield id_of(key), value

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this identifier: Bloom filter, binary search, one block (more if it repeats)."""
        key = key_of(doc_id)
        bloom = self._at(*self._bloom)
        bits = struct.unpack_from("<Q", bloom)[0]
        if not all(bloom[8 + (p >> 3)] >> (p & 7) & 1 for p in _probes(key, bits)):
            return []
        found: list[np.ndarray] = []
        at = bisect.bisect_left(self.index, key, key=lambda x: x[0])
        while at < len(self.index):
            for k, value in self._block(*self.index[at][1:]):
                if k > key:
                    return found
                if k == key:
                    found.append(np.frombuffer(value, self.dtype))
            at += 1
        return found

    def close(self) -> None:
        self.file.close()


def _write(batches, source, folder, end_id):
    words = codec(source.value)
    end = np.array([end_id], words.dtype).tobytes()
    system, path = fs_for(folder)
    part = TaskContext.get().partitionId()
    draft, name = f"{path}/.{part:06d}-{uuid.uuid4().hex}", f"{part:06d}.sst"
    docs = tokens = 0
    first = last = None
    writer = stream = None
    for whole in batches:
        for batch in slices(whole):
            keys = [key_of(i) for i in batch.column("doc_id").to_pylist()]
            for key, ids in zip(keys, words.encode(batch.column("text").to_pylist())):
                if writer is None:
                    stream = system.open_output_stream(draft, compression=None)
                    writer, first = Writer(stream), key
                writer.add(key, ids + end)
                docs, tokens, last = docs + 1, tokens + len(ids) // words.dtype.itemsize + 1, key
    if writer is not None:
        writer.close({"docs": docs, "tokens": tokens, "dtype": words.dtype.str, "first": first.hex(), "last": last.hex()})
        stream.close()
        system.move(draft, f"{path}/{name}")  # a task that runs again puts the same file in its place
        kinds = pa.schema([("shard", pa.string()), ("ord", pa.int32()), *((n, pa.int64()) for n in ("docs", "tokens", "first", "last"))])
        yield pa.RecordBatch.from_pylist([{"shard": name, "ord": part, "docs": docs, "tokens": tokens, "first": id_of(first), "last": id_of(last)}], kinds)


def write_shards(spark: SparkSession, docs: DataFrame, tokenizer: str, folder: str, *, end_id: int = 2) -> DataFrame:
    """Write ``docs`` (doc_id, text) in ascending doc_id order; returns the manifest, one row per shard, kept as a table in ``folder``.

    Shards are cut by bytes of text, so their size and memory don't follow the session's settings; every core has one as long as
    shards keep a megabyte. Documents with a null id come first; of documents with equal ids all are kept, in the order of a hash of their
    texts, and may lie in several shards; a null text is empty; other columns are not read. A shard holds a document whole, however long.
    """
    ship(spark)
    shared = spark.sparkContext.broadcast(read_tokenizer(tokenizer))
    system, path = fs_for(folder)
    system.create_dir(path, recursive=True)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = docs.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + DOC_BYTES)).first()[0] or 0
    shards = max(1, -(-size // SHARD_BYTES), min(spark.sparkContext.defaultParallelism, size // LEAST_BYTES))
    order = [F.col("doc_id"), F.xxhash64("text")]
    ordered = docs.repartitionByRange(shards, *order).sortWithinPartitions(*order).select("doc_id", "text")
    manifest = ordered.mapInArrow(lambda b: _write(b, shared, folder, end_id), MANIFEST)
    manifest.repartition(max(1, shards // 4096), "ord").write.mode("overwrite").parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").orderBy("ord")


def starts(manifest: DataFrame) -> DataFrame:
    """``manifest`` with each shard's first place (``start``): sums within runs of RUN shards, and the sums of the runs before."""
    of_run = F.floor(F.col("ord") / RUN)
    each = manifest.withColumn("run", of_run)
    before = W.orderBy("run").rowsBetween(W.unboundedPreceding, -1)
    runs = each.groupBy("run").agg(F.sum("tokens").alias("whole")).select("run", F.coalesce(F.sum("whole").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("run").orderBy("ord").rowsBetween(W.unboundedPreceding, -1)
    return each.withColumn("inner", F.coalesce(F.sum("tokens").over(within), F.lit(0))).join(runs, "run").withColumn("start", F.col("base") + F.col("inner")).drop("run", "base", "inner")


def _read(batches, folder):
    for batch in batches:
        for name, start in zip(batch.column("shard").to_pylist(), batch.column("start").to_pylist()):
            reader = Reader(f"{folder}/{name}")
            rows: list[tuple] = []
            for doc_id, value in reader:
                ids = np.frombuffer(value, reader.dtype).astype("<u4")
                rows.append((doc_id, start, len(ids), zlib.crc32(ids)))
                start += len(ids)
                if len(rows) == 4096:
                    yield _rows(rows)
                    rows = []
            reader.close()
            if rows:
                yield _rows(rows)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "n_tokens", "ids_crc32")
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=names)


def read_shards(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Per document, as the files have it: where its ids start in the whole, how many, and their checksum. A task reads a shard."""
    ship(spark)
    dealt = starts(manifest).repartitionByRange(max(1, manifest.count()), "ord").select("shard", "start")
    return dealt.mapInArrow(lambda b: _read(b, folder), "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(folder: str, manifest: list, doc_id: int | None) -> list[np.ndarray]:
    """Point lookup over the shards whose key range holds the identifier."""
    found = []
    for row in manifest:
        if key_of(row["first"]) <= key_of(doc_id) <= key_of(row["last"]):
            reader = Reader(f"{folder}/{row['shard']}")
            found += reader.get(doc_id)
            reader.close()
    return found


def roundtrip(spark: SparkSession, docs: DataFrame, tokenizer: str, *, end_id: int = 2) -> DataFrame:
    folder = Scratch(spark, "sstable").path("shards")
    return read_shards(spark, folder, write_shards(spark, docs, tokenizer, folder, end_id=end_id))
