"""BAM as a Spark data source: ranges of compressed blocks are tasks, records are decoded in Arrow batches.

A task owns the records that start in the blocks of its range. It finds the first of them by looking for bytes that read as a
record and are followed by CHAIN more; the task before it, whose records are sure, ends at that very place or the read fails.
So no record is lost or read twice unnoticed, however many tasks a file has.
"""

from __future__ import annotations

import fnmatch
import os
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "sample string, ord long, name string, flag int, rname string, pos long, mapq int, cigar string, seq string, qual string"
#: Records that have to follow a place for it to count as a record's start; compressed bytes to a task; bytes of a batch.
CHAIN, SPLIT, BATCH = 8, 32 << 20, 4 << 20
#: Fixed by the format: letters of four bits, operations, secondary and supplementary, reverse strand.
LETTERS, OPS, NOT_PRIMARY, REVERSE = "=ACMGRSVTWYHKDBN", "MIDNSHP=X", 0x900, 0x10
HEAD = struct.Struct("<iiBBHHHiiii")
PAIRS = np.array([[ord(LETTERS[b >> 4]), ord(LETTERS[b & 15])] for b in range(256)], np.uint8)
MAX_BLOCK = 1 << 16


def _system(path: str):
    from pyarrow import fs

    where = re.sub(r"^file:/*", "/", path)
    return fs.FileSystem.from_uri(where if "://" in where else os.path.abspath(where))


def _files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, of a folder's BAM files or of a pattern within a folder."""
    from pyarrow import fs

    system, where = _system(path)
    folder, name = os.path.split(where)
    if any(c in name for c in "*?["):
        found = [i for i in system.get_file_info(fs.FileSelector(folder)) if fnmatch.fnmatch(i.base_name, name)]
    else:
        info = system.get_file_info(where)
        if info.type == fs.FileType.NotFound:
            raise ValueError(f"no such file or folder: {path}")
        found = [info]
        if info.type == fs.FileType.Directory:
            found = [i for i in system.get_file_info(fs.FileSelector(where)) if i.base_name.endswith(".bam")]
    return sorted((i.path, i.size) for i in found if i.type == fs.FileType.File)


def _block(raw: bytes) -> tuple[int, int] | None:
    """(whole size, start of the data) of the block whose header ``raw`` begins with; null if it isn't one."""
    if len(raw) < 18 or raw[:4] != b"\x1f\x8b\x08\x04":
        return None
    extra = struct.unpack_from("<H", raw, 10)[0]
    at, end = 12, 12 + extra
    while at + 4 <= min(end, len(raw)):
        tag, size = raw[at : at + 2], struct.unpack_from("<H", raw, at + 2)[0]
        if tag == b"BC" and size == 2 and at + 6 <= len(raw):
            return struct.unpack_from("<H", raw, at + 4)[0] + 1, end
        at += 4 + size
    return None


def _blocks(file, size: int, at: int):
    """(place, letters) of the blocks from one on, each checked by its length and checksum."""
    while at < size:
        raw = file.read_at(min(MAX_BLOCK, size - at), at)
        head = _block(raw)
        if head is None or head[0] > len(raw):
            raise ValueError(f"no whole block at byte {at}")
        try:
            data = zlib.decompress(raw[head[1] : head[0] - 8], -15)
        except zlib.error as e:
            raise ValueError(f"broken block at byte {at}: {e}") from None
        if struct.unpack_from("<II", raw, head[0] - 8) != (zlib.crc32(data), len(data)):
            raise ValueError(f"checksum of the block at byte {at}")
        yield at, data
        at += head[0]


def _records(file, size: int, at: int, skip: int, until: int):
    """(place, record) of records from one's start on that start in blocks before ``until``, then (where the next one starts, null)."""
    left, mark = b"", (at, skip)
    for block, data in _blocks(file, size, at):
        base, skip = skip, 0
        text, known, p = left + data[base:], len(left), 0
        while p < len(text):
            mark = mark if p < known else (block, base + p - known)
            if mark[0] >= until:
                yield mark, None
                return
            if len(text) - p < 4:
                break
            length = struct.unpack_from("<i", text, p)[0]
            if length < 32:
                raise ValueError(f"record of {length} bytes in the block at byte {mark[0]}")
            if len(text) - p < 4 + length:
                break
            yield mark, text[p + 4 : p + 4 + length]
            p += 4 + length
        left = text[p:]
    if left:
        raise ValueError("truncated record at the end of the file")
    yield (size, 0), None


def _header(file, size: int) -> tuple[list[str], int, int]:
    """Names of the contigs, and where the first record starts."""
    text, ends, need = b"", [], 12
    source = _blocks(file, size, 0)

    def more(upto):
        nonlocal text
        while len(text) < upto:
            block = next(source, None)
            if block is None:
                raise ValueError("truncated header")
            ends.append((len(text), block[0]))
            text += block[1]

    more(need)
    if text[:4] != b"BAM\1":
        raise ValueError("not a BAM file")
    at = 8 + struct.unpack_from("<i", text, 4)[0]
    more(at + 4)
    names, count = [], struct.unpack_from("<i", text, at)[0]
    at += 4
    for _ in range(count):
        more(at + 4)
        n = struct.unpack_from("<i", text, at)[0]
        more(at + 8 + n)
        names.append(text[at + 4 : at + 3 + n].decode())
        at += 8 + n
    begin, block = [e for e in ends if e[0] <= at][-1]
    return names, block, at - begin


def _plausible(record: bytes, contigs: int) -> bool:
    ref, pos, n_name, _, _, ops, _, n, mate, mate_pos, _ = HEAD.unpack_from(record)
    fixed = 32 + n_name + 4 * ops + (n + 1) // 2 + n
    if not (-1 <= ref < contigs and -1 <= mate < contigs and pos >= -1 and mate_pos >= -1 and n >= 0 and n_name and fixed <= len(record)):
        return False
    name = record[32 : 32 + n_name]
    return name[-1] == 0 and all(33 <= c <= 126 for c in name[:-1])


def _follows(file, size: int, block: int, at: int, contigs: int) -> bool:
    """Whether a record starts here and so many others follow it, or the file ends."""
    try:
        for i, (_, record) in enumerate(_records(file, size, block, at, size + 1)):
            if record is None or i > CHAIN:
                return True
            if not _plausible(record, contigs):
                return False
    except ValueError:
        return False
    return True


def _maybe(text: np.ndarray, rows: int, contigs: int) -> np.ndarray:
    """Places among the first ``rows`` where numbers could be those of a record, all at once."""
    rows = max(0, min(rows, len(text) - 36))

    def number(kind, offset):
        return np.ndarray((rows,), kind, buffer=text.data, offset=offset, strides=(1,)).astype(np.int64)

    length, ref, mate, letters, names = number("<i4", 0), number("<i4", 4), number("<i4", 24), number("<i4", 20), number("u1", 12)
    least = 32 + names + 4 * number("<u2", 16) + (letters + 1) // 2 + letters
    good = (ref >= -1) & (ref < contigs) & (mate >= -1) & (mate < contigs) & (names > 0) & (letters >= 0) & (least <= length) & (length < 1 << 28)
    return np.flatnonzero(good & (number("<i4", 8) >= -1) & (number("<i4", 28) >= -1))


def _first_block(file, size: int, at: int) -> int:
    """Where the first block at or after a byte starts: two in a row, or one that ends the file, whose letters are right."""
    while at < size:
        raw = file.read_at(min(2 * MAX_BLOCK, size - at), at)
        for hit in re.finditer(b"\x1f\x8b\x08\x04", raw):
            head = _block(raw[hit.start() : hit.start() + 512])
            if head is not None:
                try:
                    next(_blocks(file, size, at + hit.start()))
                except ValueError:
                    continue
                return at + hit.start()
        at += max(1, len(raw) - 512) if at + len(raw) < size else len(raw)
    return size


def first_record(file, size: int, at: int, contigs: int) -> tuple[int, int]:
    """(block, place within) of the first record that starts in a block at or after byte ``at``; (size, 0) if none does."""
    block = _first_block(file, size, at)
    if block >= size:
        return size, 0
    source = _blocks(file, size, block)
    now = next(source, None)
    while now is not None:
        ahead = next(source, None)
        text, follow = now[1], ahead
        # a record's head may lie across blocks, empty ones among them
        while follow is not None and len(text) < len(now[1]) + 36:
            text += follow[1]
            follow = next(_blocks(file, size, follow[0] + _size(file, follow[0])), None)
        padded = np.frombuffer(text + bytes(36), np.uint8)
        for p in _maybe(padded, len(now[1]), contigs).tolist():
            if _follows(file, size, now[0], p, contigs):
                return now[0], p
        now = ahead
    return size, 0


def _size(file, at: int) -> int:
    return _block(file.read_at(512, at))[0]


def _decoded(record: bytes, contigs: list[str]) -> tuple:
    ref, pos, n_name, mapq, _, ops, flag, n, _, _, _ = HEAD.unpack_from(record)
    at = 32 + n_name
    if at + 4 * ops + (n + 1) // 2 + n > len(record):
        raise ValueError(f"record {record[32:at - 1]!r} is longer than its block size")
    name = record[32 : at - 1].decode()
    steps = struct.unpack_from(f"<{ops}I", record, at)
    cigar = "".join(f"{s >> 4}{OPS[s & 15]}" for s in steps) or None
    at += 4 * ops
    half = (n + 1) // 2
    seq = PAIRS[np.frombuffer(record, np.uint8, half, at)].tobytes()[:n].decode()
    score = np.frombuffer(record, np.uint8, n, at + half)
    qual = None if n and (score == 255).all() else (score + 33).tobytes().decode("latin-1")
    return name, flag, contigs[ref] if ref >= 0 else None, pos + 1 if pos >= 0 else None, mapq, cigar, seq, qual


class Range(InputPartition):
    def __init__(self, path: str, size: int, start: int, end: int):
        self.path, self.size, self.start, self.end = path, size, start, end


class BamReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self):
        return [Range(p, size, at, min(at + self.split, size)) for p, size in _files(self.path) for at in range(0, size, self.split)] or [Range("", 0, 0, 0)]

    def read(self, partition: Range):
        if not partition.path:
            return
        from .readers import SAMPLE_OF

        system, _ = _system(self.path)
        sample = re.search(SAMPLE_OF, partition.path).group(1)
        kinds = pa.schema([("sample", pa.string()), ("ord", pa.int64()), ("name", pa.string()), ("flag", pa.int32()), ("rname", pa.string()), ("pos", pa.int64()), ("mapq", pa.int32()), *((n, pa.string()) for n in ("cigar", "seq", "qual"))])

        def batch(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*rows), kinds)], schema=kinds)

        with system.open_input_file(partition.path) as file:
            size = partition.size
            contigs, block, at = _header(file, size)
            told = partition.end > block  # no record starts before the header's end
            if partition.start > block:
                block, at = first_record(file, size, partition.start, len(contigs))
            rows, held = [], 0
            for (block, at), record in _records(file, size, block, at, partition.end):
                if record is None:
                    break
                rows.append((sample, block << 16 | at, *_decoded(record, contigs)))
                held += len(record)
                if held > BATCH:
                    yield batch(rows)
                    rows, held = [], 0
            if rows:
                yield batch(rows)
            if told and partition.end < size and first_record(file, size, partition.end, len(contigs)) != (block, at):
                raise ValueError(f"{partition.path}: the record after byte {partition.end} can't be told; read with another split than {self.split}")


class Bam(DataSource):
    """``spark.read.format("bam").option("split", bytes).load(path)``: all records, as they are stored; ``ord`` is their virtual offset."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options["path"], max(1, int(self.options.get("split", SPLIT))))


def read_bam(spark: SparkSession, path: str, *, split: int = SPLIT, missing_quality: int = 1) -> DataFrame:
    """reads(sample, ord, name, seq, qual) as FASTQ would have them: primary records, those of the reverse strand turned back.

    ``path`` is a file, a folder or a pattern, wherever pyarrow opens it. A record without qualities has ``missing_quality`` throughout.
    """
    from ..functions.sequence import reverse_complement

    spark.dataSource.register(Bam)
    rows = spark.read.format("bam").option("split", split).load(path).where(F.col("flag").bitwiseAND(NOT_PRIMARY) == 0)
    back = F.col("flag").bitwiseAND(REVERSE) != 0
    qual = F.coalesce("qual", F.repeat(F.lit(chr(33 + missing_quality)), F.length("seq")))
    return rows.select("sample", "ord", "name", F.when(back, reverse_complement("seq")).otherwise(F.col("seq")).alias("seq"), F.when(back, F.reverse(qual)).otherwise(qual).alias("qual"))
