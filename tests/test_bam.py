import random
import struct
import zlib

import pytest

from strandflow.functions.align import revcomp
from strandflow.sources.bam import LETTERS, NOT_PRIMARY, read_bam
from strandflow.sources.readers import read_reads

OPS = "MIDNSHP=X"


def block(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04" + bytes(4) + b"\0\xff" + struct.pack("<H", 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data))


def record(name, flag, ref, pos, cigar, seq, qual, tags=b"") -> bytes:
    codes = [LETTERS.index(c) for c in seq] + [0]
    packed = bytes(codes[i] << 4 | codes[i + 1] for i in range(0, len(seq), 2))
    raw = b"\xff" * len(seq) if qual is None else bytes(ord(c) - 33 for c in qual)
    ops = b"".join(struct.pack("<I", n << 4 | OPS.index(o)) for n, o in cigar)
    fixed = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 4680, len(cigar), flag, len(seq), -1, -1, 0)
    whole = fixed + name.encode() + b"\0" + ops + packed + raw + tags
    return struct.pack("<i", len(whole)) + whole


def bam(rows, size, contigs=("chr1", "chr2"), text="@HD\tVN:1.6\n") -> bytes:
    out = b"BAM\1" + struct.pack("<i", len(text)) + text.encode() + struct.pack("<i", len(contigs))
    for c in contigs:
        out += struct.pack("<i", len(c) + 1) + c.encode() + b"\0" + struct.pack("<i", 10**6)
    out += b"".join(rows)
    pieces = [out[i : i + size] for i in range(0, len(out), size)]
    return b"".join(map(block, pieces)) + block(b"")


def some(n, longest, seed=0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        length = rng.choice([0, 1, 7, 60, longest])
        seq = "".join(rng.choice("ACGTN") for _ in range(length))
        qual = None if i % 7 == 3 else "".join(chr(33 + rng.randrange(60)) for _ in range(length))
        rows.append((f"read{i}", rng.choice([0, 4, 16, 256, 2048, 272]), rng.choice([-1, 0, 1]), rng.randrange(1000), [(length, "M")] if length else [], seq, qual))
    return rows


def wanted(rows):
    out = []
    for name, flag, _, _, _, seq, qual in rows:
        if flag & NOT_PRIMARY:
            continue
        qual = chr(34) * len(seq) if qual is None else qual
        out.append((name, revcomp(seq), qual[::-1]) if flag & 16 else (name, seq, qual))
    return out


@pytest.mark.parametrize("size, split", [(60000, 1 << 20), (700, 900), (90, 1500), (65000, 3000)])
def test_every_split_reads_every_record_once(spark, tmp_path, size, split):
    rows = some(300, 900)
    (tmp_path / "s1.bam").write_bytes(bam([record(*r) for r in rows], size))
    df = read_bam(spark, str(tmp_path / "s1.bam"), split=split)
    got = df.orderBy("ord").collect()
    assert [(r["name"], r["seq"], r["qual"]) for r in got] == wanted(rows)
    assert {r["sample"] for r in got} == {"s1"}
    assert split > 10000 or df.rdd.getNumPartitions() > 3


def test_columns_as_stored_folder_and_pattern(spark, tmp_path):
    one, two = some(5, 50, 1), some(4, 50, 2)
    (tmp_path / "a.bam").write_bytes(bam([record(*r) for r in one], 400))
    (tmp_path / "b.bam").write_bytes(bam([record(*r) for r in two], 400))
    (tmp_path / "c.bam").write_bytes(bam([], 400))
    (tmp_path / "notes.txt").write_text("other")
    read_bam(spark, str(tmp_path))
    rows = spark.read.format("bam").load(f"file://{tmp_path}").collect()
    assert len(rows) == 9 and {r["sample"] for r in rows} == {"a", "b"}
    of = {(r["sample"], r["name"]): r for r in rows}
    for sample, made in (("a", one), ("b", two)):
        for name, flag, ref, pos, cigar, seq, qual in made:
            r = of[sample, name]
            assert (r.flag, r.rname, r.pos, r.mapq) == (flag, [None, "chr1", "chr2"][ref + 1], pos + 1, 60)
            assert (r.cigar, r.seq, r.qual) == ("".join(f"{n}{o}" for n, o in cigar) or None, seq, qual)
    assert read_bam(spark, f"{tmp_path}/b*.bam").select("sample").distinct().count() == 1
    assert read_bam(spark, f"{tmp_path}/c.bam").count() == 0 and read_bam(spark, f"{tmp_path}/none*").count() == 0
    assert read_reads(spark, f"{tmp_path}/a.bam").count() == len(wanted(one))


def test_long_header_over_several_tasks(spark, tmp_path):
    rows = some(60, 300, 3)
    names = tuple(f"contig_{i}" for i in range(2000))
    (tmp_path / "h.bam").write_bytes(bam([record(*r) for r in rows], 500, names, "".join(f"@CO\t{random.Random(5).random()}{i}\n" for i in range(500))))
    got = read_bam(spark, str(tmp_path / "h.bam"), split=2000).orderBy("ord").collect()
    assert [(r["name"], r["seq"], r["qual"]) for r in got] == wanted(rows)


def test_records_within_a_tag_are_an_error_not_other_rows(spark, tmp_path):
    """Bytes of a tag that read as records all along: no guess can tell them, the read says so."""
    fake = b"".join(record(f"fake{i}", 0, 0, 1, [], "ACGT" * 30, None) for i in range(400))
    rows = [record("one", 0, 0, 1, [], "ACGT", None, b"XX" + b"Z" + fake), record("two", 0, 0, 5, [], "GG", None)]
    (tmp_path / "t.bam").write_bytes(bam(rows, 600))
    assert [r["name"] for r in read_bam(spark, str(tmp_path / "t.bam")).orderBy("ord").collect()] == ["one", "two"]
    with pytest.raises(Exception, match="another split"):
        read_bam(spark, str(tmp_path / "t.bam"), split=1000).collect()


@pytest.mark.parametrize("harm, says", [(lambda b: b[:-60], "no whole block|truncated"), (lambda b: b[:200] + bytes([b[200] ^ 255]) + b[201:], "block"), (lambda b: b"PK" + b[2:], "no whole block"), (lambda b: block(b"SAM\1" + bytes(20)), "not a BAM")])
def test_broken_files(spark, tmp_path, harm, says):
    whole = bam([record(*r) for r in some(50, 200, 4)], 300)
    (tmp_path / "x.bam").write_bytes(harm(whole))
    with pytest.raises(Exception, match=says):
        read_bam(spark, str(tmp_path / "x.bam")).collect()
