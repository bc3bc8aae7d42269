"""The BAM source against a file written here, with and without an index."""

import struct
import zlib

import pytest
from pyspark.sql import functions as F

from exonloom.operators.reads import junction_counts
from exonloom.sources.bam import LETTERS, OPS, contigs, paired, read_bam

NAMES = ["1", "chr2", "MT"]


def member(data):
    c = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = c.compress(data) + c.flush()
    return b"\x1f\x8b\x08\x04" + struct.pack("<IBBH", 0, 0, 255, 6) + b"BC" + struct.pack("<HH", 2, len(body) + 25) + body + struct.pack("<II", zlib.crc32(data), len(data))


def packed(name, ref, pos, flag, cigar, seq, tags=b""):
    ops, n = [], ""
    for c in cigar:
        if c.isdigit():
            n += c
        else:
            ops.append(int(n) << 4 | OPS.index(c))
            n = ""
    codes = [LETTERS.index(x) for x in seq] + [0] * (len(seq) % 2)
    body = struct.pack("<iiBBHHHiiii", ref, pos, len(name) + 1, 60, 0, len(ops), flag, len(seq), -1, -1, 0)
    body += name.encode() + b"\0" + struct.pack(f"<{len(ops)}I", *ops) + bytes(codes[k] << 4 | codes[k + 1] for k in range(0, len(codes), 2)) + b"\xff" * len(seq) + tags
    return struct.pack("<i", len(body)) + body


RECORDS = [(f"r{k}", k * 3 // 300, 100 + k, (0, 16, 1024, 1)[k % 4], f"{5 + k % 3}M{20 + k % 5}N6M", "ACGTN"[k % 5] * (11 + k % 3), (b"", b"XSA-", b"NMi\1\0\0\0tsA+", b"XBBc\2\0\0\0\1\2RGZabc\0XSA+")[k % 4]) for k in range(300)]


@pytest.fixture(scope="module", params=[True, False])
def files(request, tmp_path_factory):
    folder = tmp_path_factory.mktemp("bam")
    head = b"BAM\1" + struct.pack("<i", 4) + b"@HD\n" + struct.pack("<i", len(NAMES))
    for n in NAMES:
        head += struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", 10**6)
    data, starts = head, {}
    for r in RECORDS:
        starts.setdefault(r[1], len(data))
        data += packed(*r)
    step, places, out = 1500, [], b""
    for at in range(0, len(data), step):
        places.append(len(out))
        out += member(data[at : at + step])
    out += member(b"")
    (folder / "s1.bam").write_bytes(out)
    if request.param:
        index = b"BAI\1" + struct.pack("<i", len(NAMES))
        for ref in range(len(NAMES)):
            chunks = [(places[starts[ref] // step] << 16) | starts[ref] % step] if ref in starts else []
            index += struct.pack("<i", len(chunks) * 2)
            for c in chunks:
                index += struct.pack("<IiQQ", 4681, 1, c, c + 1) + struct.pack("<IiQQ", 37450, 1, 1, 1)
            index += struct.pack("<i", 0)
        (folder / "s1.bam.bai").write_bytes(index)
    return folder


def test_rows(spark, files):
    got = sorted((r.read, r.chrom, r.pos, r.flag, r.cigar, r.seq, r.strand, r.xs, r.ts, r.sample) for r in read_bam(spark, f"{files}/*.bam").collect())
    tag = {0: (None, None), 1: ("-", None), 2: (None, "+"), 3: ("+", None)}
    assert got == sorted((n, NAMES[ref], pos, flag, cigar, seq, "-" if flag & 16 else "+", *tag[k % 4], "s1") for k, (n, ref, pos, flag, cigar, seq, _) in enumerate(RECORDS))


def test_contigs_pairs_and_junctions(spark, files):
    reads = read_bam(spark, f"{files}/s1.bam")
    assert sorted(r.chrom for r in contigs(reads).collect()) == ["chr1", "chr2", "chrMT"]
    assert reads.agg(paired(reads).alias("p")).first().p
    assert junction_counts(reads).agg(F.sum("count")).first()[0] == len(RECORDS)


def test_what_is_no_bam(spark, tmp_path):
    (tmp_path / "x.bam").write_bytes(b"plain text, not a file of members")
    with pytest.raises(Exception, match="BGZF"):
        read_bam(spark, f"{tmp_path}/x.bam").count()
