"""Aligned reads from BAM files, as a Spark data source of its own.

A BAM file is a series of gzip members of at most 64 KB (BGZF) that hold a header and records.  With an index beside
it (.bai), a contig is a partition, which starts at the contig's first virtual offset; without one, a file is a
partition.  Members are inflated one at a time, so a task holds one member and the records that it completes.

    spark.dataSource.register(BamSource)
    reads = spark.read.format("bam").load("/shared/*.bam")

Paths must be readable as files on driver and executors, as those of a shared folder are.
"""

from __future__ import annotations

import glob
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "sample string, read string, chrom string, pos bigint, cigar string, flag int, mapq int, strand string, seq string, xs string, ts string"
#: Operations of a CIGAR and letters of a sequence, by their codes in the file (fixed values of the format).
OPS, LETTERS = "MIDNSHP=X", "=ACMGRSVTWYHKDBN"
#: Sizes of tag values by type letter (fixed values of the format).
SIZES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}


@dataclass
class Part(InputPartition):
    """What a task reads: records of contig ``ref``, or of all if it is -1, from a virtual offset on."""

    path: str
    ref: int
    offset: int


def members(path: str, at: int = 0) -> Iterator[bytes]:
    """The inflated members of a BGZF file from byte ``at`` on."""
    with open(path, "rb") as f:
        f.seek(at)
        while head := f.read(12):
            if len(head) < 12 or head[:4] != b"\x1f\x8b\x08\x04":
                raise ValueError(f"{path}: no BGZF member at byte {f.tell() - len(head)}")
            extra = f.read(struct.unpack("<H", head[10:])[0])
            size, k = None, 0
            while k + 4 <= len(extra):
                own = struct.unpack_from("<H", extra, k + 2)[0]
                if extra[k : k + 2] == b"BC":
                    size = struct.unpack_from("<H", extra, k + 4)[0] + 1
                k += 4 + own
            if size is None:
                raise ValueError(f"{path}: a gzip member without its size: not BGZF")
            body = f.read(size - 12 - len(extra))
            yield zlib.decompress(body[:-8], -15)


class Stream:
    """Bytes of a BGZF file, taken in pieces."""

    def __init__(self, path: str, offset: int = 0):
        self.parts = members(path, offset >> 16)
        self.held, self.at = b"", offset & 0xFFFF

    def take(self, n: int) -> bytes:
        """The next n bytes; fewer at the file's end."""
        while len(self.held) - self.at < n:
            more = next(self.parts, None)
            if more is None:
                break
            self.held, self.at = self.held[self.at :] + more, 0
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        return out

    def skip_past(self) -> None:
        """Move to the offset in the first member, if that lies within it."""
        if not self.held and self.at:
            at, self.at = self.at, 0
            self.take(at)


def header(stream: Stream) -> list[str]:
    """Names of the contigs; the stream then stands at the first record."""
    if stream.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    number = lambda: struct.unpack("<i", stream.take(4))[0]
    stream.take(number())
    names = []
    for _ in range(number()):
        names.append(stream.take(number())[:-1].decode())
        stream.take(4)
    return names


def _tags(raw: bytes) -> dict[str, str]:
    """Character tags of a record; others are passed over."""
    out, k = {}, 0
    while k + 3 <= len(raw):
        name, kind = raw[k : k + 2].decode("latin-1"), chr(raw[k + 2])
        k += 3
        if kind in "ZH":
            end = raw.index(b"\0", k)
            out[name], k = raw[k:end].decode("latin-1"), end + 1
        elif kind == "B":
            k += 5 + SIZES[chr(raw[k])] * struct.unpack_from("<i", raw, k + 1)[0]
        else:
            if kind == "A":
                out[name] = chr(raw[k])
            k += SIZES[kind]
    return out


def record(raw: bytes, names: list[str], sample: str) -> tuple:
    """One record, without its length, as a row."""
    ref, pos, l_name, mapq, _, n_ops, flag, l_seq = struct.unpack_from("<iiBBHHHi", raw)
    k = 32
    name = raw[k : k + l_name - 1].decode("latin-1")
    k += l_name
    cigar = "".join(f"{c >> 4}{OPS[c & 15]}" for c in struct.unpack_from(f"<{n_ops}I", raw, k))
    k += 4 * n_ops
    packed = raw[k : k + (l_seq + 1) // 2]
    seq = "".join(LETTERS[b >> 4] + LETTERS[b & 15] for b in packed)[:l_seq]
    tags = _tags(raw[k + len(packed) + l_seq :])
    chrom = names[ref] if 0 <= ref < len(names) else None
    return (sample, name, chrom, pos if chrom is not None else None, cigar or None, flag, mapq, "-" if flag & 0x10 else "+", seq, tags.get("XS"), tags.get("ts"))


def first_offsets(path: str, contigs: int) -> list[int | None] | None:
    """Each contig's first virtual offset by the index beside the file; None without an index."""
    for index in (path + ".bai", path.removesuffix(".bam") + ".bai"):
        if os.path.exists(index):
            break
    else:
        return None
    with open(index, "rb") as f:
        raw = f.read()
    if raw[:4] != b"BAI\1":
        raise ValueError(f"{index}: not an index")
    k, out = 8, []
    for _ in range(min(contigs, struct.unpack_from("<i", raw, 4)[0])):
        starts: list[int] = []
        bins = struct.unpack_from("<i", raw, k)[0]
        k += 4
        for _ in range(bins):
            bin_, chunks = struct.unpack_from("<Ii", raw, k)
            k += 8
            if bin_ != 37450:  # that one holds statistics
                starts += [struct.unpack_from("<Q", raw, k + 16 * c)[0] for c in range(chunks)]
            k += 16 * chunks
        k += 4 + 8 * struct.unpack_from("<i", raw, k)[0]
        out.append(min(starts, default=None))
    return out + [None] * (contigs - len(out))


class BamReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = sorted(p for given in options["path"].split(",") for p in (glob.glob(given) or [given]))

    def partitions(self) -> list[Part]:
        out = []
        for path in self.paths:
            names = header(Stream(path))
            offsets = first_offsets(path, len(names))
            if offsets is None:
                out.append(Part(path, -1, 0))
            else:
                out += [Part(path, ref, at) for ref, at in enumerate(offsets) if at is not None]
        return out

    def read(self, part: Part) -> Iterator[tuple]:
        stream = Stream(part.path)
        names = header(stream)
        sample = os.path.basename(part.path).removesuffix(".bam")
        if part.ref >= 0:
            stream = Stream(part.path, part.offset)
            stream.skip_past()
        while len(size := stream.take(4)) == 4:
            raw = stream.take(struct.unpack("<i", size)[0])
            ref = struct.unpack_from("<i", raw)[0]
            if part.ref >= 0 and ref != part.ref:
                return  # records are sorted: the contig has ended
            yield record(raw, names, sample)


class BamSource(DataSource):
    """Format ``bam``: a row per record; unmapped records only where a file has no index."""

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> BamReader:
        return BamReader(self.options)


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Reads of the BAM files that ``path``, with wildcards and commas, names; see SCHEMA."""
    spark.dataSource.register(BamSource)
    return spark.read.format("bam").load(path)


def contigs(reads: DataFrame) -> DataFrame:
    """(chrom): contigs with a read, each with the prefix chr."""
    from exonloom.operators.tokens import with_chr

    return reads.filter("chrom is not null").select(with_chr(F.col("chrom")).alias("chrom")).distinct()


def paired(reads: DataFrame) -> Column:
    """Whether any read of a pair is there, as an aggregate."""
    return F.coalesce(F.bool_or(reads["flag"].bitwiseAND(F.lit(1)) != 0), F.lit(False))
