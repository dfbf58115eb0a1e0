"""Aligned reads: SAM text by Spark's text reader, BAM files by a partition reader.

Both give (chrom, ref_start, ref_end, mapq, is_reverse, hp, sa, cigar), positions
from 0, ends exclusive. Unmapped reads are left out. Remote stores are read by
whatever file system the session has; CRAM has to be converted first.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession, functions as F

from tandemlake.functions.cigar import reference_length

SHAPE = "chrom string, ref_start long, mapq int, is_reverse boolean, hp int, sa string, cigar string"
# Fixed values of the BAM format: operation letters by code, and sizes of tag types.
_OPS, _SIZES = "MIDNSHP=X", {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
_KINDS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I", "f": "f"}


def _with_end(reads: DataFrame) -> DataFrame:
    return reads.withColumn("ref_end", F.col("ref_start") + reference_length(F.col("cigar")))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    line = spark.read.text(path).where(~F.startswith(F.col("value"), F.lit("@")))
    p = F.split("value", "\t")
    flag = F.get(p, F.lit(1)).cast("int")
    tag = lambda name, kind: F.nullif(F.regexp_extract("value", rf"\t{name}:{kind}:([^\t]*)", 1), F.lit(""))
    rows = line.where((flag.bitwiseAND(4) == 0) & (F.get(p, F.lit(5)) != "*")).select(
        F.get(p, F.lit(2)).alias("chrom"), (F.get(p, F.lit(3)).cast("long") - 1).alias("ref_start"), F.get(p, F.lit(4)).cast("int").alias("mapq"), (flag.bitwiseAND(16) != 0).alias("is_reverse"),
        tag("HP", "i").try_cast("int").alias("hp"), tag("SA", "Z").alias("sa"), F.get(p, F.lit(5)).alias("cigar"),
    )
    return _with_end(rows)


def sam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, length) of the header's @SQ lines."""
    head = spark.read.text(path).where(F.startswith(F.col("value"), F.lit("@SQ\t")))
    return head.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("chrom"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length"))


#: Bytes that a block without a size in its header is fed by.
PORTION = 1 << 16


def _block_size(raw: memoryview, at: int) -> int | None:
    """Bytes of the block that begins at `at`, from the BC field of its header; None without one."""
    if at + 12 > len(raw) or not raw[at + 3] & 4:
        return None
    field, end = at + 12, at + 12 + struct.unpack_from("<H", raw, at + 10)[0]
    while field + 4 <= min(end, len(raw)):
        size = struct.unpack_from("<H", raw, field + 2)[0]
        if bytes(raw[field : field + 2]) == b"BC" and size == 2:
            return struct.unpack_from("<H", raw, field + 4)[0] + 1
        field += 4 + size
    return None


def _inflated(raw: bytes) -> Iterator[bytes]:
    """The blocks of a block-gzip file, each inflated alone; work follows the file's size, with sizes in the headers or without."""
    whole, at = memoryview(raw), 0
    while at < len(whole):
        size = _block_size(whole, at)
        if size is not None:
            out = zlib.decompress(whole[at : at + size], 31)
            at += size
        else:
            one, parts = zlib.decompressobj(31), []
            while not one.eof and at < len(whole):
                part = whole[at : at + PORTION]
                parts.append(one.decompress(part))
                at += len(part)
            at -= len(one.unused_data)
            out = b"".join(parts)
        if out:
            yield out


class _Stream:
    def __init__(self, blocks: Iterator[bytes]):
        self.blocks, self.held = blocks, b""

    def take(self, n: int) -> bytes | None:
        parts, have = [self.held], len(self.held)
        while have < n:
            more = next(self.blocks, None)
            if more is None:
                return None
            parts.append(more)
            have += len(more)
        whole = b"".join(parts)
        self.held = whole[n:]
        return whole[:n]


def bam_header(stream: _Stream) -> list[tuple[str, int]]:
    if stream.take(4) != b"BAM\1":
        raise ValueError("not a BAM file")
    stream.take(struct.unpack("<i", stream.take(4))[0])
    out = []
    for _ in range(struct.unpack("<i", stream.take(4))[0]):
        name = stream.take(struct.unpack("<i", stream.take(4))[0])[:-1].decode()
        out.append((name, struct.unpack("<i", stream.take(4))[0]))
    return out


def _tags(raw: bytes) -> dict:
    at, out = 0, {}
    while at + 3 <= len(raw):
        name, kind = raw[at : at + 2].decode(), chr(raw[at + 2])
        at += 3
        if kind in "ZH":
            end = raw.index(b"\0", at)
            out[name], at = raw[at:end].decode(), end + 1
        elif kind == "B":
            n = struct.unpack_from("<i", raw, at + 1)[0]
            if name == "CG" and chr(raw[at]) == "I":
                out[name] = struct.unpack_from(f"<{n}I", raw, at + 5)
            at += 5 + n * _SIZES[chr(raw[at])]
        else:
            if kind in _KINDS:
                out[name] = struct.unpack_from("<" + _KINDS[kind], raw, at)[0]
            at += _SIZES[kind]
    return out


def bam_records(raw: bytes) -> Iterator[tuple]:
    """Rows of SHAPE of one BAM file's bytes."""
    stream = _Stream(_inflated(raw))
    contigs = bam_header(stream)
    while (head := stream.take(4)) is not None:
        rec = stream.take(struct.unpack("<i", head)[0])
        ref, pos, name_len, mapq, _, ops, flag, seq_len = struct.unpack_from("<iiBBHHHi", rec)
        if flag & 4 or ref < 0 or not ops:
            continue
        at = 32 + name_len
        steps = struct.unpack_from(f"<{ops}I", rec, at)
        tags = _tags(rec[at + 4 * ops + (seq_len + 1) // 2 + seq_len :])
        # a CIGAR too long for its field stands in a tag, behind a placeholder that clips the whole read
        if "CG" in tags and steps[0] == (seq_len << 4 | 4):
            steps = tags["CG"]
        cigar = "".join(f"{v >> 4}{_OPS[v & 15]}" for v in steps)
        hp = tags.get("HP")
        yield contigs[ref][0], pos, mapq, bool(flag & 16), hp if isinstance(hp, int) else None, tags.get("SA"), cigar


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Reads of one or many BAM files, a task a file (each under 2 GB: convert larger ones to Parquet by contig)."""
    import pandas as pd

    names = [x.split()[0] for x in SHAPE.split(", ")]

    def rows(batches):
        for pdf in batches:
            for raw in pdf["content"]:
                held = []
                for r in bam_records(raw):
                    held.append(r)
                    if len(held) == 20_000:
                        yield pd.DataFrame(held, columns=names).astype({"hp": "Int32"})
                        held = []
                if held:
                    yield pd.DataFrame(held, columns=names).astype({"hp": "Int32"})

    return _with_end(spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, SHAPE))


def bam_contigs(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, length) of the headers of one or many BAM files, each contig once."""
    import pandas as pd

    def rows(batches):
        for pdf in batches:
            for raw in pdf["content"]:
                yield pd.DataFrame(bam_header(_Stream(_inflated(raw))), columns=["chrom", "length"])

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(rows, "chrom string, length long").groupBy("chrom").agg(F.min("length").alias("length"))


def sample_name(path: str) -> str:
    """A file's stem without .bam or .cram."""
    return PurePosixPath(path).stem.replace(".bam", "").replace(".cram", "")
