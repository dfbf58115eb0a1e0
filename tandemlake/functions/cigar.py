"""CIGAR strings as Catalyst expressions: operations, reference length, repeat length."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_OPS = r"(\d+)([MIDNSHP=X])"


def operations(cigar: Column) -> Column:
    """array<struct<len, op>> in order; null for null."""
    size = F.transform(F.regexp_extract_all(cigar, F.lit(_OPS), 1), lambda x: x.cast("long"))
    return F.zip_with(size, F.regexp_extract_all(cigar, F.lit(_OPS), 2), lambda n, op: F.struct(n.alias("len"), op.alias("op")))


def reference_length(cigar: Column) -> Column:
    """Bases of the reference that an alignment covers."""
    return F.aggregate(operations(cigar), F.lit(0).cast("long"), lambda acc, x: acc + F.when(x["op"].isin("M", "=", "X", "D", "N"), x["len"]).otherwise(0))


def accidental_2d(sa: Column, is_reverse: Column, start: Column, end: Column) -> Column:
    """A read whose one supplementary alignment lies on the other strand of the same stretch.

    The supplementary's contig isn't compared and its position is taken as it
    stands. No tag, an empty one, or more than one entry: false.
    """
    entries = F.filter(F.split(sa, ";"), lambda x: x != "")
    field = F.split(F.get(entries, F.lit(0)), ",")
    at, strand, cigar = F.get(field, F.lit(1)).try_cast("long"), F.get(field, F.lit(2)), F.get(field, F.lit(3))
    overlap = F.greatest(start, at) < F.least(end, at + reference_length(cigar))
    return F.coalesce((F.size(entries) == 1) & (strand != F.when(is_reverse, "-").otherwise("+")) & overlap, F.lit(False))


def repeat_call(cigar: Column, ref_start: Column, window_start: Column, window_end: Column, minlen: int, is_2d: Column) -> Column:
    """struct<len, is_clip>: what a read says of the repeat in a window.

    Insertions and soft clips add, deletions subtract, if longer than minlen and
    strictly inside the window; a deletion counts where it begins. Clips count
    only on reads that aren't accidental 2D.
    """
    shape = "struct<total:bigint,pos:bigint,clip:boolean>"
    zero = F.struct(F.lit(0).alias("total"), (ref_start + 1).alias("pos"), F.lit(False).alias("clip")).cast(shape)

    def step(acc: Column, x: Column) -> Column:
        size, op = x["len"], x["op"]
        counts = (size > minlen) & (window_start < acc["pos"]) & (acc["pos"] < window_end)
        clip = counts & (op == "S") & ~is_2d
        change = F.when(counts & (op == "D"), -size).when((counts & (op == "I")) | clip, size).otherwise(0)
        move = F.when(op.isin("M", "=", "X", "D", "N"), size).otherwise(0)
        return F.struct((acc["total"] + change).alias("total"), (acc["pos"] + move).alias("pos"), (acc["clip"] | clip).alias("clip")).cast(shape)

    return F.aggregate(operations(cigar), zero, step, lambda acc: F.struct(acc["total"].alias("len"), acc["clip"].alias("is_clip")))
