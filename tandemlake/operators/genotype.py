"""Genotypes of repeat loci from aligned reads.

Reads meet loci in an interval join; each read's repeat length is a fold over its
CIGAR. Lengths are counted, per locus and haplotype, before anything is gathered,
so what is shuffled grows with the different lengths of a locus and not with its
depth. Medians and splits are then taken from the counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tandemlake.functions import cigar
from tandemlake.operators.intervals import overlap_join

PAD = 10


def read_calls(reads: DataFrame, loci: DataFrame, minlen: int = 5, unphased: bool = False) -> DataFrame:
    """(ord, hp, len, is_clip) of each read at each locus that it tells of.

    reads: chrom, ref_start, ref_end, mapq, is_reverse, hp, sa, cigar. loci: ord,
    chrom, begin, end. Unphased reads must span the padded window; phased ones
    must have a haplotype and an end in it, or span one side.
    """
    window = loci.select("ord", "chrom", F.greatest(F.col("begin") - PAD, F.lit(0)).alias("begin"), (F.col("end") + PAD).alias("end"))
    good = reads.where("mapq > 10") if unphased else reads.where("mapq > 10 and hp in (1, 2)")
    good = good.withColumnsRenamed({"chrom": "r_chrom", "ref_start": "r_begin", "ref_end": "r_end"})
    pair = overlap_join(window, good)
    if unphased:
        pair = pair.where("begin >= r_begin and r_end >= end")
    else:
        pair = pair.where("not (begin < r_begin and r_end < end)")
    is_2d = cigar.accidental_2d(F.col("sa"), F.col("is_reverse"), F.col("r_begin"), F.col("r_end"))
    call = cigar.repeat_call(F.col("cigar"), F.col("r_begin"), F.col("begin"), F.col("end"), minlen, is_2d)
    return pair.select("ord", "hp", call.alias("call")).select("ord", "hp", "call.len", "call.is_clip")


def supported_median(counts: DataFrame, support: int) -> DataFrame:
    """(ord, hap, length) from counts (ord, hap, is_clip, len, n).

    Under `support` reads: null. With no more spanning reads than `support`, the
    longest clipped ones fill up to it, else clipped ones don't count. The middle
    value, or the mean of the two middle ones.
    """
    key = ["ord", "hap"]
    whole = Window.partitionBy(*key)
    spans = F.coalesce(F.sum(F.when(~F.col("is_clip"), F.col("n"))).over(whole), F.lit(0))
    c = counts.withColumn("spans", spans).withColumn("reads", F.sum("n").over(whole))
    longer = Window.partitionBy(*key, "is_clip").orderBy(F.col("len").desc()).rowsBetween(Window.unboundedPreceding, -1)
    room = F.greatest(F.lit(support) - F.col("spans"), F.lit(0)) - F.coalesce(F.sum("n").over(longer), F.lit(0))
    c = c.withColumn("used", F.when(F.col("is_clip"), F.greatest(F.least("n", room), F.lit(0))).otherwise(F.col("n")))
    v = c.where("used > 0 and reads >= %d" % support).groupBy(*key, "len").agg(F.sum("used").alias("used"))
    upto = Window.partitionBy(*key).orderBy("len").rowsBetween(Window.unboundedPreceding, 0)
    v = v.withColumn("last", F.sum("used").over(upto)).withColumn("m", F.sum("used").over(Window.partitionBy(*key)))
    holds = lambda i: (F.col("last") - F.col("used") <= i) & (i < F.col("last"))
    low, high = F.floor((F.col("m") - 1) / 2), F.floor(F.col("m") / 2)
    return v.groupBy(*key).agg(((F.max(F.when(holds(low), F.col("len"))) + F.max(F.when(holds(high), F.col("len")))) / F.lit(2.0)).alias("length"))


def genotypes(reads: DataFrame, loci: DataFrame, minlen: int = 5, support: int = 3, unphased: bool = False) -> DataFrame:
    """(ord, chrom, locus_begin, locus_end, h1, h2) of every locus, null where too few reads tell.

    Unphased reads are halved by length (clipped after spanning of one length):
    the lower half, rounded down, is haplotype 1.
    """
    calls = read_calls(reads, loci, minlen, unphased)
    if unphased:
        n = calls.groupBy("ord", "len", "is_clip").agg(F.count("*").alias("n"))
        below = Window.partitionBy("ord").orderBy("len", "is_clip").rowsBetween(Window.unboundedPreceding, -1)
        half = F.floor(F.sum("n").over(Window.partitionBy("ord")) / 2)
        n = n.withColumn("low", F.greatest(F.lit(0), F.least(F.col("n"), half - F.coalesce(F.sum("n").over(below), F.lit(0)))))
        each = F.array(F.struct(F.lit(1).alias("hap"), F.col("low").alias("n")), F.struct(F.lit(2).alias("hap"), (F.col("n") - F.col("low")).alias("n")))
        counts = n.select("ord", "len", "is_clip", F.inline(each)).where("n > 0")
    else:
        counts = calls.groupBy("ord", F.col("hp").alias("hap"), "is_clip", "len").agg(F.count("*").alias("n"))
    found = supported_median(counts, support)
    wide = found.groupBy("ord").agg(F.max(F.when(F.col("hap") == 1, F.col("length"))).alias("h1"), F.max(F.when(F.col("hap") == 2, F.col("length"))).alias("h2"))
    return loci.join(wide, "ord", "left").select("ord", "chrom", F.col("begin").alias("locus_begin"), F.col("end").alias("locus_end"), "h1", "h2")
