"""Regions and interval joins.

An interval join is an equi-join on contig and bin: the side with longer
intervals is listed under every bin that it touches, a pair is kept in the first
bin that both touch. So a contig with most of the rows is many keys, and nothing
is compared outside its neighbourhood.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

BIN = 1 << 14


def parse_region(region: Column, empty: bool = False) -> Column:
    """struct<chrom, begin, end> of chrom:begin-end (commas allowed), or null: one colon, one dash, begin < end (or equal, with `empty`)."""
    plain = F.translate(region, ",", "")
    good = plain.rlike(r"^[^:-]+:\d+-\d+$")
    part = [F.when(good, F.regexp_extract(plain, r"^([^:-]+):(\d+)-(\d+)$", k)) for k in (1, 2, 3)]
    begin, end = part[1].try_cast("long"), part[2].try_cast("long")
    return F.when(good & ((begin <= end) if empty else (begin < end)), F.struct(part[0].alias("chrom"), begin.alias("begin"), end.alias("end")))


def region_text(chrom: Column, begin: Column, end: Column) -> Column:
    return F.concat(chrom, F.lit(":"), begin.cast("string"), F.lit("-"), end.cast("string"))


def overlaps(a_begin: Column, a_end: Column, b_begin: Column, b_end: Column) -> Column:
    """Half-open intervals that share a base; touching ones and empty ones don't."""
    return F.greatest(a_begin, b_begin) < F.least(a_end, b_end)


def contains(outer_begin: Column, outer_end: Column, begin: Column, end: Column) -> Column:
    return (outer_begin <= begin) & (end <= outer_end)


def validate(intervals: DataFrame, contigs: DataFrame) -> DataFrame:
    """intervals (chrom, begin, end, ...), or an error: end before begin, an unknown contig, or end not below its length."""
    known = contigs.select(F.col("chrom").alias("contig"), F.col("length").alias("contig_length"))
    i = intervals.join(known, F.col("chrom") == F.col("contig"), "left")
    fault = F.when(F.col("end") < F.col("begin"), "ends before it begins").when(F.col("contig_length").isNull(), "is on an unknown contig").when(F.col("end") >= F.col("contig_length"), "runs past its contig")
    text = F.concat(region_text(F.col("chrom"), F.col("begin"), F.col("end")), F.lit(" "), fault)
    checked = F.when(fault.isNull(), F.col("chrom")).otherwise(F.raise_error(text).cast("string"))
    return i.select(checked.alias("chrom"), *(c for c in intervals.columns if c != "chrom"))


def overlap_join(left: DataFrame, right: DataFrame, bin_size: int = BIN, how: str = "overlap") -> DataFrame:
    """Pairs of left (chrom, begin, end, ...) and right (r_chrom, r_begin, r_end, ...) that overlap.

    how="contained": right within left, ends included. Null ends match nothing.
    """
    one = F.lit(1).cast("long")
    bins = lambda a, b: F.explode(F.sequence(F.floor(a / bin_size), F.floor(F.greatest(a, b - one) / bin_size)))
    left = left.where("begin is not null and end >= begin").withColumn("__bin", bins(F.col("begin"), F.col("end")))
    right = right.where("r_begin is not null and r_end >= r_begin").withColumn("__r_bin", bins(F.col("r_begin"), F.col("r_end")))
    first = F.greatest(F.floor(F.col("begin") / bin_size), F.floor(F.col("r_begin") / bin_size))
    if how == "contained":
        rule = contains(F.col("begin"), F.col("end"), F.col("r_begin"), F.col("r_end"))
    else:
        rule = overlaps(F.col("begin"), F.col("end"), F.col("r_begin"), F.col("r_end"))
    joined = left.join(right, (F.col("chrom") == F.col("r_chrom")) & (F.col("__bin") == F.col("__r_bin")) & (F.col("__bin") == first) & rule)
    return joined.drop("__bin", "__r_bin")


def overlap_semi(left: DataFrame, right: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Rows of left that overlap any row of right, each once; left has a unique `ord`."""
    ids = overlap_join(left.select("ord", "chrom", "begin", "end"), right, bin_size).select("ord").distinct()
    return left.join(ids, "ord", "left_semi")
