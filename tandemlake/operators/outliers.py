"""Outlying haplotypes per locus, by z-score or by density, and what is counted over them.

All of it is array expressions on the matrix' rows: no shuffle before the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tandemlake.functions.values import let, once, sample_of
from tandemlake.operators.cohort import KEY, header_array


def large_loci(matrix: DataFrame, minsize: float = 10) -> DataFrame:
    """Loci with a length of minsize or more; missing lengths are 0 from here on."""
    filled = once(matrix.withColumnRenamed("lengths", "__raw"), lengths=F.transform("__raw", lambda x: F.coalesce(x, F.lit(0.0)))).select(*matrix.columns)
    return filled.where(F.array_max("lengths") >= minsize)


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def z_scores(lengths: Column) -> Column:
    """Each value's distance from the mean in population standard deviations; null where they are all equal."""

    def spread(s: Column) -> Column:
        return F.sqrt(_total(F.transform(s["x"], lambda x: (x - s["mean"]) * (x - s["mean"]))) / F.size(s["x"]))

    def scores(s: Column) -> Column:
        return F.transform(s["x"], lambda x: (x - s["mean"]) / F.nullif(s["sd"], F.lit(0.0)))

    mean = F.struct(lengths.alias("x"), (_total(lengths) / F.size(lengths)).alias("mean"))
    return let(mean, lambda s: let(F.struct(s["x"].alias("x"), s["mean"].alias("mean"), spread(s).alias("sd")), scores))


def _counted(values: Column) -> Column:
    """array<struct<v, n>> of the different values."""
    return let(values, lambda own: F.transform(F.array_distinct(own), lambda v: F.struct(v.alias("v"), F.size(F.filter(own, lambda y: y == v)).alias("n"))))


def mode_of(lengths: Column) -> Column:
    """The most frequent whole part of the positive values, the smallest of several; null without any."""
    whole = F.transform(F.filter(lengths, lambda x: x > 0), lambda x: x.cast("long"))
    ranked = F.transform(_counted(whole), lambda c: F.struct((-c["n"]).alias("n"), c["v"].alias("v")))
    return F.get(F.array_sort(ranked), F.lit(0))["v"]


def reach_of(lengths: Column) -> Column:
    """Twice the mode, and 10 at least."""
    return F.greatest(F.coalesce(mode_of(lengths) * 2, F.lit(10)), F.lit(10)).cast("double")


def is_noise(lengths: Column, reach: Column, least: int) -> Column:
    """For each value whether it is neither a core (least values, its own too, within reach) nor within reach of one.

    Worked out on the different values and their counts.
    """

    def near(s: Column, x: Column) -> Column:
        own = F.filter(s["c"], lambda y: F.abs(x - y["v"]) <= s["reach"])
        return F.aggregate(own, F.lit(0), lambda acc, y: acc + y["n"])

    def noise(s: Column) -> Column:
        return F.filter(F.transform(s["c"], lambda c: c["v"]), lambda x: ~F.exists(s["core"], lambda y: F.abs(x - y) <= s["reach"]))

    counted = F.struct(_counted(lengths).alias("c"), reach.alias("reach"))
    core = lambda s: F.transform(F.filter(s["c"], lambda c: near(s, c["v"]) >= least), lambda c: c["v"])
    lone = let(counted, lambda s: let(F.struct(s["c"].alias("c"), s["reach"].alias("reach"), core(s).alias("core")), noise))
    return let(F.struct(lengths.alias("x"), lone.alias("lone")), lambda s: F.transform(s["x"], lambda x: F.array_contains(s["lone"], x)))


def min_points(columns: int) -> int:
    """floor(log2(haplotype columns))."""
    if columns < 1:
        raise ValueError("no haplotype columns")
    return columns.bit_length() - 1


def outliers(matrix: DataFrame, header: list[str], minsize: float = 10, zscore: float = 3.0, method: str = "zscore", subset: list[str] | None = None) -> DataFrame:
    """(ord, chrom, locus_begin, locus_end, outliers): samples in column order, once for each outlying haplotype.

    zscore is one-sided (expansions), dbscan two-sided. Loci without outliers
    don't show; with a subset, only loci that have one of its samples do, with
    all their outliers.
    """
    large = large_loci(matrix, minsize)
    if method == "zscore":
        flags = F.transform(z_scores(F.col("lengths")), lambda z: F.coalesce(z >= zscore, F.lit(False)))
    elif method == "dbscan":
        flags = is_noise(F.col("lengths"), reach_of(F.col("lengths")), min_points(len(header)))
    else:
        raise ValueError(f"unknown method: {method}")
    named = F.zip_with(header_array(header), flags, lambda c, f: F.when(f, sample_of(c)))
    out = once(large.select("ord", *KEY, "lengths"), outliers=F.array_compact(named)).drop("lengths").where(F.size("outliers") > 0)
    if subset is not None:
        out = out.where(F.arrays_overlap("outliers", F.array(*map(F.lit, subset)).cast("array<string>")))
    return out


def count_outliers(found: DataFrame, groups: DataFrame | None = None) -> DataFrame:
    """(sample, n, first_seen[, group]): how often each sample is an outlier; by n, then first_seen, they are ranked."""
    each = found.select("ord", F.posexplode("outliers").alias("place", "name")).withColumn("sample", sample_of(F.col("name")))
    n = each.groupBy("sample").agg(F.count("*").alias("n"), F.min(F.struct("ord", "place")).alias("first"))
    n = n.select("sample", "n", F.col("first.ord").alias("first_ord"), F.col("first.place").alias("first_place"))
    return n if groups is None else n.join(groups.select("sample", "group"), "sample", "left")


def multiple_hits(found: DataFrame, samples: list[str], min_hits: int = 2, max_others: int | None = None) -> DataFrame:
    """found with `hits`, where at least min_hits of the outliers (with repeats) are of the list and, if given, at most max_others aren't."""
    listed = F.array(*map(F.lit, samples)).cast("array<string>")
    out = found.withColumn("hits", F.size(F.filter("outliers", lambda x: F.array_contains(listed, x)))).where(F.col("hits") >= min_hits)
    return out if max_others is None else out.where(F.size("outliers") - F.col("hits") <= max_others)
