"""Questions about single loci: interval lookups, sorted and side by side, histograms, group histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tandemlake.operators.cohort import KEY, to_long
from tandemlake.operators.intervals import contains, overlap_join, region_text


def matches(matrix: DataFrame, regions: DataFrame) -> DataFrame:
    """(interval_ord, matrix columns) of loci that overlap regions (interval_ord, chrom, begin, end)."""
    right = regions.select("interval_ord", F.col("chrom").alias("r_chrom"), F.col("begin").alias("r_begin"), F.col("end").alias("r_end"))
    left = matrix.withColumn("begin", F.col("locus_begin")).withColumn("end", F.col("locus_end"))
    return overlap_join(left, right).select("interval_ord", *matrix.columns)


def sorted_lengths(matrix: DataFrame, header: list[str], regions: DataFrame) -> DataFrame:
    """(rank, column, length) of the first match: longest first, missing last, then by name."""
    first = matches(matrix, regions).orderBy("interval_ord", "ord").limit(1)
    long = to_long(first, header)
    order = Window.orderBy(F.col("length").desc_nulls_last(), "column")
    return long.select(F.row_number().over(order).alias("rank"), "column", "length")


def side_by_side(matrix: DataFrame, header: list[str], regions: DataFrame) -> DataFrame:
    """(col_idx, column, matches, lengths): a row a haplotype column, an entry a match, by interval then file order."""
    found = matches(matrix, regions).withColumn("label", region_text(F.col("chrom"), F.col("locus_begin"), F.col("locus_end")))
    each = F.posexplode(F.col("lengths")).alias("col_idx", "length")
    cells = found.select("interval_ord", "ord", "label", each)
    gathered = cells.groupBy("col_idx").agg(F.array_sort(F.collect_list(F.struct("interval_ord", "ord", "label", "length"))).alias("c"))
    names = F.array(*map(F.lit, header))
    return gathered.select("col_idx", F.get(names, F.col("col_idx")).alias("column"), F.col("c.label").alias("matches"), F.col("c.length").alias("lengths"))


def first_contained(matrix: DataFrame, chrom: str, begin: int, end: int) -> DataFrame:
    """The first locus, in file order, that lies within the region."""
    own = matrix.where((F.col("chrom") == chrom) & contains(F.lit(begin), F.lit(end), F.col("locus_begin"), F.col("locus_end")))
    return own.orderBy("ord").limit(1)


def bucket_of(value: Column, low: Column, high: Column, buckets: int) -> Column:
    """Bucket 1 to `buckets` of equal widths from low to high; all in the first where both are equal."""
    place = F.floor((value - low) / ((high - low) / buckets)) + 1
    return F.when(high == low, F.lit(1)).otherwise(F.least(F.lit(buckets), place)).cast("int")


def histogram(values: DataFrame, column: str = "length", buckets: int = 100, by: tuple[str, ...] = (), *more: Column) -> DataFrame:
    """(*by, bucket, bucket_low, bucket_high, n, and the aggregates `more`) of the values that aren't missing, over one shared range.

    The range is two numbers that an aggregate finds first; what is counted is
    summed up before it is shuffled.
    """
    v = values.where(F.col(column).isNotNull())
    span = v.agg(F.min(column).alias("low"), F.max(column).alias("high")).first()
    low, high = F.lit(span.low).cast("double"), F.lit(span.high).cast("double")
    width = (high - low) / buckets
    n = v.groupBy(*by, bucket_of(F.col(column), low, high, buckets).alias("bucket")).agg(F.count("*").alias("n"), *more)
    extra = n.columns[len(by) + 2 :]
    return n.select(*by, "bucket", (low + (F.col("bucket") - 1) * width).alias("bucket_low"), (low + F.col("bucket") * width).alias("bucket_high"), "n", *extra)


def locus_histogram(matrix: DataFrame, header: list[str], chrom: str, begin: int, end: int, buckets: int = 100) -> DataFrame:
    return histogram(to_long(first_contained(matrix, chrom, begin, end), header), buckets=buckets)


def members(metadata: DataFrame, column: str, values: list[str]) -> DataFrame:
    """(sample, group) of rows whose column is one of the values; of rows with one id the last (by ord) counts."""
    kept = metadata.where(F.col(column).isin(values))
    return kept.groupBy("sample").agg(F.max_by(F.col(column), "ord").alias("group"))


def group_histogram(matrix: DataFrame, header: list[str], metadata: DataFrame, column: str, values: list[str], chrom: str, begin: int, end: int, buckets: int = 100, names: bool = False) -> DataFrame:
    """(group, bucket, bucket_low, bucket_high, n) at the first contained locus, over the members' shared range.

    With `names` also whose lengths a bucket holds: at most the columns of the matrix, once each.
    """
    long = to_long(first_contained(matrix, chrom, begin, end), header)
    more = [F.array_sort(F.collect_list("sample")).alias("names")] if names else []
    return histogram(long.join(members(metadata, column, values), "sample"), "length", buckets, ("group",), *more)


__all__ = ["KEY", "bucket_of", "first_contained", "group_histogram", "histogram", "locus_histogram", "matches", "members", "side_by_side", "sorted_lengths"]
