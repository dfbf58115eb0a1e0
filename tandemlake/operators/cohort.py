"""The cohort matrix: its two forms, and how per-sample calls come together.

Array form: (ord, chrom, locus_begin, locus_end, lengths), lengths in the order
of a header of column names. Long form: a row a column, with sample and haplotype.
Per-locus work stays on the array form, which needs no shuffle.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tandemlake.functions.values import sample_of

KEY = ("chrom", "locus_begin", "locus_end")


def header_array(header: list[str]) -> Column:
    return F.array(*map(F.lit, header))


def to_long(matrix: DataFrame, header: list[str]) -> DataFrame:
    """(ord, chrom, locus_begin, locus_end, col_idx, column, sample, hap, length): haplotypes by odd and even column."""
    each = F.posexplode(F.arrays_zip("lengths", header_array(header).alias("column")))
    out = matrix.select("ord", *KEY, each.alias("col_idx", "cell"))
    return out.select("ord", *KEY, "col_idx", "cell.column", sample_of(F.col("cell.column")).alias("sample"), (F.col("col_idx") % 2 + 1).alias("hap"), F.col("cell.lengths").alias("length"))


def to_matrix(long: DataFrame, header: list[str]) -> DataFrame:
    """Array form of (ord, chrom, locus_begin, locus_end, col_idx, length)."""
    cells = F.map_from_entries(F.collect_list(F.struct("col_idx", "length")))
    wide = long.groupBy("ord", *KEY).agg(cells.alias("cells"))
    return wide.select("ord", *KEY, F.transform(F.sequence(F.lit(0), F.lit(len(header) - 1)), lambda i: F.try_element_at(F.col("cells"), i)).alias("lengths"))


def pairs(matrix: DataFrame, header: list[str]) -> DataFrame:
    """(ord, chrom, locus_begin, locus_end, sample, h1, h2): odd and even columns of the header beside each other."""
    samples = [header[i].removesuffix("_H1") for i in range(0, len(header), 2)]
    cell = lambda i: F.struct(F.lit(samples[i]).alias("sample"), F.get("lengths", F.lit(2 * i)).alias("h1"), F.get("lengths", F.lit(2 * i + 1)).alias("h2"))
    if len(samples) > 64:  # one expression whatever the number of samples
        both = F.transform(F.sequence(F.lit(0), F.lit(len(samples) - 1)), lambda i: F.struct(F.get(header_array(samples), i).alias("sample"), F.get("lengths", i * 2).alias("h1"), F.get("lengths", i * 2 + 1).alias("h2")))
    else:
        both = F.array(*map(cell, range(len(samples))))
    return matrix.select("ord", *KEY, F.inline(both))


def combine_keyed(files: list[DataFrame]) -> DataFrame:
    """Rows of text cells (ord, chrom, locus_begin, locus_end, cells) joined by locus; a locus that any file lacks is an error.

    Files are put one under the other and gathered by locus: one shuffle for any
    number of files.
    """
    stacked = reduce(DataFrame.unionByName, [f.withColumn("file", F.lit(k)) for k, f in enumerate(files)])
    g = stacked.groupBy(*KEY).agg(F.min(F.when(F.col("file") == 0, F.col("ord"))).alias("ord"), F.array_sort(F.collect_list(F.struct("file", "ord", "cells"))).alias("parts"))
    whole = (F.size("parts") == len(files)) & (F.size(F.array_distinct(F.col("parts.file"))) == len(files))
    cells = F.when(whole, F.flatten(F.col("parts.cells"))).otherwise(F.raise_error(F.concat(F.lit("not once in every file: "), F.concat_ws(":", *KEY))).cast("array<string>"))
    return g.select("ord", *KEY, cells.alias("cells"))


def combine_positional(files: list[DataFrame]) -> DataFrame:
    """Row i of the first file, and after it the cells of row i of all others; their keys aren't looked at.

    A later file that is shorter is an error; rows beyond the first's are left out.
    """
    stacked = reduce(DataFrame.unionByName, [f.withColumn("file", F.lit(k)) for k, f in enumerate(files)])
    lead = lambda c: F.min(F.when(F.col("file") == 0, F.col(c))).alias(c)
    g = stacked.groupBy("ord").agg(*map(lead, KEY), F.array_sort(F.collect_list(F.struct("file", "cells"))).alias("parts")).where(F.col("parts")[0]["file"] == 0)
    cells = F.when(F.size("parts") == len(files), F.flatten(F.col("parts.cells"))).otherwise(F.raise_error(F.concat(F.lit("a later file has no row "), F.col("ord").cast("string"))).cast("array<string>"))
    return g.select("ord", *KEY, cells.alias("cells"))


def numbered(rows: DataFrame, order: str) -> DataFrame:
    """rows with `ord`, 0 on, by a unique column: counts a range partition first, so no single task sees all."""
    part = rows.repartitionByRange(F.col(order)).withColumn("__part", F.spark_partition_id())
    sizes = part.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inner = F.row_number().over(Window.partitionBy("__part").orderBy(order))
    return part.join(sizes, "__part").withColumn("ord", F.col("__before") + inner - 1).drop("__part", "__before")
