"""Text tables of the toolset: matrices, per-sample calls, metadata, regions, lists; and their sinks.

Matrices are read by position: three key fields, then one field a haplotype
column. Their width depends on the data, so lengths go into one array column.
Reading keeps file order as `ord`. Gzip is told by a file's first bytes; metadata's by extension.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tandemlake.functions.values import missing_to_null, natural_key, shown
from tandemlake.operators.intervals import parse_region

KEY = ("chrom", "locus_begin", "locus_end")


@dataclass
class Matrix:
    """Array form of a cohort matrix with its column names."""

    rows: DataFrame
    header: list[str]


def _gzipped(spark: SparkSession, path: str) -> bool:
    """Whether a file begins as gzip does. Of folders, patterns and what isn't there, the name decides."""
    context = spark.sparkContext
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(context._jsc.hadoopConfiguration())
    if not files.exists(at) or files.getFileStatus(at).isDirectory():
        return path.endswith(".gz")
    stream = files.open(at)
    try:
        return (stream.read(), stream.read()) == (0x1F, 0x8B)
    finally:
        stream.close()


def _unnamed(gzipped: bool):
    """The lines of files whose name doesn't tell that they are, or aren't, gzip."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                raw = io.BytesIO(content.as_buffer())
                stream, at = gzip.GzipFile(fileobj=raw) if gzipped else raw, 0
                while lines := stream.readlines(1 << 20):
                    values = [x.rstrip(b"\r\n").decode("utf-8", "replace") for x in lines]
                    yield pa.RecordBatch.from_arrays([pa.array(range(at, at + len(lines)), pa.int64()), pa.array(values, pa.string())], ["ord", "value"])
                    at += len(lines)

    return run


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(ord, value): the lines of one text file, in order, without a line end of either kind.

    A file whose name says otherwise than its first bytes is read whole by one task (up to 2 GB).
    """
    gzipped = _gzipped(spark, path)
    if gzipped != path.endswith(".gz"):
        lines = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_unnamed(gzipped), "ord long, value string")
    else:
        lines = spark.read.text(path).select(F.monotonically_increasing_id().alias("ord"), F.rtrim(F.col("value"), F.lit("\r")).alias("value"))
    return lines.where("value <> ''")


def _keys(parts: Column) -> list[Column]:
    return [F.get(parts, F.lit(0)).alias("chrom"), F.get(parts, F.lit(1)).try_cast("long").alias("locus_begin"), F.get(parts, F.lit(2)).try_cast("long").alias("locus_end")]


def read_cells(spark: SparkSession, path: str, header: bool = True) -> tuple[DataFrame, list[str]]:
    """(ord, chrom, locus_begin, locus_end, cells) with the fields after the keys as text, and their names."""
    lines = _lines(spark, path)
    names: list[str] = []
    if header:
        top = lines.first()  # of the first split alone
        if top is None:
            return lines.select("ord", *(F.lit(None).cast(t).alias(c) for c, t in zip(KEY, ("string", "long", "long"))), F.array().cast("array<string>").alias("cells")), names
        names = top.value.split("\t")[3:]
        lines = lines.where(F.col("ord") != top.ord)
    parts = F.split("value", "\t")
    return lines.select("ord", *_keys(parts), F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0))).alias("cells")), names


def read_matrix(spark: SparkSession, path: str, chrom: str | None = None) -> Matrix:
    """A cohort matrix (rows whose places are no numbers have null ones); with chrom only that contig, told from the line's beginning before it is split."""
    lines = _lines(spark, path)
    top = lines.first()  # of the first split alone
    if top is None:
        raise ValueError(f"{path} is empty")
    lines = lines.where(F.col("ord") != top.ord)
    if chrom is not None:
        lines = lines.where(F.startswith(F.col("value"), F.lit(f"{chrom}\t")))
    parts = F.split("value", "\t")
    lengths = F.transform(F.slice(parts, 4, F.greatest(F.size(parts) - 3, F.lit(0))), missing_to_null)
    return Matrix(lines.select("ord", *_keys(parts), lengths.alias("lengths")), top.value.split("\t")[3:])


def read_bed(spark: SparkSession, path: str) -> DataFrame:
    """(ord, chrom, begin, end): the first three fields."""
    parts = F.split("value", "\t")
    return _lines(spark, path).select("ord", F.get(parts, F.lit(0)).alias("chrom"), F.get(parts, F.lit(1)).try_cast("long").alias("begin"), F.get(parts, F.lit(2)).try_cast("long").alias("end"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """(interval_ord, chrom, begin, end): a region a line; a malformed one is an error."""
    r = _lines(spark, path).select(F.col("ord").alias("interval_ord"), "value", parse_region(F.col("value")).alias("r"))
    good = F.when(F.col("r").isNotNull(), F.col("r.chrom")).otherwise(F.raise_error(F.concat(F.lit("not a region: "), F.col("value"))).cast("string"))
    return r.select("interval_ord", good.alias("chrom"), "r.begin", "r.end")


def region_frame(spark: SparkSession, region: str, empty: bool = False) -> DataFrame:
    """One region given as text; with `empty` it may end where it begins."""
    r = spark.createDataFrame([(0, region)], "interval_ord long, value string").select("interval_ord", parse_region(F.col("value"), empty).alias("r"))
    if r.where("r is null").count():
        raise ValueError(f"not a region: {region}")
    return r.select("interval_ord", "r.chrom", "r.begin", "r.end")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether the session's file systems hold this path; text that can't be one doesn't exist."""
    context = spark.sparkContext
    try:
        at = context._jvm.org.apache.hadoop.fs.Path(path)
    except (Py4JJavaError, IllegalArgumentException):  # a region's colon, say, is no scheme
        return False
    return at.getFileSystem(context._jsc.hadoopConfiguration()).exists(at)


def read_names(spark: SparkSession, path: str) -> list[str]:
    """A short list of names, one a line."""
    return [r.value.strip() for r in _lines(spark, path).orderBy("ord").collect() if r.value.strip()]


def delimiter(spark: SparkSession, path: str) -> str:
    """What parts the fields of a file's first line: a tab, else the commonest of , ; | and blank."""
    top = _lines(spark, path).first()
    line = "" if top is None else top.value
    return "\t" if "\t" in line else max(",;| ", key=line.count)


def read_metadata(spark: SparkSession, path: str, column: str, sep: str = "\t") -> DataFrame:
    """(ord, sample, all columns): the first column is the sample; `column` must be there."""
    m = spark.read.option("sep", sep).option("header", True).csv(path)
    if column not in m.columns:
        raise ValueError(f"no column {column} in {path}")
    return m.withColumn("ord", F.monotonically_increasing_id()).withColumn("sample", F.col(f"`{m.columns[0]}`"))


def parse_condition(text: str) -> tuple[str, list[str]]:
    """column:value1,value2"""
    column, colon, values = text.partition(":")
    if not (column and colon and values):
        raise ValueError(f"not column:values: {text}")
    return column, values.split(",")


def read_outliers(spark: SparkSession, path: str) -> DataFrame:
    """(ord, chrom, locus_begin, locus_end, outliers) of a written outlier table."""
    cells, _ = read_cells(spark, path)
    return cells.select("ord", *KEY, F.filter(F.split(F.get("cells", F.lit(0)), ","), lambda x: x != "").alias("outliers"))


def write_text(rows: DataFrame, path: str, header: list[str]) -> None:
    """Tab-parted text with a header, all columns as they are shown."""
    rows.select(*(shown(F.col(c)).alias(c) if t == "double" else F.col(c).cast("string").alias(c) for c, t in rows.dtypes)).toDF(*header).write.option("sep", "\t").option("header", True).option("quote", "").option("nullValue", "NaN").csv(path)


def write_genotypes(found: DataFrame, path: str, sample: str, natural: bool = True) -> None:
    """Per-sample calls, by contig in natural order and place, or in the order of the loci."""
    order = [natural_key(F.col("chrom")), "locus_begin", "locus_end"] if natural else ["ord"]
    write_text(found.orderBy(*order).select(*KEY, "h1", "h2"), path, ["chromosome", "begin", "end", f"{sample}_H1", f"{sample}_H2"])


def write_cells(combined: DataFrame, path: str, header: list[str] | None = None) -> None:
    """A combined matrix, its cells as they were read."""
    out = combined.orderBy("ord").select(F.concat_ws("\t", "chrom", F.col("locus_begin").cast("string"), F.col("locus_end").cast("string"), F.array_join("cells", "\t")).alias("value"))
    if header is not None:
        top = combined.sparkSession.createDataFrame([("\t".join(["chromosome", "begin", "end", *header]),)], "value string")
        out = top.union(out)
    out.write.text(path)


def write_outliers(found: DataFrame, path: str) -> None:
    write_text(found.orderBy("ord").select(*KEY, F.array_join("outliers", ",").alias("outliers")), path, ["chrom", "begin", "end", "outliers"])
