"""Outliers of loci as they arrive: the batch operator on a stream of matrix rows.

Outlier detection looks at one locus at a time and keeps nothing, so the plan is
the same under Structured Streaming; no state, no watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tandemlake.operators.outliers import outliers

SCHEMA = "ord long, chrom string, locus_begin long, locus_end long, lengths array<double>"


def stream_outliers(spark: SparkSession, path: str, header: list[str], **how) -> DataFrame:
    """A streaming frame of outliers() over Parquet matrix rows that are added to a folder."""
    return outliers(spark.readStream.schema(SCHEMA).parquet(path), header, **how)
