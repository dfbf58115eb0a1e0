"""Missing lengths, printed numbers, sample names and natural order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once for a row, also where lambdas in body use it for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def once(df, **columns: Column):
    """df with columns that what follows uses as values: a filter on them doesn't work them out again."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))))


def missing_to_null(value: Column) -> Column:
    """A length as double; NaN, and text that is no number, is null."""
    number = value.try_cast("double")
    return F.when(~F.isnan(number), number)


def shown(value: Column) -> Column:
    """A length as files print it: NaN for null, no fraction for whole numbers."""
    whole = (value == F.floor(value)) & (F.abs(value) < 9e15)
    return F.when(value.isNull(), "NaN").when(whole, value.cast("long").cast("string")).otherwise(value.cast("string"))


def sample_of(column: Column) -> Column:
    """A column's sample: its name without the haplotype at its end."""
    return F.regexp_replace(column, "_H[12]$", "")


def natural_key(name: Column, width: int = 18) -> Column:
    """An array that sorts names with their numbers as numbers: chr2 before chr10."""
    runs = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), 1)
    return F.transform(runs, lambda x: F.when(x.rlike(r"^\d"), F.lpad(x, width, "0")).otherwise(x))
