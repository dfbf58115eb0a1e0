"""Joins whose keys may hold a large share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Lots that the rows of one key are dealt to at most, by hash.
LOTS = 64


def meet(left: DataFrame, right: DataFrame, key: list[str], block: int) -> DataFrame:
    """left and right joined on key, a long list of one key in blocks.

    Lists of more than `block` rows on either side are cut by a hash of the row,
    and blocks meet each other in units of their own, so that no task has to hold
    more of a key than two blocks. Every two rows of a key meet once. Beside the
    key, columns have to differ in name; rows with null keys meet nothing.
    """
    plan = left.groupBy(*key).agg(F.ceil(F.count("*") / block).alias("__l")).join(right.groupBy(*key).agg(F.ceil(F.count("*") / block).alias("__r")), key)
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    one_of = lambda rows, n: F.pmod(F.xxhash64(*rows.columns), F.col(n))
    x = left.join(plan, key).withColumn("__i", one_of(left, "__l")).withColumn("__j", all_of("__r")).drop("__l", "__r")
    y = right.join(plan, key).withColumn("__j", one_of(right, "__r")).withColumn("__i", all_of("__l")).drop("__l", "__r")
    return x.join(y, [*key, "__i", "__j"]).drop("__i", "__j")


def bring(rows: DataFrame, key: str, by: str, table: DataFrame) -> DataFrame:
    """rows with the columns of their key's one row in table.

    Rows of one key are dealt to LOTS lots by a hash of `by`; the table's row goes
    to each lot that occurs, never oftener than there are rows.
    """
    rows = rows.withColumn("__lot", F.pmod(F.xxhash64(by), F.lit(LOTS)))
    return rows.join(rows.select(key, "__lot").distinct().join(table, key), [key, "__lot"]).drop("__lot")
