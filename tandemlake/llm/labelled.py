"""Bounded samples of labelled rows, held-out folds, and scored batches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: crc32 of the id as text leaves 0 by 5. A null id isn't one."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


#: Bytes of text of either label that a sample holds at most.
CLASS_BYTES = 32 << 20


def sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, class_bytes: int = CLASS_BYTES) -> tuple[pa.Table, tuple[int, int]]:
    """(doc_id, text, label): at most `per_class` rows and `class_bytes` of either label, of least digest, outside the held-out fold.

    Also how many ids have either label there, of which these are a part.

    Rows and bytes are bounded by the parameters, whatever the corpus' size and
    however many rows share an id; only ids, digests and sizes are ranked, so no
    text moves but those that are taken. An id labelled more than once counts
    once, by its largest label; rows equal in id and text are one. Null ids and
    labels are left out; a null text is an empty one.
    """
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(label).alias("label"))
    one = one.withColumn("digest", F.xxhash64("doc_id"))
    ids = [one.where(F.col("label") == k).orderBy("digest", "doc_id").limit(per_class) for k in (0, 1)]
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("mark"))
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    rows = texts.join(F.broadcast(ids[0].union(ids[1])), "doc_id").groupBy("doc_id", "mark", "label", "digest").agg(F.max(size).alias("size"))
    order = ["digest", "doc_id", "mark"]
    first = [rows.where(F.col("label") == k).orderBy(*order).limit(per_class) for k in (0, 1)]
    run = F.sum("size").over(Window.partitionBy("label").orderBy(*order))
    picked = first[0].union(first[1]).withColumn("run", run).where(F.col("run") <= class_bytes).select("doc_id", "mark", "label")
    table = texts.join(F.broadcast(picked), ["doc_id", "mark"]).dropDuplicates(["doc_id", "mark"]).select("doc_id", "text", "label").toArrow()
    all_of = {r.label: r.n for r in one.groupBy("label").agg(F.count("*").alias("n")).collect()}
    return table.sort_by([("doc_id", "ascending"), ("text", "ascending")]), (all_of.get(0, 0), all_of.get(1, 0))
