"""Connected components by minimum labels with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, label): each end of an edge (a, b) with the least end that it is joined to.

    Each round takes the least label among a vertex and its neighbours and then
    that label's own label, so rounds grow with the logarithm of the diameter.
    Both steps are joins and partial minima: no vertex needs its edges together.
    Null ends are left out; an empty table gives an empty one.
    """
    both = edges.select("a", "b").where("a is not null and b is not null")
    both = scratch.keep(both.union(both.select("b", "a")).distinct())
    label = scratch.keep(both.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.first("a")).alias("label")))
    while True:
        near = both.join(label, both.b == label.v).groupBy(F.col("a").alias("v")).agg(F.min("label").alias("near"))
        step = label.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "near").alias("mid"))
        up = label.select(F.col("v").alias("mid"), F.col("label").alias("up"))
        new = scratch.keep(step.join(up, "mid").select("v", "old", F.least("mid", "up").alias("label")))
        changed = new.where("old <> label").limit(1).count()
        scratch.drop(label)
        label = new.select("v", "label")
        label._scratch_path = new._scratch_path
        if not changed:
            scratch.drop(both)
            return label
