"""Mixing sources to target weights by a low-discrepancy slot schedule.

Each source's documents are shuffled (by a digest of id and text) and laid end to
end; the row of words is cut into blocks of equal size and, where the target is
above the source's size, gone through a second time. The mix is a sequence of
slots. Slot k has the van der Corput point of k; the point falls into one
source's stretch of the cumulative weights. The j-th slot of a source takes its
j-th block, up to the source's target (the last block is cut to end there).

The first 2^m points are all multiples of 2^-m, so a source's slots are the
bit-reversed numbers of a stretch of multiples: they are listed without a search,
and any run of slots holds each source to its weight within a few blocks.

Only ids and sizes are shuffled, never texts. Sums along a source are taken in
two steps over digest ranges, so a source with a third of all documents is many
tasks' work. Blocks grow with the corpus up to BLOCK_WORDS, from there the number
of slots does. What is held in one task: a row a source, a source's slots, and
rows that are equal in id and text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import Scratch

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
#: Share of all words that the mix takes, and how often a source may be gone through.
TOTAL_PERCENT, EPOCHS = 150, 2
#: Slots of the schedule: 2^SLOT_BITS points, or more, for about half as many blocks of BLOCK_WORDS at most.
SLOT_BITS, BLOCK_WORDS = 17, 1 << 20
#: Documents that one stretch of a source's sum holds, about.
STRETCH = 1024


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shuffle_key(doc_id: Column, text: Column) -> Column:
    """By this documents are shuffled: a digest of id and text, so that repeated or missing ids spread too."""
    return F.md5(F.concat_ws(":", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")))))


def targets(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """(source, source_size, target, cum, total): shares by weight, up to EPOCHS times a source's size.

    sizes: (source, source_size), a row a source. Weights go by code point order
    of the sources, null last. What a full source leaves goes to the others by
    weight, until none is above its limit: with sources in order of limit over
    weight, a source is full if its limit is at most its share of what those
    before it leave. cum is the sum of targets before it.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int")).cast("double")
    s = sizes.select("source", "source_size", weight.alias("w"), place.alias("place"))
    everything = Window.partitionBy()
    limit = (F.col("source_size") * EPOCHS).cast("double")
    s = s.withColumn("cap", limit).withColumn("goal", F.sum("source_size").over(everything) * (TOTAL_PERCENT / 100.0)).withColumn("all_w", F.sum("w").over(everything))
    before = Window.orderBy(F.col("cap") / F.col("w"), "place").rowsBetween(Window.unboundedPreceding, -1)
    rest_w = F.col("all_w") - F.coalesce(F.sum("w").over(before), F.lit(0.0))
    rest = F.col("goal") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    s = s.withColumn("full", F.col("cap") * rest_w <= F.col("w") * rest)
    free_w, free = (F.sum(F.when(~F.col("full"), F.col("w"))).over(everything), F.col("goal") - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(everything), F.lit(0.0)))
    s = s.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(F.col("w") * free / free_w))
    order = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    return s.select("source", "source_size", "target", F.coalesce(F.sum("target").over(order), F.lit(0.0)).alias("cum"), F.col("goal").alias("total"))


def slots(sources: DataFrame, block: Column, bits: int = SLOT_BITS) -> DataFrame:
    """(source, block_no, position): the schedule, from (source, target, cum, total).

    A source with more blocks than points (a very small one, at the ends of its
    stretch) has the rest after all other slots, so none goes short.
    """
    n = 1 << bits
    lo = F.ceil(F.try_divide("cum", "total") * n).cast("long")
    hi = F.ceil(F.try_divide(F.col("cum") + F.col("target"), F.col("total")) * n).cast("long")
    wanted = F.ceil(F.round("target") / block).cast("long")
    s = sources.select("source", lo.alias("lo"), F.least(hi, F.lit(n)).alias("hi"), wanted.alias("wanted")).where("wanted > 0")
    point = s.where("hi > lo").select("source", "wanted", F.explode(F.sequence("lo", F.col("hi") - 1)).alias("i"))
    position = F.conv(F.reverse(F.lpad(F.bin("i"), bits, "0")), 2, 10).cast("long")
    point = point.select("source", "wanted", position.alias("position"))
    ranked = point.withColumn("block_no", F.row_number().over(Window.partitionBy("source").orderBy("position")).cast("long") - 1)
    late = s.select("source", "wanted", F.greatest(F.col("hi") - F.col("lo"), F.lit(0)).alias("have")).where("wanted > have")
    late = late.select("source", F.explode(F.sequence(F.col("have"), F.col("wanted") - 1)).alias("block_no")).withColumn("position", F.col("block_no") + n)
    return ranked.where("block_no < wanted").select("source", "block_no", "position").union(late.select("source", "block_no", "position"))


def _laid_out(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights, mark: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    d = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), word_count(F.col(text_col)).alias("size"), shuffle_key(F.col(id_col), F.col(text_col)).alias("key"), *mark)
    # digest ranges: as many as documents / STRETCH
    scratch = Scratch(docs.sparkSession, "mixing")
    d = scratch.keep(d)
    many = max(1, min(1 << 30, -(-d.count() // STRETCH)))
    stretch = F.shiftright(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * many, 32)
    d = d.withColumn("stretch", stretch)
    part = d.groupBy("source", "stretch").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    part = part.withColumn("offset", F.coalesce(F.sum("words").over(before), F.lit(0)))
    sources = targets(part.groupBy("source").agg(F.sum("words").alias("source_size")), weights)
    within = Window.partitionBy("source", "stretch").orderBy("key", F.col("doc_id").asc_nulls_first(), "size", *mark).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    o = part.select(F.col("source").alias("s"), F.col("stretch").alias("t"), "offset")
    d = d.join(o, d.source.eqNullSafe(o.s) & (d.stretch == o.t)).select("doc_id", "source", "size", (F.col("offset") + F.col("inner")).alias("at"), *mark)
    return scratch.keep(d), scratch.keep(sources)


def mix_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, bits: int | None = None, mark: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """The mix as pieces, and the documents with their source's figures.

    Pieces: (position, source, at, doc_id, first_word, end_word, epoch), a row
    for each slot and document that it takes words of; by position, at, they are
    the mix. Documents: (source, at, doc_id, size, source_size, target). `at` is
    the place of a document's first word in its source: with the source it tells
    rows that have words apart. bits: of the schedule; None: as many as keep
    blocks within BLOCK_WORDS, SLOT_BITS at least.
    """
    d, sources = _laid_out(docs, id_col, text_col, source_col, weights, mark)
    if bits is None:
        total = (sources.agg(F.max("total").alias("n")).first().n or 0) / BLOCK_WORDS
        bits = max(SLOT_BITS, math.ceil(math.log2(max(total, 1))) + 1)
    block = F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(1 << (bits - 1)))).cast("long")
    schedule = slots(sources, block, bits)
    s = sources.select(F.col("source").alias("s"), "source_size", "target", block.alias("block"))
    d = d.join(s, d.source.eqNullSafe(s.s)).drop("s")
    end = F.round("target").cast("long")
    epoch = d.where("size > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(EPOCHS - 1))))
    epoch = epoch.withColumn("from", F.col("at") + F.col("epoch") * F.col("source_size")).withColumn("to", F.least(F.col("from") + F.col("size"), end)).where("to > from")
    cut = epoch.withColumn("block_no", F.explode(F.sequence(F.floor(F.col("from") / F.col("block")), F.floor((F.col("to") - 1) / F.col("block")))))
    k = schedule.select(F.col("source").alias("s"), F.col("block_no").alias("n"), "position")
    taken = cut.join(k, cut.source.eqNullSafe(k.s) & (cut.block_no == k.n))
    first = F.greatest("from", F.col("block_no") * F.col("block")) - F.col("from")
    last = F.least("to", (F.col("block_no") + 1) * F.col("block")) - F.col("from")
    pieces = taken.select("position", "source", "at", "doc_id", first.alias("first_word"), last.alias("end_word"), "epoch")
    return pieces, d.select("source", "at", "doc_id", "size", "source_size", "target", *mark)


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, bits: int | None = None, mark: tuple[str, ...] = ()) -> DataFrame:
    """(doc_id, size, source, source_size, target, taken, first_slot, n_pieces): words of each document that the mix takes, and where.

    first_slot: the earliest position of the schedule at which words of the
    document stand, null where none is taken; n_pieces: how many pieces they are.
    A null text has size 0 and takes nothing; a null source is a source, the
    last one. Sources take round(target) words exactly, no document more than
    EPOCHS times its size. Ties in the shuffle go by id, then size; repeated
    rows are documents of their own. No words at all: targets 0. An empty table
    gives an empty one. Columns beside the three named aren't read, but for those
    of `mark`: they come along and break ties in the shuffle after the size.
    """
    pieces, d = mix_pieces(docs, id_col, text_col, source_col, weights, bits, mark)
    words = F.sum(F.col("end_word") - F.col("first_word")).alias("taken")
    own = pieces.groupBy(F.col("source").alias("s"), F.col("at").alias("t")).agg(words, F.min("position").alias("first_slot"), F.count("*").alias("n_pieces"))
    some = [F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot", F.coalesce("n_pieces", F.lit(0)).alias("n_pieces")]
    return d.join(own, d.source.eqNullSafe(own.s) & (d["at"] == own.t) & (d["size"] > 0), "left").select("doc_id", "size", "source", "source_size", "target", *some, *mark)


def mix_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, bits: int | None = None, mark: tuple[str, ...] = ()) -> DataFrame:
    """(position, at, words, epoch, size, mark): a row for each time that the mix goes through a document, from its first word on.

    position: its first slot; words: `size`, but for the document in which a
    source's target ends. Rows as for mix_sources; those without words have none.
    """
    pieces, d = mix_pieces(docs, id_col, text_col, source_col, weights, bits, mark)
    words = F.sum(F.col("end_word") - F.col("first_word")).cast("long").alias("words")
    own = pieces.groupBy(F.col("source").alias("s"), F.col("at").alias("t"), "epoch").agg(words, F.min("position").alias("position"))
    return own.join(d.where("size > 0"), d.source.eqNullSafe(own.s) & (d["at"] == own.t)).select("position", "at", "words", "epoch", "size", *mark)
