"""Corpus preparation: drop toxic texts, dedupe lines and documents, mix sources, encode.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it
kept; all but the last return the columns of `documents`. run() writes each
stage's rows to the shared folder, so a lost executor costs one stage's tasks.

Lines go before documents are held against each other. So a near copy has lost
the lines that it shares with an earlier document by the time of the n-gram join,
which sees what is left of it: it is caught as lines, hardly ever as a document.

Nulls in any column, empty and very long texts, repeated rows and empty tables
pass through all stages; each stage's docstring says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tandemlake.llm import line_dedup, mixing, ngram_join, pieces, textvec, toxicity
from tandemlake.llm.labelled import sample
from tandemlake.llm.scratch import Scratch


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5; rows equal in text alike, null and empty texts as having no words."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(*sample(docs, labels, "toxic", toxicity.PER_CLASS))
    textvec.release()  # the sample's memory, before the stages that plan much
    return toxicity.score(docs, model).where("score < 0.5").select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier line matches; n_chars follows the text.

    No row goes: a text that loses all its lines is empty, a null one stays null.
    """
    out = line_dedup.dedup_lines(docs)
    return out.withColumn("n_chars", F.when(F.size("lines_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of least id, null last; of one id the text of least digest.

    Groups are of texts, whatever their ids: texts that don't link all stay, with
    null or repeated ids too. Texts without words link with nothing and all stay.
    """
    worded = F.coalesce(F.col("text").rlike(mixing.WORD), F.lit(False))
    key = ngram_join.row_key(F.col("doc_id"), F.col("text"))
    one = docs.where(worded).groupBy(*key).agg(F.min(F.struct("text", *(c for c in docs.columns if c != "text"))).alias("row"))
    one = one.join(ngram_join.first_rows(docs), ["no_id", "id", "digest"], "left_semi")
    return one.select(*(F.col(f"row.{c}").alias(c) for c in docs.columns)).union(docs.where(~worded))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix itself: rows in the order of its schedule, each time that it goes through a document one row.

    Texts are whole, but for those in which a source's target ends: they stop
    after the last word taken, so that each source has its words exactly. n_chars
    follows. Texts without words are in no mix.
    """
    mark = F.xxhash64("doc_id", "text", "source")
    copies = mixing.mix_copies(docs.withColumn("mark", mark), mark=("mark",))
    # rows equal in id, text and source are told apart by a number
    copies = copies.withColumn("no", F.dense_rank().over(Window.partitionBy("mark").orderBy("at")))
    own = docs.where(F.col("text").rlike(mixing.WORD)).withColumn("mark", mark)
    own = own.withColumn("no", F.row_number().over(Window.partitionBy("mark").orderBy(*(c for c in docs.columns if c not in ("doc_id", "text", "source")))))
    part = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(rf"[\x20\x09-\x0D]*{mixing.WORD}"), 0), 1, F.col("words").cast("int")), "")
    out = own.join(copies, ["mark", "no"]).withColumn("cut", F.col("words") < F.col("size")).withColumn("text", F.when(F.col("cut"), part).otherwise(F.col("text")))
    out = out.withColumn("n_chars", F.when(F.col("cut"), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.orderBy("position", "mark", "no", "epoch").select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_ids, ids): the texts' piece ids, a row a row; null and empty texts have none."""
    return pieces.encode(docs.select("doc_id", "source", "text")).select("doc_id", "source", F.size("ids").alias("n_ids"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("n-gram Jaccard join", dedup_documents),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode),
]

#: No SQL: a trained model scores the first stage. tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    scratch = Scratch(spark, "pipeline")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = scratch.keep(docs)
            scratch.clear(docs)
    return docs
