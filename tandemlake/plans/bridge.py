"""Domain-shaped views of a star schema: calls, reads, regions, metadata.

The formulas use whole-number arithmetic only, so that the same views can be
written in any SQL dialect; SQL holds them as text for checks elsewhere.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tandemlake.operators.cohort import to_matrix

SAMPLES = 20
HEADER = [f"s{s:02d}_H{h}" for s in range(SAMPLES) for h in (1, 2)]
#: Length of every contig.
CONTIG_LENGTH = 1_000_000

_PLACE = "chrom, 10000 + 50 * k AS locus_begin, 10010 + 50 * k + k % 30 AS locus_end"

#: The views in DuckDB's dialect.
SQL = {
    "calls": f"""calls AS (
  SELECT k AS ord, {_PLACE}, (2 * sid + hap - 1)::INT AS col_idx, 's' || lpad(sid::VARCHAR, 2, '0') AS sample, hap,
    's' || lpad(sid::VARCHAR, 2, '0') || '_H' || hap AS col,
    CASE WHEN (k + 3 * sid + hap) % 7 = 0 THEN NULL ELSE max(v)::DOUBLE END AS length
  FROM (SELECT l_partkey % 100 AS k, 'chr' || (1 + (l_partkey % 100) % 22) AS chrom, l_orderkey % 20 AS sid, 1 + l_linenumber % 2 AS hap,
    (l_quantity - 25) * CASE WHEN l_extendedprice > 90000 AND l_quantity > 45 AND l_tax = 0 THEN 8 ELSE 1 END AS v FROM lineitem)
  GROUP BY k, chrom, sid, hap)""",
    "grid": f"""grid AS (
  SELECT l.ord, l.chrom, l.locus_begin, l.locus_end, h.col_idx, h.sample, h.hap, h.col, c.length
  FROM (SELECT DISTINCT ord, chrom, locus_begin, locus_end FROM calls) l
  CROSS JOIN (SELECT (2 * s + h - 1)::INT AS col_idx, 's' || lpad(s::VARCHAR, 2, '0') AS sample, h AS hap, 's' || lpad(s::VARCHAR, 2, '0') || '_H' || h AS col
    FROM range({SAMPLES}) a(s), (VALUES (1), (2)) b(h)) h
  LEFT JOIN calls c ON c.ord = l.ord AND c.col_idx = h.col_idx)""",
    "reads": """reads AS (
  SELECT l_orderkey * 10 + l_linenumber AS read_id, k, 'chr' || (1 + k % 22) AS chrom, s AS ref_start,
    s + 30 + ln + CASE WHEN l_tax > 0.06 THEN 5 ELSE 60 END + CASE WHEN op = 'D' THEN n ELSE 0 END AS ref_end,
    CASE WHEN l_tax = 0 THEN 5 ELSE 60 END AS mapq, ln % 3 = 0 AS is_reverse,
    CASE WHEN l_discount = 0 OR (k % 25 = 7 AND ln % 2 = 0) THEN NULL ELSE 1 + ln % 2 END AS hp,
    CASE WHEN q % 9 = 0 THEN 'chr1,' || (s + 20) || ',' || CASE WHEN ln % 2 = 0 THEN '-' ELSE '+' END || ',30M4D,60,1;' || CASE WHEN q % 2 = 0 THEN 'chr2,1,-,9M,60,1;' ELSE '' END END AS sa,
    (30 + ln) || 'M' || n || op || CASE WHEN l_tax > 0.06 THEN 5 ELSE 60 END || 'M' AS cigar, op, n
  FROM (SELECT *, 9960 + 50 * k + CASE WHEN k % 10 = 0 THEN q % 15 ELSE q END AS s, CASE WHEN k % 10 = 0 THEN 6 + q % 20 ELSE 1 + q % 20 END AS n,
      CASE WHEN k % 10 = 0 AND ln > 1 THEN 'S' WHEN l_returnflag = 'R' THEN 'D' WHEN l_returnflag = 'N' THEN 'S' ELSE 'I' END AS op
    FROM (SELECT *, l_partkey % 100 AS k, l_linenumber AS ln, l_quantity::BIGINT AS q FROM lineitem)))""",
    "loci": """loci AS (SELECT k AS ord, 'chr' || (1 + k % 22) AS chrom, 10000 + 50 * k AS locus_begin, 10010 + 50 * k + k % 30 AS locus_end FROM range(100) t(k))""",
    "regions": """regions AS (SELECT p_partkey AS interval_ord, 'chr' || (1 + (5 * p_partkey) % 22) AS chrom, 10000 + (250 * p_partkey) % 5000 AS b, 10000 + (250 * p_partkey) % 5000 + p_size AS e FROM part)""",
    "metadata": """metadata AS (SELECT 's' || lpad(sid::VARCHAR, 2, '0') AS sample, CASE sid % 3 WHEN 0 THEN 'PAT' WHEN 1 THEN 'CON' ELSE 'OTH' END AS grp, balance
  FROM (SELECT c_custkey % 20 AS sid, avg(c_acctbal) AS balance FROM customer GROUP BY 1))""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sample_name(sid):
    return F.concat(F.lit("s"), F.lpad(sid.cast("string"), 2, "0"))


def _place(k):
    return (F.concat(F.lit("chr"), (k % 22 + 1).cast("string")).alias("chrom"), (k * 50 + 10000).alias("locus_begin"), (k * 50 + 10010 + k % 30).alias("locus_end"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, chrom, locus_begin, locus_end, col_idx, sample, hap, length): a row for each locus, sample and haplotype there is."""
    k, sid, hap = F.col("l_partkey") % 100, F.col("l_orderkey") % SAMPLES, F.col("l_linenumber") % 2 + 1
    long = F.when((F.col("l_extendedprice") > 90000) & (F.col("l_quantity") > 45) & (F.col("l_tax") == 0), 8).otherwise(1)
    rows = table(spark, sf_dir, "lineitem").select(k.cast("long").alias("ord"), sid.cast("long").alias("sid"), hap.cast("int").alias("hap"), ((F.col("l_quantity") - 25) * long).cast("double").alias("v"))
    g = rows.groupBy("ord", "sid", "hap").agg(F.max("v").alias("v"))
    length = F.when((F.col("ord") + F.col("sid") * 3 + F.col("hap")) % 7 != 0, F.col("v"))
    return g.select("ord", *_place(F.col("ord")), (F.col("sid") * 2 + F.col("hap") - 1).cast("int").alias("col_idx"), sample_name(F.col("sid")).alias("sample"), "hap", length.alias("length"))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_matrix(calls(spark, sf_dir), HEADER)


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_tax", "l_discount", "l_returnflag", (F.col("l_partkey") % 100).cast("long").alias("k"), F.col("l_linenumber").cast("long").alias("ln"), F.col("l_quantity").cast("long").alias("q"))
    tens = F.col("k") % 10 == 0
    op = F.when(tens & (F.col("ln") > 1), "S").when(F.col("l_returnflag") == "R", "D").when(F.col("l_returnflag") == "N", "S").otherwise("I")
    li = li.select("*", (F.col("k") * 50 + 9960 + F.when(tens, F.col("q") % 15).otherwise(F.col("q"))).alias("s"), (F.col("q") % 20 + F.when(tens, 6).otherwise(1)).alias("n"), op.alias("op"), F.when(F.col("l_tax") > 0.06, 5).otherwise(60).alias("m2"))
    text = lambda c: F.col(c).cast("string")
    sa = F.when(F.col("q") % 9 == 0, F.concat(F.lit("chr1,"), (F.col("s") + 20).cast("string"), F.lit(","), F.when(F.col("ln") % 2 == 0, "-").otherwise("+"), F.lit(",30M4D,60,1;"), F.when(F.col("q") % 2 == 0, "chr2,1,-,9M,60,1;").otherwise("")))
    end = F.col("s") + F.col("ln") + 30 + F.col("m2") + F.when(F.col("op") == "D", F.col("n")).otherwise(0)
    hp = F.when(~((F.col("l_discount") == 0) | ((F.col("k") % 25 == 7) & (F.col("ln") % 2 == 0))), (F.col("ln") % 2 + 1).cast("int"))
    return li.select(
        (F.col("l_orderkey") * 10 + F.col("ln")).alias("read_id"), "k", F.concat(F.lit("chr"), (F.col("k") % 22 + 1).cast("string")).alias("chrom"), F.col("s").alias("ref_start"), end.alias("ref_end"),
        F.when(F.col("l_tax") == 0, 5).otherwise(60).alias("mapq"), (F.col("ln") % 3 == 0).alias("is_reverse"), hp.alias("hp"), sa.alias("sa"),
        F.concat((F.col("ln") + 30).cast("string"), F.lit("M"), text("n"), F.col("op"), text("m2"), F.lit("M")).alias("cigar"),
    )


def loci(spark: SparkSession) -> DataFrame:
    k = F.col("id")
    chrom, begin, end = _place(k)
    return spark.range(100).select(k.alias("ord"), chrom, begin.alias("begin"), end.alias("end"))


def contigs(spark: SparkSession) -> DataFrame:
    return spark.range(1, 23).select(F.concat(F.lit("chr"), F.col("id").cast("string")).alias("chrom"), F.lit(CONTIG_LENGTH).cast("long").alias("length"))


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    begin = (p * 250 % 5000 + 10000).cast("long")
    return table(spark, sf_dir, "part").select(p.cast("long").alias("interval_ord"), F.concat(F.lit("chr"), (p * 5 % 22 + 1).cast("string")).alias("chrom"), begin.alias("begin"), (begin + F.col("p_size")).cast("long").alias("end"))


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    sid = F.col("c_custkey") % SAMPLES
    m = table(spark, sf_dir, "customer").groupBy(sid.alias("sid")).agg(F.avg("c_acctbal").alias("balance"))
    group = F.when(F.col("sid") % 3 == 0, "PAT").when(F.col("sid") % 3 == 1, "CON").otherwise("OTH")
    return m.select(F.col("sid").alias("ord"), sample_name(F.col("sid")).alias("sample"), group.alias("group"), "balance")
