"""Unit vectors: medians, CIGAR folds, 2D reads, predicates, outliers, post-processing, models."""

import gzip
import io
import math
import re
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from tandemlake import cli
from tandemlake.functions import cigar, stats, values
from tandemlake.operators import association, cohort, genotype, intervals, lookup, matrix_association, outliers
from tandemlake.sources import alignments, tables


@pytest.mark.parametrize("spans, clips, want", [((1, 2), (), None), ((10, 20, 30), (), 20), ((10, 20, 30), (900,), 20), ((10, 20), (5, 100), 20), ((), (5, 50, 100, 200), 100), ((1, 2, 3, 4), (1000,), 2.5)])
def test_supported_median(spark, spans, clips, want):
    rows = [(0, 1, c, v, 1) for c, vs in ((False, spans), (True, clips)) for v in vs]
    got = genotype.supported_median(spark.createDataFrame(rows, "ord long, hap int, is_clip boolean, len long, n long"), 3).collect()
    assert [r.length for r in got] == ([] if want is None else [want])


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(-20, 20), st.booleans()), max_size=14), st.integers(1, 4))
def test_supported_median_any(spark, reads, support):
    spans, clips = sorted(v for v, c in reads if not c), sorted((v for v, c in reads if c), reverse=True)
    used = spans + clips[: max(support - len(spans), 0)]
    want = [float(np.median(used))] if len(reads) >= support else []
    rows = spark.createDataFrame([(0, 1, c, v, 1) for v, c in reads], "ord long, hap int, is_clip boolean, len long, n long").groupBy("ord", "hap", "is_clip", "len").agg(F.sum("n").alias("n"))
    assert [r.length for r in genotype.supported_median(rows, support).collect()] == want


FOLDS = [("50M10I50M", 50, 10, False), ("50M5I50M", 50, 0, False), ("50M10D50M", 50, -10, False), ("39M10I60M", 50, 0, False), ("40M10I60M", 50, 10, False), ("78M10I60M", 50, 10, False), ("79M10I60M", 50, 0, False), ("30M20D10I50M", 50, 10, False), ("60M20S", 50, 20, True), ("20S60M", 95, 20, True), ("50M10H", 50, 0, False), ("50M10P50M", 50, 0, False)]


def test_cigar_fold(spark):
    rows = spark.createDataFrame([(c, s) for c, s, *_ in FOLDS], "cigar string, at long")
    call = cigar.repeat_call(F.col("cigar"), F.col("at"), F.lit(90), F.lit(130), 5, F.lit(False))
    assert [(r.cigar, r.at, r.x.len, r.x.is_clip) for r in rows.select("cigar", "at", call.alias("x")).collect()] == FOLDS


def test_accidental_2d(spark):
    sa = [(None, False), ("", False), ("chr1,1500,-,600M,60,3;", True), ("chr1,1500,+,600M,60,3;", False), ("chr1,1500,-,600M,60,3;chr1,9000,-,10M,60,0;", False), ("chr1,2000,-,600M,60,3;", False), ("chr9,1500,-,600M,60,3;", True)]
    rows = spark.createDataFrame([(k, s) for k, (s, _) in enumerate(sa)], "k int, sa string")
    got = rows.select("k", cigar.accidental_2d(F.col("sa"), F.lit(False), F.lit(1000), F.lit(2000)).alias("x")).orderBy("k").collect()
    assert [r.x for r in got] == [w for _, w in sa]


def test_regions(spark):
    given_ = ["chr1:1,000-2,000", "chr1:5-5", "chr1", "a:b:1-2", "HLA-A:1-2", None]
    got = spark.createDataFrame([(k, g) for k, g in enumerate(given_)], "k int, r string").select("k", intervals.parse_region(F.col("r")).alias("p")).orderBy("k").collect()
    assert [r.p and tuple(r.p) for r in got] == [("chr1", 1000, 2000), None, None, None, None, None]


def test_empty_region(spark):
    assert tables.region_frame(spark, "chr1:5-5", empty=True).select("begin", "end").first() == (5, 5)
    with pytest.raises(ValueError):
        tables.region_frame(spark, "chr1:5-5")
    with pytest.raises(ValueError):
        tables.region_frame(spark, "chr1:6-5", empty=True)


def test_predicates(spark):
    rows = spark.createDataFrame([(0, "chr1", 10000, 10468), (1, "chr15", 10000, 10468)], "ord long, chrom string, begin long, end long")
    for (b, e), over, within in (((10000, 10468), 1, 1), ((10468, 11000), 0, 0), ((10100, 10200), 1, 0), ((9000, 11000), 1, 1)):
        region = spark.createDataFrame([("chr1", b, e)], "r_chrom string, r_begin long, r_end long")
        assert intervals.overlap_join(rows, region, 64).count() == over
        own = region.withColumnsRenamed({"r_chrom": "chrom", "r_begin": "begin", "r_end": "end"})
        locus = rows.withColumnsRenamed({"chrom": "r_chrom", "begin": "r_begin", "end": "r_end"})
        assert intervals.overlap_join(own, locus, 64, "contained").count() == within


def test_validate(spark):
    contigs = spark.createDataFrame([("chr7", 159345973)], "chrom string, length long")
    good = spark.createDataFrame([(0, "chr7", 154778571, 154779363)], "ord long, chrom string, begin long, end long")
    assert intervals.validate(good, contigs).count() == 1
    for bad in (("7", 154778571, 154779363), ("chr7", 5, 4), ("chr7", 1, 159345973)):
        with pytest.raises(Exception, match="chr|contig|ends"):
            intervals.validate(spark.createDataFrame([(0, *bad)], good.schema), contigs).collect()


def test_outliers_golden(spark):
    header = [f"s{k}_H1" for k in range(1, 12)]
    m = spark.createDataFrame([(0, "chr1", 1, 2, list(map(float, [1, 2, 2, 3, 1, 5, 3, 2, 2, 1, 120]))), (1, "chr1", 3, 4, [20.0] * 11), (2, "chr1", 5, 6, [None] * 11)], "ord long, chrom string, locus_begin long, locus_end long, lengths array<double>")
    for how in ({"zscore": 2.0}, {"method": "dbscan"}):
        assert [(r.ord, r.outliers) for r in outliers.outliers(m, header, **how).collect()] == [(0, ["s11"])]
    assert outliers.outliers(m, header, zscore=2.0, subset=["s1"]).count() == 0
    assert outliers.min_points(11) == 3
    with pytest.raises(ValueError):
        outliers.min_points(0)


@settings(max_examples=10, deadline=None)
@given(st.lists(st.integers(0, 60), min_size=4, max_size=20))
def test_density_any(spark, lengths):
    m = spark.createDataFrame([(0, "c", 1, 2, [float(v) for v in lengths])], "ord long, chrom string, locus_begin long, locus_end long, lengths array<double>")
    positive = [v for v in lengths if v > 0]
    mode = min((-positive.count(v), v) for v in positive)[1] if positive else 5
    eps, least = max(2 * mode, 10), len(lengths).bit_length() - 1
    core = [v for v in lengths if sum(abs(v - w) <= eps for w in lengths) >= least]
    want = [f"s{k}" for k, v in enumerate(lengths) if not any(abs(v - c) <= eps for c in core)] if max(lengths) >= 10 else []
    got = outliers.outliers(m, [f"s{k}_H1" for k in range(len(lengths))], method="dbscan").collect()
    assert (got[0].outliers if got else []) == want


def test_counts(spark):
    found = spark.createDataFrame([(0, ["a", "a", "b"]), (1, ["b", "c_H1"])], "ord long, outliers array<string>")
    got = outliers.count_outliers(found).orderBy(F.desc("n"), "first_ord", "first_place").collect()
    assert [(r["sample"], r.n) for r in got] == [("a", 2), ("b", 2), ("c", 1)]
    lists = spark.createDataFrame([(0, ["a", "b"]), (1, ["a", "b", "c"]), (2, ["a", "c"])], found.schema)
    assert [(r.ord, r.hits) for r in outliers.multiple_hits(lists, ["a", "b"], 2, 0).collect()] == [(0, 2)]


def test_modes_and_quality(spark):
    h = spark.createDataFrame([(10.0, None), (10.0, 20.0)], "h1 double, h2 double")
    assert [tuple(r) for r in h.select(*(association.str_mode(F.col("h1"), F.col("h2"), m) for m in ("MEAN", "MAX", "MIN"))).collect()] == [(10, 10, 10), (15, 20, 10)]
    locus = (0, "c", 1, 2)
    c = spark.createDataFrame([(*locus, f"s{k}", float(k) if k < 4 else None) for k in range(5)], "ord long, chrom string, locus_begin long, locus_end long, sample string, length double")
    assert association.qualified(c, 0.8).count() == 1 and association.qualified(c, 0.81).count() == 0
    assert association.qualified(c.withColumn("length", F.lit(1.0))).count() == 0


def test_odds(spark):
    cells = [(30, 1, 30.0), (10, 0, 30.0), (20, 1, 1.0), (40, 0, 1.0)]
    rows = [(0, "c", 1, 2, float(y), v) for n, y, v in cells for _ in range(n)]
    c = spark.createDataFrame(rows, "ord long, chrom string, locus_begin long, locus_end long, label double, length double")
    r = association.expanded_odds(c, 23).withColumn("p", association.normal_pvalue(F.col("beta") / F.col("se"))).first()
    assert (round(r.odds_ratio, 6), round(r.beta, 6), round(r.se, 6)) == (6, 1.791759, 0.456435) and r.p == pytest.approx(8.6532e-05, rel=1e-4)
    one = association.fitted(c.withColumn("big", (F.col("length") >= 23).cast("double")), "label", predictor="big").first()
    assert one.beta == pytest.approx(r.beta, rel=1e-8) and one.se == pytest.approx(r.se, rel=1e-6) and one.pvalue == pytest.approx(r.p, rel=1e-6)
    apart = c.withColumn("length", F.col("label") * 10)
    assert association.fitted(apart, "label").first().beta is None


def test_linear(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=30)
    y = 2 * x + rng.normal(size=30)
    c = spark.createDataFrame([(0, "c", 1, 2, float(a), float(b)) for a, b in zip(x, y)], "ord long, chrom string, locus_begin long, locus_end long, length double, y double")
    a, b = association.linear(c, "y").withColumn("p", association.student_pvalue(F.col("t"), (F.col("n") - 2).cast("double"))).first(), association.fitted(c, "y", family="gaussian").first()
    assert a.slope == pytest.approx(b.beta) and a.se == pytest.approx(b.se) and a.p == pytest.approx(b.pvalue, rel=1e-6)
    assert stats.student_p(2.228138852, 10) == pytest.approx(0.05, rel=1e-6) and stats.normal_p(1.959963984540054) == pytest.approx(0.05)


def test_logistic_against_library(spark):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GeneralizedLinearRegression

    rng = np.random.default_rng(3)
    x, z = rng.normal(size=80), rng.normal(size=80)
    y = (rng.random(80) < 1 / (1 + np.exp(-0.8 * x + 0.3 * z))).astype(float)
    c = spark.createDataFrame([(0, "c", 1, 2, *map(float, r)) for r in zip(x, z, y)], "ord long, chrom string, locus_begin long, locus_end long, length double, z double, label double")
    own = association.fitted(c, "label", ["z"]).first()
    m = GeneralizedLinearRegression(family="binomial", labelCol="label", maxIter=50, tol=1e-10).fit(VectorAssembler(inputCols=["length", "z"], outputCol="features").transform(c))
    assert own.beta == pytest.approx(m.coefficients[0], rel=1e-6) and own.se == pytest.approx(m.summary.coefficientStandardErrors[0], rel=1e-5) and own.pvalue == pytest.approx(m.summary.pValues[0], rel=1e-4)


@pytest.mark.parametrize("order, covariates, expanded", [(["CON", "PAT"], [], None), (["CON", "PAT"], ["age"], None), (None, ["flag"], None), (["CON", "PAT"], [], 12.0), (None, [], 12.0)])
def test_matrix_form_says_the_same(spark, order, covariates, expanded):
    rng = np.random.default_rng(9)
    n, loci = 40, 30
    header = [f"p{k}_H{h}" for k in range(n) for h in (1, 2)]
    draw = lambda: float(rng.integers(0, 25)) if rng.random() > 0.12 else None
    rows = [(i, "c", i, i + 1, [draw() if i else 3.0 for _ in header]) for i in range(loci)]
    m = spark.createDataFrame(rows, "ord long, chrom string, locus_begin long, locus_end long, lengths array<double>")
    meta = spark.createDataFrame([(f"p{k}", str(rng.choice(["CON", "PAT", "OTH"])), float(rng.normal()) if k else None, float(k % 2), float(rng.normal())) for k in range(n)], "sample string, group string, age double, flag double, y double")
    c = cohort.pairs(m, header).select("ord", "chrom", "locus_begin", "locus_end", "sample", association.str_mode(F.col("h1"), F.col("h2"), "MAX").alias("length"))
    c = association.keep_qualified(association.with_phenotype(c, meta), 0.8)
    outcome = "y"
    if order:
        c, outcome = association.keep_qualified(association.two_groups(c, "group", order), 0.8), "label"
    c = c.withColumn("big", (F.col("length") >= (expanded or 0)).cast("double"))
    want = {r.ord: r for r in association.fitted(c, outcome, covariates, "binomial" if order else "gaussian", "big" if expanded else "length").collect()}
    got = {r.ord: r for r in matrix_association.associate_matrix(m, header, meta, "group" if order else "y", order, covariates, expanded=expanded).collect()}
    assert set(got) == set(want) and 0 not in got
    for k, w in want.items():
        assert got[k].n == w.n
        for f in ("beta", "se", "effect", "ci_low", "pvalue"):
            assert (got[k][f] is None) == (w[f] is None) and (w[f] is None or got[k][f] == pytest.approx(w[f], rel=1e-5, abs=1e-9))


def test_numbers_and_names(spark):
    rows = spark.createDataFrame([("NaN",), ("4027.0",), ("150.5",), ("10000000",), ("x",), (None,)], "t string")
    assert [r[0] for r in rows.select(values.shown(values.missing_to_null(F.col("t")))).collect()] == ["NaN", "4027", "150.5", "10000000", "NaN", "NaN"]
    names = spark.createDataFrame([("chr10",), ("chr2",), ("chrX",), ("chr1",)], "c string")
    assert [r.c for r in names.orderBy(values.natural_key(F.col("c"))).collect()] == ["chr1", "chr2", "chr10", "chrX"]
    assert spark.range(1).select(values.sample_of(F.lit("A_H1B_H2"))).first()[0] == "A_H1B"


FILES = {
    "one.tsv": "chr1\t10000\t10468\t4027.0  4081.0\nchr1\t11225\t11448\t0.0\t0.0\nchr1\t10627\t10997\t150.0\t117.0\n",
    "two.tsv": "chr1\t10000\t10468\t4000.0  4081.0\nchr1\t11225\t11448\t0.0\t120.0\nchr1\t10627\t10997\tNaN\t117.0\n",
}


def test_combine(spark, tmp_path):
    for n, t in FILES.items():
        (tmp_path / n).write_text(t)
        with gzip.open(tmp_path / f"{n}.gz", "wt") as f:
            f.write(t)
    for end in ("", ".gz"):
        frames = [tables.read_cells(spark, str(tmp_path / (n + end)), header=False)[0] for n in FILES]
        for how in (cohort.combine_keyed, cohort.combine_positional):
            got = {r.locus_begin: r.cells for r in how(frames).collect()}
            assert got == {10000: ["4027.0  4081.0", "4000.0  4081.0"], 11225: ["0.0", "0.0", "0.0", "120.0"], 10627: ["150.0", "117.0", "NaN", "117.0"]}
    short = frames[1].where("locus_begin > 10627")
    with pytest.raises(Exception, match="not once"):
        cohort.combine_keyed([frames[0], short]).collect()
    with pytest.raises(Exception, match="no row"):
        cohort.combine_positional([frames[0], short]).collect()


def test_numbered(spark):
    got = cohort.numbered(spark.range(0, 1000, 3).select(F.col("id").alias("line")), "line").orderBy("line").collect()
    assert [r.ord for r in got] == list(range(len(got)))


MATRIX = "chromosome\tbegin\tend\ta_H1\ta_H2\tb_H1\tb_H2\nchr1\t100\t120\t5\t50\tNaN\t7\nchr1\t200\t220\t1\t2\t3\t4.5\nchr10\t100\t120\t9\t9\t9\t9\n"


def run(capsys, spark, monkeypatch, *argv):
    monkeypatch.setattr(cli, "session", lambda: spark)
    cli.main(list(argv))
    return capsys.readouterr().out.splitlines()


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    m = tmp_path / "m.tsv"
    m.write_text(MATRIX)
    go = lambda *a: run(capsys, spark, monkeypatch, *a)
    assert go("query", str(m), "chr1:90-110") == ["sample\tlength", "a_H2\t50", "b_H2\t7", "a_H1\t5", "b_H1\tNaN"]
    assert go("query", str(m), "chr1:90-210") == ["sample\tchr1:100-120\tchr1:200-220", "a_H1\t5\t1", "a_H2\t50\t2", "b_H1\tNaN\t3", "b_H2\t7\t4.5"]
    assert go("query", str(m), "chr2:1-5") == []
    assert go("outlier", str(m), "-z", "1.5") == ["chrom\tbegin\tend\toutliers", "chr1\t100\t120\ta"]
    assert [(x.split("\t")[0], x.split("\t")[3]) for x in go("histogram", str(m), "chr1:90-130")[1:]] == [("1", "1"), ("5", "1"), ("100", "1")]
    meta = tmp_path / "meta.tsv"
    meta.write_text("individual\tstatus\na\tPAT\nb\tCON\n")
    assert [x.split("\t")[0] for x in go("plot", str(m), str(meta), "chr1:90-130", "-c", "status:PAT,CON")[1:]] == ["CON", "PAT", "PAT"]
    out = tmp_path / "o.tsv"
    out.write_text("chrom\tbegin\tend\toutliers\nchr1\t1\t2\ta,a,b\nchr1\t3\t4\tb,c_H1\n")
    assert go("count-outliers", str(out)) == ["sample\tcount", "a\t2", "b\t2", "c\t1"]
    names = tmp_path / "n.txt"
    names.write_text("a\nb\n\n")
    assert go("multiple-hits", str(out), "-s", str(names)) == ["chrom\tbegin\tend\toutliers\thits", "chr1\t1\t2\ta,a,b\t3"]
    go("plot", str(m), str(meta), "chr1:90-130", "-c", "status:PAT,CON", "-o", str(tmp_path / "p.html"))
    go("count-outliers", str(out), "-o", str(tmp_path / "c.html"))
    assert (tmp_path / "p.html").read_text().count("<rect") == 3 and "<rect" in (tmp_path / "c.html").read_text()
    with pytest.raises(NotImplementedError):
        go("scan")
    with pytest.raises(ValueError):
        go("query", str(m), "nonsense")


def test_gzip_by_content(spark, tmp_path):
    """A name may say otherwise than the file's first bytes; two members are one file."""
    lines = MATRIX.encode().splitlines(True)
    files = {"m.tsv": gzip.compress(b"".join(lines[:2])) + gzip.compress(b"".join(lines[2:])), "plain.gz": MATRIX.replace("\n", "\r\n").encode(), "m.gz": gzip.compress(MATRIX.encode()), "plain.tsv": MATRIX.encode()}
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
        m = tables.read_matrix(spark, str(tmp_path / name))
        assert m.header == ["a_H1", "a_H2", "b_H1", "b_H2"], name
        rows = [(r.chrom, r.locus_begin, r.lengths) for r in m.rows.orderBy("ord").collect()]
        assert rows == [("chr1", 100, [5, 50, None, 7]), ("chr1", 200, [1, 2, 3, 4.5]), ("chr10", 100, [9, 9, 9, 9])], name
    (tmp_path / "none").write_bytes(gzip.compress(b""))
    assert tables.read_cells(spark, str(tmp_path / "none"))[0].count() == 0


def test_lists_pages_and_faults(spark, tmp_path, capsys, monkeypatch):
    go = lambda *a: run(capsys, spark, monkeypatch, *a)
    m, regions, meta, out = (tmp_path / n for n in ("m.tsv", "regions.txt", "meta.tsv", "o.tsv"))
    m.write_text(MATRIX)
    regions.write_text("chr1:90-110\nchr1:190-210\n")
    assert go("query", str(m), str(regions)) == go("query", str(m), "chr1:90-210") == go("-q", "query", str(m), str(regions), "--region-list")
    meta.write_text("individual\tstatus\na\tPAT\nb\tCON\n")
    go("plot", str(m), str(meta), "chr1:190-230", "-c", "status:PAT,CON", "-o", str(tmp_path / "p.html"))
    assert sorted(re.findall(r"<title>(\w+: \d \(\w+\))</title>", (tmp_path / "p.html").read_text())) == ["CON: 1 (b)", "CON: 1 (b)", "PAT: 1 (a)", "PAT: 1 (a)"]
    out.write_text("chrom\tbegin\tend\toutliers\nchr1\t1\t2\ta,a,b\nchr1\t3\t4\tb,c_H1\n")
    go("count-outliers", str(out), "-o", str(tmp_path / "c.html"))
    assert re.findall(r"<circle.*?<title>(.*?)</title>", (tmp_path / "c.html").read_text()) == ["c: 1", "a: 2", "b: 2"]
    for fault, more in (("no sample of group OLD", ("--binary-order", "CON,OLD")), ("two groups", ("--binary-order", "CON")), ("not a variant", ("--variant", "chr1:100")), ("one of a contig", ("--chrom", "chr1", "--region", "chr1:1-5"))):
        with pytest.raises(ValueError, match=fault):
            go("associate", str(m), str(meta), "status", *more)


SAM = "@SQ\tSN:chr1\tLN:1000\n" + "".join(f"r{k}\t{16 * (k % 2)}\tchr1\t51\t60\t50M{10 + k}I60M\t*\t0\t0\t*\t*\tHP:i:{1 + k % 2}\n" for k in range(8)) + "u\t4\t*\t0\t0\t*\t*\t0\t0\t*\t*\n"


def bam(sam: str) -> bytes:
    lines = [x.split("\t") for x in sam.splitlines() if not x.startswith("@")]
    body = b"BAM\1" + struct.pack("<i", 0) + struct.pack("<i", 1) + struct.pack("<i", 5) + b"chr1\0" + struct.pack("<i", 1000)
    for p in lines:
        ops = [(int(n), "MIDNSHP=X".index(o)) for n, o in __import__("re").findall(r"(\d+)([MIDNSHP=X])", p[5])]
        rec = struct.pack("<iiBBHHHiiii", 0 if p[2] != "*" else -1, int(p[3]) - 1, len(p[0]) + 1, int(p[4]), 0, len(ops), int(p[1]), 0, -1, -1, 0) + p[0].encode() + b"\0" + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops)
        if len(p) > 11:
            rec += b"HPC" + bytes([int(p[11][5:])])
        body += struct.pack("<i", len(rec)) + rec
    out = io.BytesIO()
    for k in range(0, len(body), 100):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.write(c.compress(body[k : k + 100]) + c.flush())
    return out.getvalue()


def blocked(body: bytes, size: int) -> bytes:
    """body in blocks whose headers tell their sizes."""
    out = io.BytesIO()
    for k in range(0, len(body), size):
        c = zlib.compressobj(6, zlib.DEFLATED, -15)
        data = c.compress(body[k : k + size]) + c.flush()
        out.write(b"\x1f\x8b\x08\x04" + bytes(6) + struct.pack("<HccHH", 6, b"B", b"C", 2, len(data) + 25) + data + struct.pack("<II", zlib.crc32(body[k : k + size]), len(body[k : k + size])))
    return out.getvalue()


def test_bam_blocks_and_long_cigars():
    plain = b"".join(alignments._inflated(bam(SAM)))
    assert list(alignments.bam_records(blocked(plain, 90))) == list(alignments.bam_records(bam(SAM)))
    steps = struct.pack("<3I", 50 << 4, 10 << 4 | 1, 60 << 4)
    rec = struct.pack("<iiBBHHHiiii", 0, 50, 2, 60, 0, 2, 0, 120, -1, -1, 0) + b"r\0" + struct.pack("<2I", 120 << 4 | 4, 110 << 4 | 3) + bytes(180) + b"CGBI" + struct.pack("<i", 3) + steps + b"HPC\2"
    head = plain[:25]
    assert [r[4:] for r in alignments.bam_records(blocked(head + struct.pack("<i", len(rec)) + rec, 1000))] == [(2, None, "50M10I60M")]


def test_associate_last_rows_and_delimiter(spark, tmp_path):
    (tmp_path / "p.csv").write_text("individual,age\na,1\nb,2\na,3\n")
    at = str(tmp_path / "p.csv")
    got = association.last_rows(tables.read_metadata(spark, at, "age", tables.delimiter(spark, at)).coalesce(1))
    assert sorted((r["sample"], r["age"]) for r in got.collect()) == [("a", "3"), ("b", "2")]


def test_call_from_files(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "x.sam").write_text(SAM)
    (tmp_path / "x.bam").write_bytes(bam(SAM))
    bed = tmp_path / "t.bed"
    bed.write_text("chr1\t95\t110\nchr1\t500\t510\n")
    for kind in ("sam", "bam"):
        got = run(capsys, spark, monkeypatch, "call", str(tmp_path / f"x.{kind}"), "-R", str(bed))
        assert got == ["chromosome\tbegin\tend\tx_H1\tx_H2", "chr1\t95\t110\t13\t14", "chr1\t500\t510\tNaN\tNaN"]
    assert run(capsys, spark, monkeypatch, "call", str(tmp_path / "x.sam"), "-r", "chr1:95-110", "-u")[1] == "chr1\t95\t110\t11.5\t15.5"
    with pytest.raises(ValueError):
        cli.main(["call", str(tmp_path / "x.sam")])


@pytest.mark.parametrize("kind", ["sam", "bam"])
def test_call_outside_the_contigs(spark, tmp_path, capsys, monkeypatch, kind):
    at = tmp_path / f"x.{kind}"
    at.write_bytes(SAM.encode() if kind == "sam" else bam(SAM))
    for region, fault in (("chr9:95-110", "unknown contig"), ("chr1:990-1010", "past its contig")):
        with pytest.raises(Exception, match=fault):
            run(capsys, spark, monkeypatch, "call", str(at), "-r", region)


def test_associate(spark, tmp_path, capsys, monkeypatch):
    rng = np.random.default_rng(0)
    names = [f"p{k}" for k in range(40)]
    m = tmp_path / "m.tsv"
    m.write_text("chromosome\tbegin\tend\t" + "\t".join(f"{n}_H{h}" for n in names for h in (1, 2)) + "\n" + "chr1\t1\t9\t" + "\t".join(str(int(rng.integers(0, 30))) for _ in range(80)) + "\n")
    p = tmp_path / "p.tsv"
    p.write_text("individual\tstatus\tage\n" + "".join(f"{n}\t{'PAT' if rng.random() < 0.5 else 'CON'}\t{40 + k}\n" for k, n in enumerate(names)))
    got = run(capsys, spark, monkeypatch, "associate", str(m), str(p), "status", "--binary-order", "CON,PAT", "--covariates", "age")
    assert got[0].startswith("variant\tn\tbeta") and "avg_CON" in got[0] and got[1].split("\t")[:2] == ["chr1:1_9", "40"]
    assert len(run(capsys, spark, monkeypatch, "associate", str(m), str(p), "status", "--binary-order", "CON,PAT", "--variant", "chr1_1_9")) == 2
    assert run(capsys, spark, monkeypatch, "associate", str(m), str(p), "age", "--expanded", "15", "--region", "chr1:0-10")[1].startswith("chr1:1_9_ExpandedAllele\t40")


def test_stream(spark, tmp_path):
    from tandemlake.streaming.outliers import SCHEMA, stream_outliers

    header = [f"s{k}_H1" for k in range(1, 12)]
    spark.createDataFrame([(0, "chr1", 1, 2, list(map(float, [1, 2, 2, 3, 1, 5, 3, 2, 2, 1, 120])))], SCHEMA).write.parquet(str(tmp_path / "in"))
    q = stream_outliers(spark, str(tmp_path / "in"), header, zscore=2.0).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.outliers for r in spark.table("found").collect()] == [["s11"]]


def test_histogram_edges(spark):
    v = spark.createDataFrame([(5.0,), (5.0,), (None,)], "length double")
    assert [(r.bucket, r.n) for r in lookup.histogram(v).collect()] == [(1, 2)]
    v = spark.createDataFrame([(float(k),) for k in range(101)], "length double")
    got = {r.bucket: r.n for r in lookup.histogram(v).collect()}
    assert got[100] == 2 and len(got) == 100 and math.isclose(sum(got.values()), 101)
