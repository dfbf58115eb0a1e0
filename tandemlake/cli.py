"""Command line: call, combine, query, outlier, histogram, plot, associate, count-outliers, multiple-hits."""

from __future__ import annotations

import argparse
import logging
import re

from pyspark.sql import DataFrame, functions as F

from tandemlake.functions.values import natural_key, shown
from tandemlake.operators import association, cohort, genotype, intervals, lookup, matrix_association, outliers
from tandemlake.session import session
from tandemlake.sources import alignments, charts, tables

log = logging.getLogger("tandemlake")


def _print(rows: DataFrame, header: list[str]) -> None:
    print("\t".join(header))
    out = rows.select(*(shown(F.col(c)).alias(f"c{k}") if t == "double" else F.col(c).cast("string").alias(f"c{k}") for k, (c, t) in enumerate(rows.dtypes)))
    for r in out.toLocalIterator():
        print("\t".join("NaN" if v is None else v for v in r))


def call(a, spark) -> None:
    sam = a.alignments.endswith(".sam")
    if not sam and not a.alignments.endswith(".bam"):
        raise ValueError("SAM or BAM is needed; convert CRAM first")
    if (a.region is None) == (a.region_file is None):
        raise ValueError("either a region or a region file is needed")
    reads = alignments.read_sam(spark, a.alignments) if sam else alignments.read_bam(spark, a.alignments)
    loci = tables.read_bed(spark, a.region_file) if a.region_file else tables.region_frame(spark, a.region, empty=True).withColumnRenamed("interval_ord", "ord")
    contigs = alignments.sam_contigs(spark, a.alignments) if sam else alignments.bam_contigs(spark, a.alignments)
    loci = intervals.validate(loci, contigs).select("ord", "chrom", "begin", "end")
    found = genotype.genotypes(reads, loci, a.minlen, a.support, a.unphased)
    name = a.sample_name or alignments.sample_name(a.alignments)
    _print(found.orderBy(natural_key(F.col("chrom")), "locus_begin", "locus_end").select(*tables.KEY, "h1", "h2"), ["chromosome", "begin", "end", f"{name}_H1", f"{name}_H2"])


def combine(a, spark) -> None:
    read = [tables.read_cells(spark, p) for p in a.calls]
    frames = [f for f, _ in read]
    if a.positional:
        frames = [cohort.numbered(f.withColumnRenamed("ord", "line"), "line").drop("line") for f in frames]
        out = cohort.combine_positional(frames)
    else:
        out = cohort.combine_keyed(frames)
    _print(out.orderBy("ord").select(*tables.KEY, F.array_join("cells", "\t").alias("cells")), ["chromosome", "begin", "end", *(n for _, names in read for n in names)])


def _regions(a, spark) -> DataFrame:
    """A list's regions where the argument is a file, else the region that it says."""
    return tables.read_regions(spark, a.region) if a.region_list or tables.exists(spark, a.region) else tables.region_frame(spark, a.region)


def query(a, spark) -> None:
    m = tables.read_matrix(spark, a.combined)
    regions = _regions(a, spark)
    n = lookup.matches(m.rows, regions).limit(2).count()  # none, one or more
    if n == 0:
        log.warning("no match")
    elif n == 1:
        _print(lookup.sorted_lengths(m.rows, m.header, regions).orderBy("rank").select("column", "length"), ["sample", "length"])
    else:
        wide = lookup.side_by_side(m.rows, m.header, regions).orderBy("col_idx")
        top = wide.first().matches
        _print(wide.select("column", F.array_join(F.transform("lengths", shown), "\t").alias("x")), ["sample", *top])


def outlier(a, spark) -> None:
    if a.sample and a.samples:
        raise ValueError("a sample or a list of samples, not both")
    subset = [a.sample] if a.sample else tables.read_names(spark, a.samples) if a.samples else None
    m = tables.read_matrix(spark, a.combined)
    found = outliers.outliers(m.rows, m.header, a.minsize, a.zscore, a.method, subset)
    _print(found.orderBy("ord").select(*tables.KEY, F.array_join("outliers", ",").alias("outliers")), ["chrom", "begin", "end", "outliers"])


def _one(a, spark):
    r = tables.region_frame(spark, a.region).first()
    return tables.read_matrix(spark, a.combined, r.chrom), (r.chrom, r.begin, r.end)


def histogram(a, spark) -> None:
    m, place = _one(a, spark)
    _print(lookup.locus_histogram(m.rows, m.header, *place).orderBy("bucket"), ["bucket", "from", "to", "n"])


def plot(a, spark) -> None:
    m, place = _one(a, spark)
    column, values = tables.parse_condition(a.condition)
    meta = tables.read_metadata(spark, a.metadata, column)
    counts = lookup.group_histogram(m.rows, m.header, meta, column, values, *place, names=True)
    if a.output:
        charts.grouped_bars(counts, a.output, a.region)
    _print(counts.drop("names").orderBy("group", "bucket"), ["group", "bucket", "from", "to", "n"])


def associate(a, spark) -> None:
    if sum(x is not None for x in (a.chrom, a.region, a.bed, a.variant)) > 1:
        raise ValueError("one of a contig, a region, a BED file and a variant")
    if a.variant and not re.fullmatch(r"[^_:-]+[_:-]\d+[_:-]\d+", a.variant):
        raise ValueError(f"not a variant: {a.variant}")
    m = tables.read_matrix(spark, a.combined, a.chrom)
    rows = m.rows
    if a.region:
        r = tables.region_frame(spark, a.region).first()
        rows = rows.where((F.col("chrom") == r.chrom) & intervals.contains(F.lit(r.begin), F.lit(r.end), F.col("locus_begin"), F.col("locus_end")))
    if a.variant:
        chrom, begin, end = re.split("[_:-]", a.variant)
        rows = rows.where((F.col("chrom") == chrom) & (F.col("locus_begin") == int(begin)) & (F.col("locus_end") == int(end)))
    if a.bed:
        bed = tables.read_bed(spark, a.bed).select(F.col("chrom").alias("r_chrom"), F.col("begin").alias("r_begin"), F.col("end").alias("r_end"))
        rows = intervals.overlap_semi(rows.withColumn("begin", F.col("locus_begin")).withColumn("end", F.col("locus_end")), bed)
    phenotypes = association.last_rows(tables.read_metadata(spark, a.phenotypes, a.phenotype, tables.delimiter(spark, a.phenotypes)))
    covariates = [x for x in re.split("[, ]+", a.covariates) if x] if a.covariates else []
    order = [x for x in re.split(",| " if a.expanded is not None else ",", a.binary_order) if x] if a.binary_order else None
    if order:
        association.check_groups(phenotypes, a.phenotype, order)
    found = matrix_association.associate_matrix(rows.select("ord", *tables.KEY, "lengths"), m.header, phenotypes, a.phenotype, order, covariates, a.mode, a.missing_cutoff, a.expanded)
    lengths = association.str_mode(F.col("h1"), F.col("h2"), a.mode)
    c = cohort.pairs(rows.select("ord", *tables.KEY, "lengths"), m.header).select("ord", *tables.KEY, "sample", lengths.alias("length"))
    known = phenotypes.select("sample", F.col(f"`{a.phenotype}`").alias("__y"), *(F.col(f"`{x}`").try_cast("double").alias(f"__{x}") for x in covariates))
    c = association.with_phenotype(c, known)
    if order:
        c = association.two_groups(c, "__y", order)
    if covariates:  # sizes are of complete cases then
        c = c.dropna(subset=["__y", *(f"__{x}" for x in covariates)])
    if a.expanded is not None:
        c = c.withColumn("label", (F.col("length") >= a.expanded).cast("double"))
    elif not order:
        c = c.withColumn("label", F.lit(0.0))
    groups = ["notExpanded", "Expanded"] if a.expanded is not None else order
    sizes = ["n0", "avg0", "min0", "max0", "n1", "avg1", "min1", "max1", "abs_diff"] if groups else []
    about = association.summary(c).select("ord", "avg_size", "min_size", "max_size", "size_range", *sizes)
    out = association.by_pvalue(association.scaled_effects(found.join(about, "ord"), bool(order)))
    scaled = ["effect_for_abs_diff"] * bool(groups) + ["effect_for_range"] * (not order)
    cols = ["n", "beta", "se", "effect", "ci_low", "ci_high", "pvalue", "avg_size", "min_size", "max_size", "size_range", *sizes, *scaled]
    named = [f"{x.rstrip('01')}_{groups[int(x[-1])]}" if x[-1] in "01" else x for x in cols]
    tested = F.lit("expanded_allele_group") if a.expanded is not None else association.variant_id()
    model = F.concat(F.lit(f"{a.phenotype}~"), tested, F.lit("".join(f"+{x}" for x in covariates))).alias("model")
    told = [model, *([F.lit(a.binary_order).alias("binary_order")] if order else [])]
    _print(out.select(association.variant_id(a.expanded is not None), *cols, *told), ["variant", *named, "model", *(["binary_order"] if order else [])])


def count(a, spark) -> None:
    groups = tables.read_metadata(spark, a.groups, "group") if a.groups else None
    n = outliers.count_outliers(tables.read_outliers(spark, a.outliers), groups)
    if a.output:
        charts.spread_page(n if a.groups else n.withColumn("group", F.lit("all")), a.output)
    _print(n.orderBy(F.desc("n"), "first_ord", "first_place").drop("first_ord", "first_place"), ["sample", "count", *(["group"] if groups else [])])


def hits(a, spark) -> None:
    found = outliers.multiple_hits(tables.read_outliers(spark, a.outliers), tables.read_names(spark, a.samples), a.min_hits, a.max_others)
    _print(found.orderBy("ord").select(*tables.KEY, F.array_join("outliers", ",").alias("outliers"), "hits"), ["chrom", "begin", "end", "outliers", "hits"])


def scan(a, spark) -> None:
    raise NotImplementedError("searching for polymorphic repeats isn't offered")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tandemlake", description=__doc__)
    p.add_argument("-q", "--quiet", action="store_true", help="no messages but warnings")
    s = p.add_subparsers(dest="command", required=True)

    def add(name, run, *args):
        one = s.add_parser(name)
        one.set_defaults(run=run)
        for flags, more in args:
            one.add_argument(*flags, **more)

    o = lambda *f, **k: (f, k)
    add("call", call, o("alignments"), o("-r", "--region"), o("-R", "--region-file"), o("-m", "--minlen", type=int, default=5), o("-s", "--support", type=int, default=3), o("-u", "--unphased", action="store_true"), o("--sample-name"))
    add("combine", combine, o("calls", nargs="+"), o("--positional", action="store_true"))
    add("query", query, o("combined"), o("region"), o("--region-list", action="store_true"))
    add("outlier", outlier, o("combined"), o("--minsize", type=float, default=10), o("-z", "--zscore", type=float, default=3.0), o("--method", choices=("zscore", "dbscan"), default="zscore"), o("-s", "--sample"), o("-S", "--samples"))
    add("histogram", histogram, o("combined"), o("region"))
    add("plot", plot, o("combined"), o("metadata"), o("region"), o("-c", "--condition", required=True), o("-o", "--output"))
    add("associate", associate, o("combined"), o("phenotypes"), o("phenotype"), o("--mode", choices=("MEAN", "MAX", "MIN", "SUM"), default="MAX"), o("--binary-order"), o("--covariates"), o("--missing-cutoff", type=float, default=0.8), o("--expanded", type=float), o("--chrom"), o("--region"), o("--bed"), o("--variant"))
    add("count-outliers", count, o("outliers"), o("--groups"), o("-o", "--output"))
    add("scan", scan, o("alignments", nargs="?"))
    add("multiple-hits", hits, o("outliers"), o("-s", "--samples", required=True), o("-m", "--min-hits", type=int, default=2), o("--max-others", type=int))
    return p


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    logging.basicConfig(format="%(asctime)s %(message)s")  # to the error stream, beside the rows
    log.setLevel(logging.WARNING if a.quiet else logging.INFO)
    log.info("%s starts", a.command)
    a.run(a, session())
    log.info("%s is done", a.command)


if __name__ == "__main__":
    main()
