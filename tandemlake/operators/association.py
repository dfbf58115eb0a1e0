"""Association of repeat lengths with phenotypes, locus by locus.

Calls are one row a locus and sample. Summaries, quality filters and all models
that have a closed form are aggregates; models with covariates are fitted in
Python, a locus at a time, in as many tasks as there are loci.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType

from tandemlake.functions import stats

LOCUS = ("ord", "chrom", "locus_begin", "locus_end")


def str_mode(h1: Column, h2: Column, mode: str) -> Column:
    """One length of two haplotypes; a missing one leaves the other."""
    high, low = F.greatest(h1, h2), F.least(h1, h2)
    try:
        return {"MAX": high, "MIN": low, "MEAN": (high + low) / 2, "SUM": h1 + h2}[mode]
    except KeyError:
        raise ValueError(f"unknown mode: {mode}") from None


def variant_id(expanded: bool = False) -> Column:
    return F.concat(F.col("chrom"), F.lit(":"), F.col("locus_begin").cast("string"), F.lit("_"), F.col("locus_end").cast("string"), F.lit("_ExpandedAllele" if expanded else ""))


def last_rows(phenotypes: DataFrame) -> DataFrame:
    """One row a sample: of rows with one sample the last (by ord) counts."""
    rest = [F.col(f"`{c}`") for c in phenotypes.columns if c != "sample"]
    return phenotypes.groupBy("sample").agg(F.max_by(F.struct(*rest), "ord").alias("__row")).select("sample", "__row.*")


def scaled_effects(results: DataFrame, odds: bool) -> DataFrame:
    """Models joined with their summary, with the effect over the means' distance and, of numbers, over the range of sizes.

    An odds ratio is raised to the distance, any other effect multiplied by it; both from figures as rounded.
    """
    effect = F.round("effect", 3)
    if "abs_diff" in results.columns:
        results = results.withColumn("effect_for_abs_diff", F.round(F.pow(effect, F.col("abs_diff")) if odds else effect * F.col("abs_diff"), 3))
    return results if odds else results.withColumn("effect_for_range", F.round(effect * F.col("size_range"), 3))


def with_phenotype(calls: DataFrame, phenotypes: DataFrame) -> DataFrame:
    """All calls with what is known of their sample."""
    return calls.join(phenotypes, "sample", "left")


def two_groups(calls: DataFrame, column: str, order: list[str]) -> DataFrame:
    """Calls of samples in either group, with label 0 for the first, 1 for the second."""
    if len(order) != 2:
        raise ValueError("two groups are needed")
    return calls.where(F.col(column).isin(order)).withColumn("label", (F.col(column) == order[1]).cast("double"))


def check_groups(phenotypes: DataFrame, column: str, order: list[str]) -> None:
    """An error unless there are two groups and some sample is in either."""
    if len(order) != 2:
        raise ValueError("two groups are needed")
    held = phenotypes.agg(*(F.count_if(F.col(f"`{column}`") == v).alias(f"n{k}") for k, v in enumerate(order))).first()
    for v, n in zip(order, held):
        if not n:
            raise ValueError(f"no sample of group {v} in {column}")


def qualified(calls: DataFrame, missing_cutoff: float = 0.80) -> DataFrame:
    """(locus, samples, called, different) of loci with enough calls that differ."""
    q = calls.groupBy(*LOCUS).agg(F.count("*").alias("samples"), F.count("length").alias("called"), F.countDistinct("length").alias("different"))
    return q.where((F.col("called") > 0) & (F.col("called") / F.col("samples") >= missing_cutoff) & (F.col("different") > 1))


def keep_qualified(calls: DataFrame, missing_cutoff: float = 0.80) -> DataFrame:
    return calls.join(qualified(calls, missing_cutoff).select("ord"), "ord", "left_semi")


def summary(calls: DataFrame) -> DataFrame:
    """Per locus: group sizes, mean, least and largest length of either group, and the means' distance, as rounded."""
    of = lambda f, k: F.round(f(F.when(F.col("label") == k, F.col("length"))), 3)
    n = lambda k: F.count(F.when((F.col("label") == k) & F.col("length").isNotNull(), 1))
    s = calls.groupBy(*LOCUS).agg(*(x.alias(f"{name}{k}") for k in (0, 1) for name, x in (("n", n(k)), ("avg", of(F.avg, k)), ("min", of(F.min, k)), ("max", of(F.max, k)))), F.round(F.avg("length"), 3).alias("avg_size"), F.round(F.min("length"), 3).alias("min_size"), F.round(F.max("length"), 3).alias("max_size"), F.round(F.max("length") - F.min("length"), 3).alias("size_range"))
    return s.withColumn("abs_diff", F.round(F.abs(F.col("avg0") - F.col("avg1")), 3))


def expanded_odds(calls: DataFrame, cutoff: float) -> DataFrame:
    """Per locus the logistic model of label by length >= cutoff, from its four counts: (cells, beta, se, odds_ratio, ci_low, ci_high, pvalue).

    With an empty cell no finite estimate exists: null.
    """
    big = F.col("length") >= cutoff
    cell = lambda b, y: F.count(F.when((big == b) & (F.col("label") == y), 1)).cast("double")
    c = calls.where("length is not null").groupBy(*LOCUS).agg(cell(True, 1).alias("a"), cell(True, 0).alias("b"), cell(False, 1).alias("c"), cell(False, 0).alias("d"))
    full = (F.col("a") > 0) & (F.col("b") > 0) & (F.col("c") > 0) & (F.col("d") > 0)
    beta = F.when(full, F.ln((F.col("a") * F.col("d")) / (F.col("b") * F.col("c"))))
    se = F.when(full, F.sqrt(1 / F.col("a") + 1 / F.col("b") + 1 / F.col("c") + 1 / F.col("d")))
    c = c.withColumn("beta", beta).withColumn("se", se).withColumn("odds_ratio", F.exp("beta"))
    return c.withColumn("ci_low", F.exp(F.col("beta") - stats.Z975 * F.col("se"))).withColumn("ci_high", F.exp(F.col("beta") + stats.Z975 * F.col("se")))


@F.pandas_udf(DoubleType())
def normal_pvalue(z: pd.Series) -> pd.Series:
    return z.map(lambda x: None if pd.isna(x) else stats.normal_p(x))


@F.pandas_udf(DoubleType())
def student_pvalue(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([None if pd.isna(a) or pd.isna(b) or b < 1 else stats.student_p(a, b) for a, b in zip(t, df)], dtype="float64")


def linear(calls: DataFrame, outcome: str, predictor: str = "length") -> DataFrame:
    """Per locus the least-squares model of outcome by predictor: (n, slope, se, exp_beta, ci_low, ci_high, t); pvalue by student_pvalue(t, n - 2).

    exp_beta and its interval are the exponentials of slope and of its normal interval.
    """
    y, x = F.col(outcome), F.col(predictor)
    s = calls.where(x.isNotNull() & y.isNotNull()).groupBy(*LOCUS).agg(F.count("*").alias("n"), F.regr_slope(y, x).alias("slope"), F.regr_r2(y, x).alias("r2"), F.regr_sxx(y, x).alias("sxx"), F.regr_syy(y, x).alias("syy"))
    se = F.sqrt(F.greatest((1 - F.col("r2")) * F.col("syy"), F.lit(0.0)) / F.nullif(F.col("sxx"), F.lit(0.0)) / F.nullif(F.greatest(F.col("n") - 2, F.lit(0)), F.lit(0)))
    s = s.withColumn("se", se).withColumn("exp_beta", F.exp("slope")).withColumn("t", F.col("slope") / F.nullif(F.col("se"), F.lit(0.0)))
    return s.withColumn("ci_low", F.exp(F.col("slope") - stats.Z975 * F.col("se"))).withColumn("ci_high", F.exp(F.col("slope") + stats.Z975 * F.col("se"))).drop("r2", "sxx", "syy")


MODEL = "ord long, chrom string, locus_begin long, locus_end long, n long, beta double, se double, effect double, ci_low double, ci_high double, pvalue double"


def fitted(calls: DataFrame, outcome: str, covariates: list[str] = (), family: str = "binomial", predictor: str = "length") -> DataFrame:
    """Per locus the model of outcome by predictor and covariates: MODEL, with the predictor's row.

    Samples that lack any of them are left out. effect is exp(beta): an odds
    ratio for binomial. Separation, too few rows or a lack of rank: nulls.
    """
    used = [predictor, *covariates]
    rows = calls.select(*LOCUS, F.col(outcome).cast("double").alias("__y"), *(F.col(c).cast("double").alias(f"__{c}") for c in used)).dropna()

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.column_stack([np.ones(len(pdf)), *(pdf[f"__{c}"].to_numpy() for c in used)])
        y = pdf["__y"].to_numpy()
        got = stats.logistic_fit(x, y) if family == "binomial" else stats.linear_fit(x, y)
        head = [pdf[c].iloc[0] for c in LOCUS] + [len(pdf)]
        if got is None or not got[1] > 0:
            return pd.DataFrame([[*head, *[None] * 6]], columns=[c.split()[0] for c in MODEL.split(", ")])
        beta, se = got
        p = stats.normal_p(beta / se) if family == "binomial" else stats.student_p(beta / se, len(pdf) - x.shape[1])
        out = [beta, se, *(math.exp(min(v, 700)) for v in (beta, beta - stats.Z975 * se, beta + stats.Z975 * se)), p]
        return pd.DataFrame([[*head, *out]], columns=[c.split()[0] for c in MODEL.split(", ")])

    return rows.groupBy(*LOCUS).applyInPandas(fit, MODEL)


def by_pvalue(results: DataFrame) -> DataFrame:
    return results.orderBy(F.col("pvalue").asc_nulls_last(), "chrom", "locus_begin", "locus_end")
