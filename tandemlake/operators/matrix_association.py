"""Association on the matrix' rows: many loci a step, no shuffle.

Phenotypes are a row a sample of the header, which the driver holds already; they
go to the tasks as short vectors. Each task takes a few hundred loci at a time
and fits all their models together in numpy. Same results as the long form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tandemlake.functions import stats
from tandemlake.operators.association import MODEL

TOGETHER = 256


def _modes(both: np.ndarray, mode: str) -> np.ndarray:
    """(loci, samples) of (loci, samples, 2); a missing haplotype leaves the other, but for SUM."""
    a, b = both[..., 0], both[..., 1]
    if mode == "SUM":
        return a + b
    high, low = np.fmax(a, b), np.fmin(a, b)
    return {"MAX": high, "MIN": low, "MEAN": (high + low) / 2}[mode]


def _good(length: np.ndarray, cutoff: float, differ: bool = True) -> np.ndarray:
    """Loci with enough lengths, and different ones if differ."""
    here = ~np.isnan(length)
    called = here.sum(axis=1)
    high, low = np.where(here, length, -np.inf).max(axis=1, initial=-np.inf), np.where(here, length, np.inf).min(axis=1, initial=np.inf)
    return (called > 0) & (called >= cutoff * length.shape[1]) & ((high > low) | (not differ))


def _solvable(h: np.ndarray) -> np.ndarray:
    scale = np.sqrt(np.maximum(np.einsum("bkk->bk", h), 1e-300))
    return np.linalg.eigvalsh(h / scale[:, :, None] / scale[:, None, :])[:, 0] > 1e-9


def _about_means(x: np.ndarray, here: np.ndarray) -> np.ndarray:
    """x with all columns but the first as distances from a locus' mean, 0 for one that is constant: slopes stay as they are."""
    own, at = x[..., 1:], here[..., None]
    high, low = np.where(at, own, -np.inf).max(axis=1, initial=-np.inf, keepdims=True), np.where(at, own, np.inf).min(axis=1, initial=np.inf, keepdims=True)
    mean = own.sum(axis=1, keepdims=True, where=at) / np.maximum(here.sum(axis=1), 1)[:, None, None]
    return np.concatenate([x[..., :1], np.where(at & (high > low), own - mean, 0)], axis=2)


def fit_batch(x: np.ndarray, y: np.ndarray, here: np.ndarray, family: str) -> tuple[np.ndarray, np.ndarray]:
    """(estimates, standard errors) of the second column: x (loci, samples, k), ones first, y (samples), here (loci, samples); NaN where none exists.

    A linear estimate without spare samples has no standard error; one that fits exactly has 0.
    """
    m, _, k = x.shape
    w8 = here.astype(float)
    x = np.where(here[..., None], x, 0)
    if family == "gaussian":
        x = _about_means(x, here)
    rank = _solvable(np.einsum("bsk,bs,bsl->bkl", x, w8, x)) & (here.sum(axis=1) >= k)
    eye = np.eye(k)
    if family == "gaussian":
        h = np.where(rank[:, None, None], np.einsum("bsk,bs,bsl->bkl", x, w8, x), eye)
        w = np.linalg.solve(h, np.einsum("bsk,bs,s->bk", x, w8, y)[..., None])[..., 0]
        spare = here.sum(axis=1) - k
        rest = ((y[None, :] - np.einsum("bsk,bk->bs", x, w)) ** 2 * w8).sum(axis=1)
        se = np.sqrt(rest / np.maximum(spare, 1) * np.linalg.inv(h)[:, 1, 1])
        return np.where(rank, w[:, 1], np.nan), np.where(rank & (spare > 0), se, np.nan)
    w, last, live = np.zeros((m, k)), np.full(m, np.inf), rank.copy()
    for _ in range(25):
        own = np.flatnonzero(live)
        if not len(own):
            break
        xo, ho = x[own], here[own]
        eta = np.einsum("bsk,bk->bs", xo, w[own])
        p = 1 / (1 + np.exp(-np.clip(eta, -30, 30)))
        v = np.where(ho, np.maximum(p * (1 - p), 1e-12), 0)
        h = np.einsum("bsk,bs,bsl->bkl", xo, v, xo)
        ok = _solvable(h)
        rank[own[~ok]] = live[own[~ok]] = False
        h = np.where(ok[:, None, None], h, eye)
        w[own] = np.linalg.solve(h, np.einsum("bsk,bs->bk", xo, v * eta + (y[None, :] - p) * ho)[..., None])[..., 0]
        p = 1 / (1 + np.exp(-np.clip(np.einsum("bsk,bk->bs", xo, w[own]), -30, 30)))
        dev = -2 * np.where(ho, np.log(np.clip(np.where(y[None, :] == 1, p, 1 - p), 1e-300, 1)), 0).sum(axis=1)
        live[own[np.abs(dev - last[own]) < 1e-10 * (np.abs(dev) + 0.1)]] = False
        last[own] = dev
    p = 1 / (1 + np.exp(-np.clip(np.einsum("bsk,bk->bs", x, w), -30, 30)))
    v = np.where(here, p * (1 - p), 0)
    h = np.einsum("bsk,bs,bsl->bkl", x, v, x)
    good = rank & (last > 1e-6) & (v.max(axis=1, initial=0) > 1e-8)
    good[good] = _solvable(h[good])
    h = np.where(good[:, None, None], h, eye)
    se = np.sqrt(np.linalg.inv(h)[:, 1, 1])
    return np.where(good, w[:, 1], np.nan), np.where(good, se, np.nan)


def associate_matrix(matrix: DataFrame, header: list[str], phenotypes: DataFrame, outcome: str, order: list[str] | None = None, covariates: list[str] = (), mode: str = "MAX", missing_cutoff: float = 0.80, expanded: float | None = None, every: bool = False) -> DataFrame:
    """MODEL of every locus that passes the quality filters, over all samples and again over those of the two groups.

    order: the two groups (first is 0) for a logistic model; without it the
    outcome is a number and the model linear. Samples are the header's; those
    without a phenotype, a covariate or a length are left out of a locus' model.
    every: loci whose lengths don't differ stay in, without estimates, and a linear
    estimate stands without a standard error over 0; a locus that no sample is left
    of has no row.
    """
    samples = [header[i].removesuffix("_H1") for i in range(0, len(header), 2)]
    said = F.col(f"`{outcome}`") if order is not None else F.col(f"`{outcome}`").try_cast("double")
    wanted = phenotypes.where(F.col("sample").isin(samples)).select("sample", said.alias("__y"), *(F.col(f"`{c}`").try_cast("double").alias(f"__{c}") for c in covariates))
    known = {r["sample"]: r for r in wanted.collect()}  # a row a sample of the header
    own = [known.get(s) for s in samples]
    number = lambda v: np.nan if v is None else float(v)
    if order is not None:
        y = np.array([np.nan if r is None or r["__y"] not in order else float(order.index(r["__y"])) for r in own])
    else:
        y = np.array([np.nan if r is None else number(r["__y"]) for r in own])
    z = np.array([[np.nan if r is None else number(r[f"__{c}"]) for c in covariates] for r in own]).reshape(len(samples), len(covariates))
    usable, grouped = ~np.isnan(y) & ~np.isnan(z).any(axis=1), ~np.isnan(y)
    family = "gaussian" if order is None else "binomial"
    names = [c.split()[0] for c in MODEL.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), TOGETHER):
                part = batch.slice(i, TOGETHER)
                flat = part.column("lengths").flatten().to_numpy(zero_copy_only=False).astype(float)
                length = _modes(flat.reshape(len(part), len(samples), 2), mode)
                good = _good(length, missing_cutoff, not every)
                if order is not None:
                    good &= _good(length[:, grouped], missing_cutoff, not every)
                if every:
                    good &= ~np.isnan(length[:, usable]).all(axis=1)
                part, length = part.filter(pa.array(good)), length[good][:, usable]
                if not len(part):
                    continue
                here = ~np.isnan(length)
                value = length if expanded is None else np.where(here, (length >= expanded).astype(float), np.nan)
                x = np.concatenate([np.ones((*value.shape, 1)), value[..., None], np.broadcast_to(z[usable], (len(value), *z[usable].shape))], axis=2)
                beta, se = fit_batch(x, y[usable], here, family)
                if not every:
                    beta, se = np.where(se > 0, beta, np.nan), np.where(se > 0, se, np.nan)
                n = here.sum(axis=1)
                with np.errstate(over="ignore", invalid="ignore", divide="ignore"):
                    low, high, t = beta - stats.Z975 * se, beta + stats.Z975 * se, beta / se
                    effects = [np.exp(np.minimum(v, 700)) for v in (beta, low, high)]
                p = [np.nan if np.isnan(v) else stats.normal_p(v) if family == "binomial" else stats.student_p(v, m - x.shape[2]) for v, m in zip(t, n)]
                cols = [pa.array(v, from_pandas=True) for v in (beta, se, *effects, np.array(p))]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names[:4]), pa.array(n.astype(np.int64)), *cols], names)

    return matrix.select("ord", "chrom", "locus_begin", "locus_end", "lengths").mapInArrow(run, MODEL)
