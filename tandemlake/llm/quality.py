"""Quality: a chain over lines labels each good or bad; marginals make document quality.

A line's evidence is what it looks like (length, shares of letters, capitals,
digits and marks, word lengths, repeats) and what its neighbours look like; the
chain adds how labels follow each other. Every line of a training document has
its document's label. A document's quality is the mean marginal of its lines,
weighted by their length, put to scale on the training sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textvec as tv
from .crf import Chain, fit, logistic, marginals, sigmoid
from .labelled import held_out, sample

PER_CLASS = 4000
_CLASS = np.zeros((256, 6), bool)
_CLASS[97:123, 0] = True
_CLASS[65:91, 1] = True
_CLASS[48:58, 2] = True
_CLASS[128:, 3] = True
_CLASS[[33, 35, 36, 37, 38, 42, 43, 60, 61, 62, 64, 94, 95, 124, 126], 4] = True
_CLASS[[34, 39, 40, 41, 44, 45, 46, 47, 58, 59, 63, 91, 92, 93, 123, 125], 5] = True


@dataclass
class Model:
    mean: np.ndarray
    spread: np.ndarray
    chain: Chain
    document: np.ndarray


def _looks(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What lines look like, each row's first line, and line lengths in bytes."""
    start, end, first = tv.lines(data, bounds)
    size = (end - start).astype(float)
    share = []
    for k in range(_CLASS.shape[1]):
        n = np.r_[0, np.cumsum(_CLASS[data, k])]
        share.append((n[end] - n[start]) / np.maximum(size, 1))
    ws, we, _ = tv.words(data, bounds)
    at = np.append(np.searchsorted(ws, start), len(ws))
    n = np.diff(at).astype(float)
    length = (we - ws).astype(float)
    total, square = tv.row_sum(length, at), tv.row_sum(length**2, at)
    mean = total / np.maximum(n, 1)
    spread = np.sqrt(np.maximum(square / np.maximum(n, 1) - mean**2, 0))
    same = np.zeros(len(ws))
    if len(ws) > 1:
        h = tv.span_hash(data, ws, we)
        same[1:] = h[1:] == h[:-1]
    # words seen before in the same row
    order = np.lexsort((np.arange(len(ws)), h)) if len(ws) > 1 else np.zeros(0, np.int64)
    again = np.zeros(len(ws))
    row_of_word = np.searchsorted(bounds, ws, "right")
    if len(ws) > 1:
        a, b = order[:-1], order[1:]
        again[b] = (h[a] == h[b]) & (row_of_word[a] == row_of_word[b])
    marked = np.zeros(len(ws))
    if len(ws):
        marked = (_CLASS[data[we - 1], 4]).astype(float)
    word_share = [tv.row_sum(x, at) / np.maximum(n, 1) for x in (same, again, marked)]
    lines_in_row = np.repeat(np.diff(first), np.diff(first))
    own = np.column_stack([np.log1p(size), *share, np.log1p(n), mean, spread, *word_share, n == 0, n <= 2, share[1] > 0.5, share[4] > 0.1, word_share[0] > 0.3, word_share[1] > 0.6, np.log(lines_in_row)])
    return own.astype(np.float64), first, size


def _features(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Each line's looks and squares, its neighbours' looks (its own at a row's ends), and a constant."""
    place = np.arange(len(own))
    head, tail = np.zeros(len(own), bool), np.zeros(len(own), bool)
    head[first[:-1]], tail[first[1:] - 1] = True, True
    return np.column_stack([own, own**2, own[np.where(head, place, place - 1)], own[np.where(tail, place, place + 1)], np.ones(len(own))])


def _scaled(model_mean, model_spread, feature):
    return np.clip((feature - model_mean) / model_spread, -6, 6)


def _of_documents(p: np.ndarray, size: np.ndarray, first: np.ndarray) -> np.ndarray:
    weight = size + 1
    mean = tv.row_sum(p * weight, first) / tv.row_sum(weight, first)
    logit = np.log(np.clip(p, 1e-6, 1 - 1e-6) / np.clip(1 - p, 1e-6, 1))
    least = np.minimum.reduceat(p, first[:-1])
    return np.column_stack([mean, tv.row_sum(logit * weight, first) / tv.row_sum(weight, first), least, np.log(tv.row_sum(weight, first))])


def _halves(label: np.ndarray) -> np.ndarray:
    """Every other document of either label, in drawn order: both halves hold a label that two documents have."""
    drawn = np.random.default_rng(1).permutation(len(label))
    half = np.zeros(len(label), bool)
    for k in (0, 1):
        half[drawn[label[drawn] == k][k::2]] = True
    if not half.any():
        half[:] = True
    return half


def train(table: pa.Table) -> Model:
    """From (text, label). Halves of the sample teach the chain and the document scale.

    Without documents all scores are 0.5; where a half would lack a label all
    documents teach both; where only one label occurs all scores are the same and
    lean to it. Scores are in 0 to 1 always.
    """
    label = table.column("label").to_numpy().astype(np.int64)
    own, size, many = [], [], []
    for _, _, data, bounds in tv.steps(table.column("text")):
        f, first, s = _looks(data, bounds)
        own.append(_features(f, first))
        size.append(s)
        many.append(np.diff(first))
    if not own:
        return Model(np.zeros(1), np.ones(1), Chain(np.zeros(1), np.zeros(4)), np.zeros(5))
    feature, size, many = np.concatenate(own), np.concatenate(size), np.concatenate(many)
    mean, spread = feature.mean(axis=0), feature.std(axis=0) + 1e-6
    mean[-1], spread[-1] = 0, 1
    feature = _scaled(mean, spread, feature)
    half = _halves(label)
    other = ~half if len(np.unique(label[~half])) > 1 else np.ones(len(label), bool)  # too few for halves: all teach both
    of_line, of_other = np.repeat(half, many), np.repeat(other, many)
    part = lambda h: np.r_[0, np.cumsum(many[h])]
    chain = fit(feature[of_line], np.repeat(label[half], many[half]), part(half))
    first = part(other)
    columns = _of_documents(marginals(feature[of_other], first, chain), size[of_other], first)
    if len(np.unique(label)) == 1:  # nothing to tell apart
        n1 = label.sum()
        return Model(mean, spread, chain, np.r_[np.zeros(columns.shape[1]), np.log((n1 + 0.5) / (len(label) - n1 + 0.5))])
    return Model(mean, spread, chain, logistic(columns, label[other].astype(float)))


def _score(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        for batch in batches:
            for i, j, data, bounds in tv.steps(batch.column("text")):
                own, first, size = _looks(data, bounds)
                if len(model.mean) == 1:
                    score = np.full(j - i, 0.5)
                else:
                    p = marginals(_scaled(model.mean, model.spread, _features(own, first)), first, model.chain)
                    score = sigmoid(_of_documents(p, size, first), model.document)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(batch.num_columns)), pa.array(score), pa.array(np.diff(first))], [*batch.schema.names, "score", "n_lines"])

    return run


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (all its columns, `text` among them) with `score` and `n_lines`; columns so named give way.

    A null or empty text is one empty line. Each row alone decides its score, so
    repeated rows get the same.
    """
    kept = docs.drop("score", "n_lines")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), f"{fields}, score double, n_lines long")


def quality(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted, n_lines) of every row of docs, learnt from labels.quality.

    Null labels and labels of the held-out fold aren't learnt from; an id labelled
    twice counts by its largest label; a null id is never held out. Null and empty
    texts are scored as one empty line, repeated rows alike; columns beside doc_id
    and text aren't read. An empty table gives an empty one.
    """
    model = train(sample(docs, labels, "quality", per_class)[0])
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "n_lines")
