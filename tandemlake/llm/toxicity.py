"""Toxicity: a chain over words tags toxic spans; marginals make document scores.

Labels are of documents. A word's evidence is how much more often labelled-toxic
documents hold it, or words with its first bytes, than others do; words of toxic
documents whose evidence is high are the labelled tokens that the chain is
trained on. Evidence comes from one half of the sample, chain and document model
from the other, so a word can't vouch for itself. The model is a few fixed-size
tables, whatever the corpus' size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textvec as tv
from .crf import Chain, fit_blocks, logistic, marginals, sigmoid
from .labelled import held_out, sample

CELLS = 1 << 17
#: Byte lengths of word beginnings that count beside the word itself.
STEMS = (4, 5)
#: Evidence (log odds) from which a word of a toxic document is labelled toxic.
LABELLED = 1.0
#: Labelled documents learnt from, of either label; words of one stretch that the chain is trained on.
PER_CLASS, STRETCH = 2000, 256
#: Words that the chain's training holds at once: a multiple of STRETCH; it goes through all words of the sample.
CHAIN_BLOCK = 1 << 18
#: All words of a document together weigh as so many at most in the chain's training.
HEAVIEST = 2048
#: How far scores follow the labels' ratio among all rows, against that of the sample (0: not, 1: wholly).
PRIOR = 0.5
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = _LETTER[128:] = True


@dataclass
class Model:
    odds: list[np.ndarray]
    chain: Chain
    document: np.ndarray


def _cells(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]]:
    """Letter runs: starts, ends, each row's first, and their cells (whole, and by beginning)."""
    start, end = tv.segments(_LETTER[data], bounds)
    cut = [end, *(np.minimum(end, start + k) for k in STEMS)]
    return start, end, np.searchsorted(start, bounds), [(tv.span_hash(data, start, e) >> np.uint64(64 - 17)).astype(np.int32) for e in cut]


def _features(odds: list[np.ndarray], cells: list[np.ndarray]) -> np.ndarray:
    own = [o[c] for o, c in zip(odds, cells)]
    return np.column_stack([np.ones(len(own[0])), *own, np.maximum.reduce(own) > LABELLED]).astype(np.float64)


def _odds(cells: list, label: np.ndarray) -> list[np.ndarray]:
    """Log odds that a toxic document, against another, holds a word of a cell, less two standard errors."""
    out = []
    for k in range(1 + len(STEMS)):
        n = np.zeros((2, CELLS))
        for c, y in zip(cells, label):
            n[y, np.unique(c[k])] += 1
        total = np.maximum([(label == 0).sum(), (label == 1).sum()], 1)
        log = np.log((n[1] + 0.5) / (total[1] + 1)) - np.log((n[0] + 0.5) / (total[0] + 1))
        doubt = 2 * np.sqrt(1 / (n[1] + 0.5) + 1 / (n[0] + 0.5))
        out.append((np.sign(log) * np.maximum(np.abs(log) - doubt, 0)).astype(np.float32))
    return out


def _of_documents(p: np.ndarray, first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Columns for the document model: the largest marginal, and the sum, each different word once, also by root length."""
    n = np.diff(first)
    likely = np.flatnonzero(p > 0.01)
    row = np.searchsorted(first, likely, "right") - 1
    order = np.lexsort((-p[likely], word[likely], row))
    row, one, q = row[order], word[likely][order], p[likely][order]
    new = np.r_[True, (row[1:] != row[:-1]) | (one[1:] != one[:-1])] if len(row) else np.zeros(0, bool)
    total = np.bincount(row[new], q[new], len(n))
    most = np.zeros(len(n))
    np.maximum.at(most, row, q)
    return np.column_stack([np.log1p(total), most, total / np.sqrt(n + 1.0)])


def train(table: pa.Table, all_of: tuple[int, int] | None = None) -> Model:
    """From (text, label). all_of: how many rows of label 0 and 1 the sample stands for; scores lean to their ratio.

    Without rows of both labels the document model leans to the one it saw.
    """
    label = table.column("label").to_numpy().astype(np.int64)
    per: list[list[np.ndarray]] = []
    for i, j, data, bounds in tv.steps(table.column("text")):
        _, _, first, cells = _cells(data, bounds)
        per += [[c[first[r] : first[r + 1]] for c in cells] for r in range(j - i)]
    half = np.random.default_rng(1).permutation(len(per)) % 2
    odds = [_odds([per[i] for i in np.flatnonzero(half == h)], label[half == h]) for h in (0, 1)]
    order = np.random.default_rng(2).permutation(len(per))  # either half and either label early
    size = np.array([len(per[i][0]) for i in order], np.int64)

    def features(some: np.ndarray) -> np.ndarray:
        return np.concatenate([_features(odds[1 - half[i]], per[i]) for i in some])

    # pieces of whole stretches of every document, a block's worth of words together
    lots, have = [[]], 0
    for i, n in zip(order.tolist(), size.tolist()):
        for a in range(0, n, CHAIN_BLOCK):
            b = min(n, a + CHAIN_BLOCK)
            if have + b - a > CHAIN_BLOCK:
                lots, have = [*lots, []], 0
            lots[-1].append((i, a, b))
            have += b - a

    def blocks():
        for lot in filter(None, lots):
            feature = np.concatenate([_features(odds[1 - half[i]], [c[a:b] for c in per[i]]) for i, a, b in lot])
            many = np.array([b - a for _, a, b in lot])
            end = np.cumsum(many)
            toxic = np.repeat([label[i] == 1 for i, *_ in lot], many)
            first = np.concatenate([[0], *(np.r_[np.arange(e - m + STRETCH, e, STRETCH), e] for e, m in zip(end, many))])
            weight = np.repeat([min(1.0, HEAVIEST / len(per[i][0])) for i, *_ in lot], many)
            yield feature, toxic & (feature[:, -1] > 0), first, weight

    chain = Chain(np.zeros(3 + len(STEMS)), np.zeros(4))
    if size.sum():
        chain = fit_blocks(blocks, 3 + len(STEMS), rounds=60)
    columns = [np.zeros((0, 3))]
    for k in range(0, len(order), 200):
        some = order[k : k + 200]
        first = np.r_[0, np.cumsum(size[k : k + 200])]
        columns.append(_of_documents(marginals(features(some), first, chain), first, np.concatenate([per[i][0] for i in some])))
    document = logistic(np.concatenate(columns), label[order].astype(float)) if len(order) else np.zeros(4)
    n1, n0 = int(label.sum()), int((1 - label).sum())
    if all_of and min(*all_of, n1, n0) > 0:
        document[-1] += PRIOR * (np.log(all_of[1] / all_of[0]) - np.log(n1 / n0))
    return Model(_odds(per, label), chain, document)


def _score(model_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of.value
        for batch in batches:
            for i, j, data, bounds in tv.steps(batch.column("text")):
                start, end, first, cells = _cells(data, bounds)
                p = marginals(_features(model.odds, cells), first, model.chain)
                score = sigmoid(_of_documents(p, first, cells[0]), model.document)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(batch.num_columns)), pa.array(score), pa.array(_spans(data, bounds, start, end, first, p))], [*batch.schema.names, "score", "spans"])

    return run


def _spans(data, bounds, start, end, first, p) -> list[str]:
    """start:end of the words more likely toxic than not, in code points, comma-joined."""
    hit = np.flatnonzero(p > 0.5)
    out = [""] * (len(bounds) - 1)
    if len(hit):
        point = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
        row = np.searchsorted(first, hit, "right") - 1
        base = point[bounds[row]]
        for r, a, b in zip(row.tolist(), (point[start[hit]] - base).tolist(), (point[end[hit]] - base).tolist()):
            out[r] += f"{',' if out[r] else ''}{a}:{b}"
    return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (all its columns, `text` among them) with `score` and `spans`; columns so named give way.

    A null or empty text has no words: its score is what the document model says
    of none. Each row alone decides its score, so repeated rows get the same.
    """
    kept = docs.drop("score", "spans")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return kept.mapInArrow(_score(docs.sparkSession.sparkContext.broadcast(model)), f"{fields}, score double, spans string")


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> DataFrame:
    """(doc_id, held_out, score, predicted, spans) of every row of docs, learnt from labels.toxic.

    Null labels and labels of the held-out fold aren't learnt from; an id labelled
    twice counts by its largest label; a null id is never held out. Null and empty
    texts are scored as having no words, repeated rows alike; without labels all
    score 0.5; columns beside doc_id and text aren't read. An empty table gives an
    empty one.
    """
    model = train(*sample(docs, labels, "toxic", per_class))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
