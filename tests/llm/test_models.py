"""Chains against enumeration, classifiers on their held-out fold, nearest neighbours against all pairs."""

import itertools
import os
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tandemlake.llm import ann, crf, labelled, quality, toxicity

DATA = os.environ.get("TEST_LLM_DIR", "/root/testdata/sf0.01")


def test_marginals_against_enumeration():
    rng = np.random.default_rng(4)
    first = np.array([0, 3, 3, 8, 9])
    feature = rng.normal(size=(9, 2))
    chain = crf.Chain(rng.normal(size=2), rng.normal(size=4))
    got = crf.marginals(feature, first, chain)
    score = feature @ chain.weight
    link = np.array([[0, chain.link[1]], [chain.link[2], chain.link[3]]])
    for a, b in zip(first[:-1], first[1:]):
        total, ones = 0.0, np.zeros(b - a)
        for s in itertools.product((0, 1), repeat=b - a):
            w = np.exp(sum(score[a + k] * v for k, v in enumerate(s)) + (chain.link[0] * s[0] if s else 0) + sum(link[p, q] for p, q in zip(s, s[1:])))
            total, ones = total + w, ones + w * np.array(s)
        assert np.allclose(got[a:b], ones / total)


def test_fit_learns():
    rng = np.random.default_rng(5)
    state = np.repeat(rng.integers(0, 2, 200), 5)
    feature = np.column_stack([state * 2 - 1 + rng.normal(size=1000) * 1.5, np.ones(1000)])
    first = np.arange(0, 1001, 50)
    chain = crf.fit(feature, state, first)
    alone = ((feature[:, 0] > 0) == state).mean()
    assert ((crf.marginals(feature, first, chain) > 0.5) == state).mean() > alone + 0.08


@pytest.mark.parametrize("name, least", [("toxicity", 0.95), ("quality", 0.95)])
def test_held_out(spark, name, least):
    """Accuracy on labels that nothing was learnt from."""
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    got = (toxicity.toxicity if name == "toxicity" else quality.quality)(docs, labels)
    column = {"toxicity": "toxic", "quality": "quality"}[name]
    assert got.count() == docs.count()
    held = got.where("held_out").join(labels, "doc_id")
    assert held.select(F.avg((F.col("predicted") == F.col(column)).cast("double"))).first()[0] >= least
    other = docs.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string"))
    again = (toxicity.toxicity if name == "toxicity" else quality.quality)(other.repartition(3), labels)
    assert {(r.doc_id, round(r.score, 9)) for r in again.collect()} == {(r.doc_id, round(r.score, 9)) for r in got.collect()}


def test_labels_of_the_fold_do_not_matter(spark):
    docs, labels = (spark.read.parquet(f"{DATA}/{t}.parquet") for t in ("documents", "labels"))
    out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    turned = labels.withColumn("toxic", F.when(out, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = toxicity.toxicity(docs, labels), toxicity.toxicity(docs, turned)
    assert {(r.doc_id, r.score) for r in a.collect()} == {(r.doc_id, r.score) for r in b.collect()}


@pytest.mark.parametrize("module", [toxicity, quality])
def test_scores_of_odd_texts(spark, module):
    column = "toxic" if module is toxicity else "quality"
    run = module.toxicity if module is toxicity else module.quality
    docs = spark.createDataFrame([(1, "some idiot said so"), (2, None), (3, ""), (None, "plain words"), (1, "some idiot said so"), (4, "a " * 30000), (5, "\n\n\n")], "doc_id long, text string").withColumn("score", F.lit("x"))
    labels = spark.createDataFrame([(1, 1), (1, 0), (4, 0), (9, None), (None, 1)], f"doc_id long, {column} int")
    got = run(docs, labels).collect()
    assert len(got) == 7 and all(0 <= r.score <= 1 for r in got) and len({r.score for r in got if r.doc_id == 1}) == 1
    assert run(docs, labels.limit(0)).count() == 7 and run(docs.limit(0), labels).count() == 0


def test_samples_are_bounded(spark):
    """In rows and bytes, with an id that very many rows share; a labelled row's text comes whole."""
    good = [k for k in range(300) if zlib.crc32(str(k).encode()) % 5]
    rows = [(good[0], f"shared {k}") for k in range(500)] + [(k, f"text of {k} " * (k + 1)) for k in good[1:]] + [(None, "x"), (good[1], None)]
    docs = spark.createDataFrame(rows + rows[:9], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in good] + [(good[2], 1), (None, 1), (good[3], None)], "doc_id long, toxic int")
    table, all_of = labelled.sample(docs, labels, "toxic", 40)
    label = table.column("label").to_pylist()
    assert label.count(0) == label.count(1) == 40 and sum(all_of) == len(good)
    assert {(r["doc_id"], r["text"]) for r in table.to_pylist()} <= set(rows) and len(table) == len({(r["doc_id"], r["text"]) for r in table.to_pylist()})
    table, _ = labelled.sample(docs, labels, "toxic", 1000, class_bytes=5000)
    for k in (0, 1):
        assert 0 < sum(len(r["text"] or "") for r in table.to_pylist() if r["label"] == k) <= 5000
    again, _ = labelled.sample(docs.repartition(7), labels, "toxic", 1000, class_bytes=5000)
    assert again.to_pylist() == table.to_pylist()


@pytest.mark.parametrize("module", [toxicity, quality])
@pytest.mark.parametrize("labels", [[], [1], [0], [0, 1], [1, 1, 1], [0, 0], [0, 0, 0, 1]])
def test_scores_stay_within_bounds(spark, module, labels):
    """Of none, one, two labelled documents, and of one label alone."""
    column, run = ("toxic", module.toxicity) if module is toxicity else ("quality", module.quality)
    kept = [k for k in range(1, 60) if zlib.crc32(str(k).encode()) % 5][: len(labels)]
    texts = ["a fine line of text\nand one more of it", "zzz %% $$ 11\nqq", None, ""]
    docs = spark.createDataFrame([(k, texts[k % 4]) for k in range(1, 60)], "doc_id long, text string")
    got = run(docs, spark.createDataFrame(list(zip(kept, labels)), f"doc_id long, {column} int")).collect()
    assert len(got) == 59 and all(0 <= r.score <= 1 for r in got)
    if len(set(labels)) == 1 and len(labels) > 1:
        assert all((r.score > 0.5) == (labels[0] == 1) for r in got)


def test_toxic_spans():
    table = pa.table({"text": [f"é word{k} {'idiot' if k % 2 else 'plain'} here it is" for k in range(200)], "label": [k % 2 for k in range(200)]})
    model = toxicity.train(table)

    class Held:
        value = model

    out = next(toxicity._score(Held)(iter([pa.RecordBatch.from_pydict({"text": ["é 漢 idiot x", "clean"]})])))
    assert out.column("spans").to_pylist() == ["4:9", ""] and out.column("score")[0].as_py() > 0.5 > out.column("score")[1].as_py()


def test_a_long_text_leaves_the_others_taught():
    """A clean text of very many words, drawn first, doesn't keep the chain from the toxic ones."""
    n = 100
    text = [f"word{k} {'idiot' if k % 2 else 'plain'} here it is" for k in range(n)]
    label = [k % 2 for k in range(n)]
    first = int(np.random.default_rng(2).permutation(n)[0])
    text[first], label[first] = "w " * 420_000, 0
    model = toxicity.train(pa.table({"text": text, "label": label}))

    class Held:
        value = model

    out = next(toxicity._score(Held)(iter([pa.RecordBatch.from_pydict({"text": ["some idiot x", "clean"]})])))
    assert out.column("spans").to_pylist() == ["5:10", ""]


def exact(rows, k):
    good = {i: np.array(v, float) for i, v in rows if i is not None and v is not None and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    out = {}
    for i, q in good.items():
        if i % 20 == 0:
            s = sorted(((-float((v * q).sum()), j) for j, v in good.items() if j != i))
            out[i] = [(j, -x) for x, j in s[:k]]
    return out


def vectors(n, seed=0):
    rng = np.random.default_rng(seed)
    centre = rng.normal(size=(12, 16))
    return [(k, [float(x) for x in centre[k % 12] + rng.normal(size=16) * 0.7]) for k in range(n)]


def test_nearest(spark, monkeypatch):
    monkeypatch.setattr(ann, "BLOCK", 100)
    monkeypatch.setattr(ann, "LOT", 10)
    rows = vectors(1500)
    hot = rows[7][1]
    rows += [(2000 + k, hot) for k in range(500)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("part", F.lit("x")).withColumn("id", F.lit(0))
    got = {}
    for r in ann.nearest(frame.repartition(4), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = exact(rows, 20)
    assert set(got) == set(want) and all(len(v) == 20 for v in got.values())
    recall = np.mean([len({j for j, _ in got[q]} & {j for j, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    for q in (2000, 2020):  # equal vectors: ties to the smaller id
        assert [j for j, _ in got[q]] == [j for j, _ in want[q]]


def test_nearest_odd_rows(spark):
    shape = "vec_id long, embedding array<float>"
    rows = [(0, [1.0, 2.0]), (1, None), (2, [0.0, 0.0]), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, [3.0, 1.0]), (7, [1.0, 2.0]), (7, [1.0, 2.0]), (None, [1.0, 1.0]), (8, [1.0, 2.0, 3.0])]
    got = ann.nearest(spark.createDataFrame(rows, shape), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in got] == [(0, 1, 6, 5.0), (0, 2, 7, 5.0)]
    assert ann.nearest(spark.createDataFrame([], shape), F.col("vec_id") % 20 == 0).count() == 0


def test_balanced_parts():
    x = np.array([v for _, v in vectors(640, 3)])
    part = ann.balanced_parts(ann._neighbours(x, 8), 8)
    near = ann._neighbours(x, 8)
    sizes = np.bincount(part)
    assert sizes.max() - sizes.min() <= 3
    assert (part[near] == part[:, None]).mean() > 0.5
