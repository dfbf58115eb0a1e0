"""The pipeline's stages, each on what the one before it kept."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tandemlake.llm import toxicity

from .test_joins import WORD, corpus, want_components, want_lines, want_mix


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Small tables: the corpus, some of it toxic, and labels of most of it."""
    at = tmp_path_factory.mktemp("tables")
    rows = [(i, t, "en", s, len(t or "")) for i, t, s in corpus(21, 80)]
    rows += [(1000 + k, f"well word{k} you are an idiot and more " + "w " * k, "en", "s1", 50) for k in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(2).write.parquet(f"{at}/documents.parquet")
    labels = [(i, 1, int(i >= 1000)) for i, *_ in rows]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    shape, kept = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], folder).write.parquet(f"{tmp_path}/{k}")
        kept.append(spark.read.parquet(f"{tmp_path}/{k}"))
    rows = [[tuple(r) for r in x.select("doc_id", "text", "source").collect()] for x in kept[:5]]
    assert all(x.columns == shape for x in kept[:5])
    # toxicity: toxic rows go, clean ones stay
    left = {r[0] for r in rows[1]}
    assert not any(i >= 1000 for i in left) and len(left) >= 0.95 * sum(r[0] < 1000 for r in rows[0])
    # lines
    lines = want_lines(rows[1])
    assert {r[0]: r[1] for r in rows[2]} == {i: t for i, (t, _) in lines.items()}
    # documents: one of each group
    first = {i: c for i, _, c in want_components(rows[2])}
    assert sorted(r[0] for r in rows[3]) == sorted({c for c in first.values()})
    # the mix: each source's words exactly, whole texts but for one a source
    target, total = want_mix(rows[3])
    size = lambda t: len(WORD.findall(t or ""))
    for s in target:
        assert sum(size(t) for _, t, o in rows[4] if o == s) == int(target[s] + 0.5)
    copies = {}
    for r in rows[4]:
        copies[r] = copies.get(r, 0) + 1
    cut = [r for r in copies if r not in set(rows[3])]
    assert max(copies.values()) <= 2 and len(cut) <= len(target) and len({r[2] for r in cut}) == len(cut)
    for i, t, s in cut:
        assert any(x[0] == i and x[1].startswith(t) for x in rows[3])
    assert all(r.n_chars == len(r.text) for r in kept[4].collect() if (r.doc_id, r.text, r.source) in set(cut))
    # pieces
    from tandemlake.llm import pieces

    back = pieces.decode_ids(kept[5]).select("doc_id", "decoded").collect()
    assert sorted(map(tuple, back)) == sorted((i, t or "") for i, t, _ in rows[4])


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder)
    assert out.columns == ["doc_id", "source", "n_ids", "ids"] and out.count() > 0
    assert out.where(F.size("ids") != F.col("n_ids")).count() == 0


def test_no_rows(spark, folder):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_threshold(spark, folder):
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    got = toxicity.toxicity(docs, labels)
    assert got.where((F.col("score") >= 0.5) != (F.col("predicted") == 1)).count() == 0


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_documents_of_null_and_repeated_ids(spark):
    """Texts that don't link all stay, whatever their ids; of those that do the least id stays, null last."""
    text = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    near = text("five") + " more"
    rows = [(None, text(f"n{k}")) for k in range(6)] + [(None, near), (5, text("five")), (7, text("a")), (7, text("b")), (3, text("b"))]
    rows += [(None, text("twin")), (None, text("twin")), (9, text("one")), (9, text("one")), (None, None), (None, ""), (8, " ")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], DOCS).repartition(3)
    got = corpus_pipeline.dedup_documents(spark, docs, "")
    assert got.columns == docs.columns
    want = [(None, text(f"n{k}")) for k in range(6)] + [(5, text("five")), (7, text("a")), (3, text("b")), (None, text("twin")), (9, text("one")), (None, None), (None, ""), (8, " ")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))


def test_mix_is_in_the_order_of_its_schedule(spark):
    """Whatever prefix of the rows is taken, sources are near their shares."""
    rows = [(k, " ".join(f"{k}w{i}" for i in range(10)), "en", f"s{k % 3}", 0) for k in range(600)]
    docs = spark.createDataFrame(rows, DOCS).repartition(5)
    got = [r.source for r in corpus_pipeline.mix_sources(spark, docs, "").collect()]
    target, _ = want_mix([(i, t, s) for i, t, _, s, _ in rows])
    for n in (60, 200, 500):
        for s, t in target.items():
            assert abs(got[:n].count(s) / n - t / sum(target.values())) < 0.05


def test_accounts_of_rows(spark):
    """Stage by stage: which rows with null and repeated ids are left."""
    text = lambda k, n=30: " ".join(f"{k}w{i}" for i in range(n))
    rows = [(None, text(f"n{k}")) for k in range(5)] + [(1, text("a")), (1, text("b")), (1, text("a")), (2, None), (None, ""), (3, "one\n" + text("c"))]
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOCS).repartition(2)
    count = {"documents": docs.count()}
    docs = corpus_pipeline.dedup_lines(spark, docs, "").cache()
    count["line dedup"] = docs.count()
    docs = corpus_pipeline.dedup_documents(spark, docs, "").cache()
    count["n-gram join"] = docs.count()
    assert count == {"documents": 11, "line dedup": 11, "n-gram join": 10} and docs.where("doc_id is null").count() == 6
    mixed = corpus_pipeline.mix_sources(spark, docs, "").cache()
    assert mixed.select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0] == round(1.5 * (5 * 30 + 2 * 30 + 31))
    assert corpus_pipeline.encode(spark, mixed, "").count() == mixed.count()


@pytest.mark.parametrize("doc_id", [None, 7])
def test_mix_of_null_and_repeated_ids(spark, doc_id):
    """Each row by its own count: sources are as near their targets as with different ids."""
    rows = [(doc_id, " ".join(f"{k}w{i}" for i in range(1 + k % 30)), "en", f"s{k % 3}", 0) for k in range(200)]
    rows += [(doc_id, "twin rows", "en", "s0", 0)] * 9 + [(doc_id, None, "en", "s0", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    target, _ = want_mix([(i, t, s) for i, t, _, s, _ in rows])
    got = [(r.text, r.source) for r in corpus_pipeline.mix_sources(spark, docs, "").collect()]
    for s in target:
        assert sum(len(t.split()) for t, o in got if o == s) == int(target[s] + 0.5)
    assert max(got.count(x) for x in set(got) if x[0] != "twin rows") <= 2 and got.count(("twin rows", "s0")) <= 18
