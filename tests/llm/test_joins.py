"""Near-duplicate documents and lines against all pairs, word by word."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tandemlake.llm import line_dedup, mixing, ngram_join

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, source string"


def grams(text):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def like(a, b):
    both = len(a & b)
    return bool(a and b) and 100 * both >= 75 * (len(a) + len(b) - both)


def corpus(seed=5, n=90):
    """Texts with exact copies, a large group of near copies, a shared passage, and odd cases."""
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)] + ["É", "ñandú", "a b", "漢字"]
    fresh = lambda k: [r.choice(words) for _ in range(k)]
    base, passage = fresh(120), fresh(60)
    texts = []
    for k in range(n):
        kind = r.random()
        if kind < 0.35:
            w = list(base)
            for _ in range(r.randint(0, 9)):
                w[r.randrange(len(w))] = r.choice(words)
        elif kind < 0.5:
            w = fresh(r.randint(2, 30)) + passage
        elif kind < 0.6 and texts:
            texts.append(r.choice(texts))
            continue
        else:
            w = fresh(r.randint(0, 80))
        lines = []
        while w:
            m = r.randint(1, 40)
            lines.append(" ".join(w[:m]))
            w = w[m:]
        texts.append(r.choice(["\n", "\n", "\n\n"]).join(lines))
    texts += [None, "", "  \t\n", "one two", "ONE two", "one two three", "x " * 5000]
    return [(k * 3, t, f"s{k % 4}" if k % 7 else None) for k, t in enumerate(texts)]


def want_components(rows):
    sets = {i: grams(t) for i, t, _ in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = list(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            if like(sets[a], sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {(i, len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("share", [0.01, 0.6])
def test_components(spark, share):
    rows = corpus()
    docs = spark.createDataFrame(rows, DOCS).withColumn("fp", F.lit(1)).withColumn("kind", F.lit("x")).withColumn("n", F.lit(0))
    got = ngram_join.ngram_components(docs.repartition(3), heavy_share=share)
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()} == want_components(rows)


@pytest.mark.parametrize("rounds", [0, 1])
def test_components_in_blocks(spark, monkeypatch, rounds):
    """Without rounds before it the full search alone finds all links, in small blocks and dealt in two steps too."""
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    monkeypatch.setattr(ngram_join, "BLOCK", 4)
    monkeypatch.setattr(ngram_join, "ONE_STEP", 1)
    rows = corpus(8, 60)
    got = ngram_join.ngram_components(spark.createDataFrame(rows, DOCS))
    assert {(r.doc_id, r.n_shingles, r.component_id) for r in got.collect()} == want_components(rows)


def test_components_odd_rows(spark):
    text = "a b c d e f g"
    rows = [(2, text, None), (2, text, None), (None, text, None), (7, text.upper(), "s"), (None, "alone here", None), (9, None, None)]
    got = sorted(ngram_join.ngram_components(spark.createDataFrame(rows, DOCS)).select("doc_id", "n_shingles", "component_id").collect(), key=str)
    assert [tuple(r) for r in got] == sorted([(2, 3, 2), (2, 3, 2), (None, 3, 2), (7, 3, 2), (None, 1, None), (9, 0, 9)], key=lambda r: f"Row(doc_id={r[0]}, n_shingles={r[1]}, component_id={r[2]})")
    assert ngram_join.ngram_components(spark.createDataFrame([], DOCS)).count() == 0


def test_words_of_one_polynomial_hash(spark):
    """Words that a polynomial modulo a power of 2 takes for one another aren't one."""
    from .test_texts import doubling

    rows = [(k, doubling(1024, k == 1), None) for k in range(3)] + [(k, doubling(4096, k == 4), None) for k in (3, 4)]
    got = ngram_join.ngram_components(spark.createDataFrame(rows, DOCS))
    assert {(r.doc_id, r.component_id) for r in got.collect()} == {(0, 0), (1, 1), (2, 0), (3, 3), (4, 4)}


def sets_of(spark, sets):
    """Sets of whole numbers as what shared_tokens gives: tokens of one set only are counted, others by rarity."""
    df = {}
    for s in sets:
        for t in s:
            df[t] = df.get(t, 0) + 1
    rows = []
    for k, s in enumerate(sets):
        own = sorted((t for t in s if df[t] > 1), key=lambda t: (df[t], t))
        code = ngram_join.code_of(np.array([df[t] for t in own])).tobytes()
        rows.append((k, len(s), len(s) - len(own), bytearray(ngram_join._pack(np.array(own, np.uint64))), bytearray(code), k))
    return spark.createDataFrame(rows, "fp long, n int, alone int, tok binary, code binary, label long").repartition(4)


@pytest.mark.parametrize("common", [1, 4, 9])
def test_boilerplate_makes_few_pairs(spark, common):
    """10,000 short sets that share boilerplate: only sets that share a rare token too are paired up."""
    n = 10_000
    sets = [{*range(common), *(1000 + 3 * (k // 2) + j for j in range(3))} if k % 5 == 0 or k % 5 == 1 else {*range(common), *(10**6 + 4 * k + j for j in range(3))} for k in range(n)]
    made = sets_of(spark, sets).mapInArrow(ngram_join._prefixes(75, 3), ngram_join.POSTINGS)
    pairs = {(r.fp, r.other) for r in ngram_join.candidates(made, 75, 3).collect()}
    like = {(b, a) for a in range(n) for b in range(a + 1, min(a + 3, n)) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])}
    assert like <= pairs and 0 < len(like) and len(pairs) <= n


def test_a_left_over_set_meets_a_group_once(spark):
    """A group of near copies that is one component: a row for each set outside that may link with it, and its links."""
    r = random.Random(2)
    base = list(range(60))
    copy = lambda: {*r.sample(base, 55), *(100 + r.randrange(30) for _ in range(3))}
    sets = [copy() for _ in range(400)] + [{*r.sample(base, 40)} for _ in range(20)]
    frame = sets_of(spark, sets).withColumn("label", F.when(F.col("fp") < 400, F.lit(0)).otherwise(F.col("fp")))
    pairs = ngram_join.candidates(frame.mapInArrow(ngram_join._prefixes(75, 3), ngram_join.POSTINGS), 75, 3)
    links = {(x.a, x.b) for x in ngram_join.links_across(pairs, frame, 75).collect()}
    near = lambda a, b: 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])
    want = {(a, 0 if b < 400 else b) for a in range(400, 420) for b in range(a) if near(a, b)}
    assert {(a, 0 if b < 400 else b) for a, b in links} == want and all(near(a, b) for a, b in links) and len(links) == len(want)
    assert pairs.count() <= 20 + 20 * 19 // 2


def test_pairs_of_one_hot_set(spark):
    """A head of very many pairs goes to each lot of them once."""
    sets = sets_of(spark, [set(range(20))] + [{*range(20), 100 + k % 3} - {k % 20} for k in range(500)] + [{1, 2}, {2, 1}])
    pairs = spark.createDataFrame([(k, 0) for k in range(1, 501)] + [(501, 502), (501, 0)], "a long, b long")
    assert {(r.a, r.b) for r in ngram_join.links_of(pairs, sets, 75).collect()} == {(k, 0) for k in range(1, 501)} | {(501, 502)}


def want_lines(rows):
    """The rows' texts after dedup, and the numbers of the lines that go."""
    place = lambda i, k: (i is not None, i or 0, k)
    lines = sorted(((place(i, k), grams(x)) for i, t, _ in rows if t is not None for k, x in enumerate(t.split("\n"))), key=lambda x: x[0])
    first, gone, order = {}, set(), []
    for p, s in lines:
        if s and s not in first:
            first[s] = p
            if any(like(s, o) for o in order):
                gone.add(s)
            order.append(s)
    drop = {p for p, s in lines if s and (s in gone or first[s] != p)}
    out = {}
    for i, t, _ in rows:
        cut = [k for k in range(len((t or "").split("\n"))) if place(i, k) in drop]
        out[i] = (None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if k not in cut), cut)
    return out


@pytest.mark.parametrize("steps, block", [(1024, 1024), (1, 3)])
def test_lines(spark, monkeypatch, steps, block):
    """Dealt in one step or two, lists of a token whole or in blocks."""
    monkeypatch.setattr(line_dedup, "ONE_STEP", steps)
    monkeypatch.setattr(line_dedup, "BLOCK", block)
    rows = corpus(11, 80)
    docs = spark.createDataFrame(rows, DOCS).withColumn("line", F.lit("x")).withColumn("id", F.lit(0)).withColumn("lines_removed", F.lit(1))
    got = line_dedup.dedup_lines(docs.repartition(3))
    assert got.columns == ["doc_id", "text", "source", "line", "id", "lines_removed"]
    assert {r.doc_id: (r.text, r.lines_removed) for r in got.collect()} == want_lines(rows)


def test_packs_grow_with_tokens():
    """Of two steps: packs a batch makes are as many as coarse groups, not as ranges."""
    from tandemlake.llm import textvec as tv

    rng = np.random.default_rng(3)
    made = {}
    for scale in (1, 4, 16):
        ranges = 4096 * scale
        fan = int(np.ceil(np.sqrt(ranges)))
        tok = tv.mix64(rng.integers(0, 2**62, 60_000 * scale, dtype=np.uint64)) >> np.uint64(16)
        row = np.sort(rng.integers(0, 100, len(tok)))
        fp = tv.mix64(np.arange(100, dtype=np.uint64))
        made[scale] = len(line_dedup._by_range(fp, row, tok, tok[:0], lambda x: line_dedup._coarse(ngram_join.range_of(x, ranges), fan))[0])
    assert made == {1: 64, 4: 128, 16: 256}


def test_lines_odd_rows(spark):
    same = "the very same line of text\nthe very same line of text\n\nend of it"
    rows = [(None, same, None), (1, same, None), (4, None, None), (5, "", None)]
    twice = [*rows, rows[1]]
    got = line_dedup.dedup_lines(spark.createDataFrame(twice, DOCS)).collect()
    assert sorted((str(r.doc_id), r.text, tuple(r.lines_removed)) for r in got if r.doc_id != 4) == [("1", "", (0, 1, 3)), ("1", "", (0, 1, 3)), ("5", "", ()), ("None", "the very same line of text\n\nend of it", (1,))]
    assert [r.text for r in got if r.doc_id == 4] == [None]
    assert line_dedup.dedup_lines(spark.createDataFrame([], DOCS)).count() == 0


def want_mix(rows):
    weights = (3, 1, 2)
    size = lambda t: len(WORD.findall(t or ""))
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    total = {n: sum(size(t) for _, t, s in rows if s == n) for n in names}
    goal, full = 1.5 * sum(total.values()), {}
    w = {n: weights[k % 3] for k, n in enumerate(names)}
    while True:
        free = [n for n in names if n not in full]
        unit = (goal - sum(full.values())) / (sum(w[n] for n in free) or 1)
        over = [n for n in free if w[n] * unit >= 2 * total[n]]
        if not over:
            return {n: full.get(n, w[n] * unit) for n in names}, total
        full |= {n: 2.0 * total[n] for n in over}


@pytest.mark.parametrize("bits", [6, 17])
def test_mix(spark, bits):
    rows = corpus(3, 120)
    target, total = want_mix(rows)
    docs = spark.createDataFrame(rows, DOCS).withColumn("size", F.lit("x")).withColumn("at", F.lit(0))
    got = mixing.mix_sources(docs, bits=bits).collect()
    assert len(got) == len(rows)
    for n in target:
        own = [r for r in got if r.source == n]
        assert own[0].target == pytest.approx(target[n]) and all(r.source_size == total[n] for r in own)
        assert sum(r.taken for r in own) == int(target[n] + 0.5)
    assert all(0 <= r.taken <= 2 * r["size"] for r in got)
    again = mixing.mix_sources(docs.repartition(5), bits=bits).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mix_follows_the_schedule(spark):
    """Any run of slots holds each source near its weight."""
    rows = [(k, "w " * 20, f"s{k % 3}") for k in range(300)]
    pieces, docs = mixing.mix_pieces(spark.createDataFrame(rows, DOCS), bits=8)
    share = {r.source: r.target for r in docs.select("source", "target").distinct().collect()}
    slot = [r.source for r in pieces.select("position", "source").distinct().orderBy("position").collect()]
    for n in (16, 32, 64):
        for s, t in share.items():
            assert abs(sum(x == s for x in slot[:n]) - n * t / sum(share.values())) <= 4


def test_mix_odd_rows(spark):
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).count() == 0
    empty = mixing.mix_sources(spark.createDataFrame([(1, None, None), (2, "", "a")], DOCS)).collect()
    assert [(r["size"], r.source_size, r.taken) for r in empty] == [(0, 0, 0)] * 2
    rows = [(1, "a b c", None), (1, "a b c", None), (None, "d", None)]
    got = mixing.mix_sources(spark.createDataFrame(rows, DOCS)).collect()
    assert sum(r.taken for r in got) == 11 and len(got) == 3


def slow_schedule(docs, bits):
    """The mix slot by slot: which words of which document stand at which position."""
    target, total = want_mix([(i, t, s) for i, t, s in docs])
    names = sorted(target, key=lambda s: (s is None, s or ""))
    goal, n = sum(target.values()), 1 << bits
    block = max(1, -(-int(1.5 * sum(total.values()) * 2) // n))
    rows = {s: [] for s in names}
    for i, t, s in docs:
        key = hashlib.md5(f"{'' if i is None else i}:{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()
        rows[s].append((key, i, len(WORD.findall(t or ""))))
    line = {s: [(i, e, w) for e in (0, 1) for _, i, size in sorted(rows[s]) for w in range(size)][: int(target[s] + 0.5)] for s in names}
    place, first, taken = {s: 0 for s in names}, {}, {}

    def fill(s, position):
        for i, _, _ in line[s][place[s] * block : (place[s] + 1) * block]:
            first[i] = min(first.get(i, position), position)
            taken[i] = taken.get(i, 0) + 1
        place[s] += 1

    edge = [sum(target[x] for x in names[:k]) / goal for k in range(len(names) + 1)]
    for position in range(n):
        point = int(f"{position:0{bits}b}"[::-1], 2) / n
        s = next((s for k, s in enumerate(names) if edge[k] <= point < edge[k + 1]), names[-1])
        fill(s, position)
    for s in names:
        while place[s] * block < len(line[s]):
            fill(s, n + place[s])
    return {i: (taken.get(i, 0), first.get(i)) for i, _, _ in docs}


def test_mix_against_the_schedule_slot_by_slot(spark):
    rows = [(k, " ".join("w" * (j + 1) for j in range(k % 17)), None if k % 5 == 0 else f"s{k % 4}") for k in range(90)] + [(900, None, "s1")]
    got = mixing.mix_sources(spark.createDataFrame(rows, DOCS).repartition(3), bits=7).collect()
    assert {r.doc_id: (r.taken, r.first_slot) for r in got} == slow_schedule(rows, 7)


def test_slots_grow_with_the_corpus(spark, monkeypatch):
    """Blocks stay within BLOCK_WORDS."""
    monkeypatch.setattr(mixing, "SLOT_BITS", 3)
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 16)
    rows = [(k, "w " * 20, f"s{k % 3}") for k in range(120)]
    pieces, _ = mixing.mix_pieces(spark.createDataFrame(rows, DOCS))
    assert pieces.groupBy("position").agg(F.sum(F.col("end_word") - F.col("first_word")).alias("n")).agg(F.max("n")).first()[0] <= 16


def test_digest_orders():
    """The shuffle is by digest, so that neighbours in the source aren't neighbours in the mix."""
    order = sorted(range(50), key=lambda k: hashlib.md5(str(k).encode()).hexdigest())
    assert sum(abs(a - b) == 1 for a, b in zip(order, order[1:])) < 10
