"""Line dedup: an exact set-similarity join of all lines, removing later matches.

A line is the set of its distinct word shingles (one of all its words if they
are few). Tokens are ordered by rarity over all lines. Two lines of similarity t
or more share a token among the first n - ceil(t n) + 1 of each (prefix filter);
sizes can't differ by more than t (length filter); and what follows the first
shared token must be long enough (positional filter). What is left is verified.

A line goes if an earlier line, kept or not, matches it; lines come by document
id, then place. So of a match the later line goes, and only one earlier match has
to be found for each. Equal sets are one class: its first line is looked at, the
others go. Classes are held against a few heads of their sketch's buckets first,
so that groups of near copies don't meet pair by pair; the full search is for
classes that no earlier match was found for. Nothing is left out by it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from . import textvec as tv
from .ngram_join import BLOCK, HEAVY_SHARE, MOST_BUCKETS, ONE_STEP, _pack, _packs, _unpack, code_of, frequent, links_of, need, range_of, sketch_of, token_sets
from .scratch import Scratch
from .skew import meet

U64 = np.uint64
#: Tokens of one batch; bytes of text that one range stands for.
TOKENS, BYTES = 1_000_000, 33_000_000
#: The frequency code of tokens that are too common anywhere to be dealt out by range.
COMMON = 255
_PLACE = np.dtype([("has", "u1"), ("id", "<i8"), ("digest", "<i8"), ("line", "<i4")])
#: How often classes are held against a head before the full search.
ROUNDS = 2


def _parts(raw: np.ndarray, *shapes) -> list[np.ndarray]:
    """Arrays that lie one after the other; shapes: (dtype, length)."""
    out, at = [], 0
    for dtype, n in shapes:
        size = np.dtype(dtype).itemsize * n
        out.append(raw[at : at + size].copy().view(dtype))
        at += size
    return [*out, raw[at:]]


def _runs(fp: np.ndarray, count: np.ndarray, tok: np.ndarray, common: np.ndarray, code: np.ndarray | None = None) -> bytes:
    """Sets with their tokens (and codes), after the tokens that the batch found common."""
    wide = "<u1" if count.max(initial=0) < 256 else "<u4"
    head = np.array([len(fp), len(common), int(wide[-1]), len(tok)], "<u4")
    return b"".join((head.tobytes(), fp.astype("<u8").tobytes(), count.astype(wide).tobytes(), _pack(common), _pack(tok), b"" if code is None else code.astype("u1").tobytes()))


def _unruns(raw) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(raw, np.uint8)
    m, h, wide, total = raw[:16].view("<u4").tolist()
    fp, count, common, tok, code = _parts(raw[16:], ("<u8", m), (f"<u{wide}", m), ("u1", 6 * h), ("u1", 6 * total))
    return fp, count.astype(np.int64), _unpack(common), _unpack(tok), code


def _quarters(blobs: list[np.ndarray], ranges: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(each token's set, tokens, common tokens) of all blobs of a range, each set's tokens once; a quarter of the range at a time."""
    heads = [b[:16].view("<u4").tolist() for b in blobs]
    fps = np.concatenate([b[16 : 16 + 8 * h[0]].copy().view("<u8") for b, h in zip(blobs, heads)])
    sets, first, own = np.unique(fps, return_index=True, return_inverse=True)
    one = np.zeros(len(fps), bool)
    one[first] = True
    del fps, first
    for quarter in range(4):
        toks, owners, common, run = [], [], [], 0
        for b, (m, h, width, _) in zip(blobs, heads):
            count, more, raw = _parts(b[16 + 8 * m :], (f"<u{width}", m), ("u1", 6 * h))
            tok, more = _unpack(raw), _unpack(more)
            place = lambda t: ((t >> U64(16)) * U64(ranges) & U64(0xFFFFFFFF)) >> U64(30)
            keep = np.repeat(one[run : run + m], count) & (place(tok) == quarter)
            toks.append(tok[keep])
            owners.append(np.repeat(own[run : run + m].astype(np.int32), count)[keep])
            common.append(more[place(more) == quarter])
            run += m
        yield sets, np.concatenate(owners), np.concatenate(toks), np.unique(np.concatenate(common))


def _by_place(fp: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, new, first): rows by set, then place; a row that isn't the same line again; a set's first."""
    order = np.lexsort((place["line"], place["digest"], place["id"], place["has"], fp))
    f, p = fp[order], place[order]
    first = np.r_[True, f[1:] != f[:-1]] if len(f) else np.zeros(0, bool)
    new = np.r_[True, (p[1:] != p[:-1]) | first[1:]] if len(f) else np.zeros(0, bool)
    return order, new, first


def _by_range(fp: np.ndarray, row: np.ndarray, tok: np.ndarray, common: np.ndarray, group_of) -> tuple[list, list]:
    """Runs by group of tokens, for groups that have a token or a common one; row: each token's set."""
    group, marked = group_of(tok), group_of(common)
    order, place = np.argsort(group, kind="stable"), np.argsort(marked, kind="stable")
    row, tok, group, common, marked = row[order], tok[order], group[order], common[place], marked[place]
    keys = np.union1d(group, marked)
    edges = [np.searchsorted(x, keys, side).tolist() for x in (group, marked) for side in ("left", "right")]
    blobs = []
    for a, b, c, d in zip(*edges):
        own = row[a:b]
        new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]]) if b > a else np.zeros(0, np.int64)
        blobs.append(_runs(fp[own[new]], np.diff(np.r_[new, b - a]), tok[a:b], common[c:d]))
    return keys.tolist(), blobs


def _by_set(fp: np.ndarray, tok: np.ndarray, code: np.ndarray, group_of) -> tuple[list, list]:
    """Runs with codes by group of sets; fp: each token's set."""
    group = group_of(fp)
    order = np.lexsort((tok, fp, group))
    fp, tok, code, group = fp[order], tok[order], code[order], group[order]
    cut = np.flatnonzero(group[1:] != group[:-1]) + 1
    keys, blobs = [], []
    for a, b in zip(np.r_[0, cut].tolist() if len(group) else [], np.r_[cut, len(group)].tolist()):
        new = np.flatnonzero(np.r_[True, fp[a + 1 : b] != fp[a : b - 1]])
        keys.append(int(group[a]))
        blobs.append(np.zeros(1, "<u4").tobytes() + _runs(fp[a:b][new], np.diff(np.r_[new, b - a]), tok[a:b], tok[:0], code[a:b]))
    return keys, blobs


def _coarse(group: np.ndarray, fan: int) -> np.ndarray:
    """Groups, or keys under 0 for `fan` of them together."""
    return group if fan == 1 else -1 - group // fan


def _deal_again(ranges: int, sets: bool):
    """Blobs of coarse groups (keys under 0) dealt to the ranges, or groups of sets, in them; others pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, have = [], 0

        def flush():
            fp, count, common, tok, code = (np.concatenate([h[k] for h in held]) for k in range(5))
            held.clear()
            if sets:
                return _packs(*_by_set(np.repeat(fp, count), tok, code, lambda x: (x % U64(ranges)).astype(np.int64)))
            return _packs(*_by_range(fp, np.repeat(np.arange(len(fp)), count), tok, common, lambda x: range_of(x, ranges)))

        for batch in batches:
            coarse = batch.column(0).to_numpy() < 0
            yield batch.filter(pa.array(~coarse))
            for blob in batch.column(1).filter(pa.array(coarse)):
                held.append(_unruns(blob.as_buffer()[4:] if sets else blob.as_buffer()))
                have += len(held[-1][3])
                if have >= TOKENS:
                    yield flush()
                    have = 0
        if held:
            yield flush()
        tv.release()

    return run


def _again(packs: DataFrame, ranges: int, fan: int, sets: bool) -> DataFrame:
    """The second step of a deal in two: each coarse group's packs come together, then go out by range."""
    if fan == 1:
        return packs
    return packs.repartition("key").sortWithinPartitions("key").mapInArrow(_deal_again(ranges, sets), "key long, blob binary")


def _deal(width: int, ranges: int, fan: int, share: float):
    """Blobs of a batch's different lines: tokens by range; sizes, places and common tokens by set; lines that go by id.

    Keys: below `ranges` token ranges (or below 0, `fan` of them together), then as
    many groups of sets, then as many of lines that an equal line of the batch
    comes before.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush():
            tok, n, fp, place = (np.concatenate([h[k] for h in held]) for k in range(4))
            held.clear()
            common = np.sort(frequent([tok], share, len(fp))[0].view(U64))
            at = np.r_[0, np.cumsum(n)]
            some = np.flatnonzero(n)
            order, new, first = _by_place(fp[some], place[some])
            order = some[order]
            one, later = order[first], order[new & ~first]
            row = np.repeat(np.arange(len(one)), n[one])
            tok = tok[np.repeat(at[one] - np.r_[0, np.cumsum(n[one])[:-1]], n[one]) + np.arange(len(row))] if len(one) else tok[:0]
            fp1, n1, place1 = fp[one], n[one], place[one]
            spot = np.minimum(np.searchsorted(common, tok), max(len(common) - 1, 0))
            is_common = common[spot] == tok if len(common) else np.zeros(len(tok), bool)
            keys, blobs = _by_range(fp1, row[~is_common], tok[~is_common], common, lambda x: _coarse(range_of(x, ranges), fan))
            t, r = tok[is_common], row[is_common]
            count = np.bincount(r, minlength=len(one))
            first_of = np.r_[0, np.cumsum(count)]
            group = (fp1 % U64(ranges)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []:
                pick = np.repeat(first_of[own] - np.r_[0, np.cumsum(count[own])[:-1]], count[own]) + np.arange(count[own].sum())
                inner = _runs(fp1[own], count[own], t[pick], common[:0])
                keys.append(ranges + int(group[own[0]]))
                blobs.append(np.array([len(own)], "<u4").tobytes() + n1[own].astype("<u4").tobytes() + place1[own].tobytes() + inner)
            group = (tv.mix64(place["id"][later].view(U64)) ^ tv.mix64(place["digest"][later].view(U64))) % U64(ranges)
            order = np.argsort(group, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(group[order])) + 1) if len(order) else []:
                keys.append(2 * ranges + int(group[at[0]]))
                blobs.append(fp[later[at]].tobytes() + place[later[at]].tobytes())
            return _packs(keys, blobs)

        for batch in batches:
            has = pc.is_valid(batch.column(0)).to_numpy(zero_copy_only=False)
            ids, digest = batch.column(0).fill_null(0).to_numpy(), batch.column(1).fill_null(0).to_numpy()
            for i, j, of_row, tok, at, fp in token_sets(batch.column(2), width, True):
                many = np.diff(of_row)
                row = np.repeat(np.arange(i, j), many)
                place = np.empty(len(row), _PLACE)
                place["has"], place["id"], place["digest"] = has[row], ids[row], digest[row]
                place["line"] = np.arange(len(row)) - np.repeat(of_row[:-1], many)
                held.append((tok, np.diff(at), fp, place))
                if sum(len(h[0]) for h in held) >= TOKENS:
                    yield flush()
        if held:
            yield flush()
        tv.release()

    return run


def _count(ranges: int, fan: int):
    """Of one token range: tokens of two sets or more, and all that are common in a batch, dealt out by set."""

    def run(table: pa.Table) -> pa.Table:
        key, blobs = table.column("key")[0].as_py(), table.column("blob")
        if key >= ranges:
            return pa.table({"key": pa.array(np.full(len(table), key - ranges, np.int64)), "blob": blobs})
        keys, out = [], []
        for sets, owner, tok, common in _quarters([np.frombuffer(b.as_buffer(), np.uint8) for b in blobs], ranges):
            order = np.argsort(tok)
            tok, owner = tok[order], owner[order]
            again = np.zeros(len(tok), bool)
            again[1:] = tok[1:] == tok[:-1]
            keep = again.copy()
            keep[:-1] |= again[1:]
            for x, y in zip(np.searchsorted(tok, common, "left").tolist(), np.searchsorted(tok, common, "right").tolist()):
                keep[x:y] = True
            tok, owner = tok[keep], owner[keep]
            start = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]]) if len(tok) else np.zeros(0, np.int64)
            df = np.diff(np.r_[start, len(tok)])
            code = np.minimum(code_of(df), COMMON - 1)
            code[np.isin(tok[start], common)] = COMMON
            more = _by_set(sets[owner], tok, np.repeat(code, df), lambda x: _coarse((x % U64(ranges)).astype(np.int64), fan))
            keys += more[0]
            out += more[1]
        return pa.Table.from_batches([_packs(keys, out)])

    return tv.releasing(run)


SETS = "kind tinyint, fp long, n int, alone int, tok binary, code binary, id long, digest long, line int"


def _rows(kind: int, fp, n, alone, tok, code, place) -> pa.Table:
    m = len(fp)
    ids = pa.array(place["id"].astype(np.int64), mask=place["has"] == 0)
    cols = [pa.array(np.full(m, kind, np.int8)), pa.array(fp.view(np.int64)), n, alone, tok, code, ids, pa.array(place["digest"].astype(np.int64)), pa.array(place["line"].astype(np.int32))]
    return pa.table(cols, names=[x.split()[0] for x in SETS.split(", ")])


def _gather(ranges: int, percent: int):
    """Of one group of sets: those whose prefix holds a token of another (kind 0, at their first line), and all later equal lines (kind 1)."""

    def gone(fp, place):
        m = len(fp)
        return _rows(1, fp, pa.nulls(m, pa.int32()), pa.nulls(m, pa.int32()), pa.nulls(m, pa.binary()), pa.nulls(m, pa.binary()), place)

    def run(table: pa.Table) -> pa.Table:
        key, blobs = table.column("key")[0].as_py(), [np.frombuffer(b.as_buffer(), np.uint8) for b in table.column("blob")]
        if key >= ranges:
            both = [_parts(b, ("<u8", len(b) // (8 + _PLACE.itemsize)), (_PLACE, len(b) // (8 + _PLACE.itemsize))) for b in blobs]
            return gone(np.concatenate([b[0] for b in both]), np.concatenate([b[1] for b in both]))
        n, place, own, parts = [], [], [], []
        for b in blobs:
            m = int(b[:4].view("<u4")[0])
            sizes, places, inner = _parts(b[4:], ("<u4", m), (_PLACE, m))
            fp, count, _, tok, code = _unruns(inner.tobytes())
            parts.append((np.repeat(fp, count), tok, code if len(code) else np.full(len(tok), COMMON, np.uint8)))
            if m:
                n.append(sizes)
                place.append(places)
                own.append(fp)
        if not own:
            return gone(np.zeros(0, U64), np.zeros(0, _PLACE))
        n, place, own = np.concatenate(n).astype(np.int64), np.concatenate(place), np.concatenate(own)
        order, new, first = _by_place(own, place)
        later = order[new & ~first]
        sets, size, at = own[order[first]], n[order[first]], place[order[first]]
        fp, tok, code = (np.concatenate(x) for x in zip(*parts))
        row = np.searchsorted(sets, fp)
        order = np.lexsort((tok, code, row))
        row, tok, code = row[order], tok[order], code[order]
        fresh = np.r_[True, (row[1:] != row[:-1]) | (tok[1:] != tok[:-1])] if len(row) else np.zeros(0, bool)
        row, tok, code = row[fresh], tok[fresh], code[fresh]
        have = np.bincount(row, minlength=len(sets))
        alone = size - have
        pick = np.flatnonzero((alone < size - need(size, percent) + 1) & (have > 0))
        edge = np.r_[0, np.cumsum(have)]
        toks = pa.array([_pack(tok[edge[k] : edge[k + 1]]) for k in pick], pa.binary())
        codes = pa.array([code[edge[k] : edge[k + 1]].tobytes() for k in pick], pa.binary())
        out = _rows(0, sets[pick], pa.array(size[pick].astype(np.int32)), pa.array(alone[pick].astype(np.int32)), toks, codes, at[pick])
        return pa.concat_tables([out, gone(own[later], place[later]).cast(out.schema)])

    return tv.releasing(run)


def _prefix(percent: int):
    """(tok, fp, n, place, order columns): each class's shared prefix tokens, rarest first, with their place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toks = [_unpack(np.frombuffer(x.as_buffer(), np.uint8)) for x in batch.column("tok")]
            size, alone = batch.column("n").to_numpy().astype(np.int64), batch.column("alone").to_numpy().astype(np.int64)
            length = np.minimum(size - need(size, percent) + 1 - alone, [len(x) for x in toks]).astype(np.int64)
            row = np.repeat(np.arange(len(toks)), length)
            place = alone[row] + np.arange(len(row)) - np.repeat(np.cumsum(length) - length, length)
            tok = np.concatenate([x[:k] for x, k in zip(toks, length.tolist())]).astype(np.int64) if toks else np.zeros(0, np.int64)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(tok), *(batch.column(c).take(take) for c in ("fp", "n", "at", "open")), pa.array(place.astype(np.int32))], ["tok", "fp", "n", "at", "open", "place"])

    return run


def duplicate_lines(docs: DataFrame, width: int = 5, percent: int = 75, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """(id, digest, lines): for each document with lines to remove, their numbers (from 0), from (id, digest, text)."""
    scratch = Scratch(docs.sparkSession, "line_dedup")
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0)).alias("size")).first().size
    ranges = max(12, -(-size // BYTES))
    fan = 1 if ranges <= ONE_STEP else int(np.ceil(np.sqrt(ranges)))
    packs = "key long, blob binary"
    dealt = _again(docs.select("id", "digest", "text").mapInArrow(_deal(width, ranges, fan, heavy_share), packs), ranges, fan, False)
    spread = 3 * ranges  # as many tasks as there are keys, however many partitions the session asks for
    by_set = _again(dealt.repartition(spread, "key").groupBy("key").applyInArrow(_count(ranges, fan), packs), ranges, fan, True)
    filed = scratch.bucketed(by_set.repartition(spread, "key").groupBy("key").applyInArrow(_gather(ranges, percent), SETS), "fp", min(max(8, ranges), MOST_BUCKETS), "kind")
    known = filed.where("kind = 0").select("fp", "n", "alone", "tok", "code", F.struct("id", "digest", "line").alias("at"))
    sets = known

    gone = None
    sketch = scratch.keep(known.select("fp", "tok").mapInArrow(sketch_of(0), "tok long, fp long").join(known.select("fp", "at"), "fp"))
    for turn in range(ROUNDS):
        rows = sketch if gone is None else sketch.join(gone, "fp", "left_anti")
        least = F.struct("at", "fp") if turn == 0 else F.struct(F.xxhash64("fp", F.lit(turn)), "at", "fp")
        head = sketch.groupBy("tok").agg(F.min(least).alias("h")).select("tok", F.col("h.fp").alias("b"), F.col("h.at").alias("b_at"))
        met = rows.join(head, "tok").where("b <> fp and b_at < at").groupBy(F.col("fp").alias("a"), "b").agg(F.count("*").alias("m"))
        pairs = scratch.keep(met.groupBy("a").agg(F.max(F.struct("m", "b")).alias("x")).select("a", "x.b"))
        new = scratch.keep(links_of(pairs, sets, percent).select(F.col("a").alias("fp")))
        gone = new if gone is None else gone.union(new)

    tokens = known.join(gone.withColumn("x", F.lit(True)), "fp", "left").select("fp", "n", "alone", "tok", "at", F.col("x").isNull().alias("open"))
    at = dict(known.dtypes)["at"]
    prefix = scratch.keep(tokens.mapInArrow(_prefix(percent), f"tok long, fp long, n int, at {at}, open boolean, place int"))
    y = prefix.select("tok", F.col("fp").alias("b"), F.col("n").alias("y"), F.col("at").alias("b_at"), F.col("place").alias("q"))
    x = prefix.where("open").select("tok", F.col("fp").alias("a"), F.col("n").alias("x"), "at", F.col("place").alias("p"))
    short = lambda n, place: (F.col(n) - F.col(place)) * (100 + percent) >= F.col(n) * (2 * percent)
    shared = F.least(F.col("x") - F.col("p"), F.col("y") - F.col("q"))
    alike = (F.col("b_at") < F.col("at")) & (F.col("a") != F.col("b")) & (shared * (100 + percent) >= percent * (F.col("x") + F.col("y")))
    # the smaller line of two comes by its short prefix, the larger one by its whole prefix
    smaller = short("x", "p") & (F.col("x") <= F.col("y")) & (F.col("x") * 100 >= F.col("y") * percent)
    larger = short("y", "q") & (F.col("x") > F.col("y")) & (F.col("y") * 100 >= F.col("x") * percent)
    found = scratch.keep(meet(x, y, ["tok"], BLOCK).where(alike & (smaller | larger)).select("a", "b").distinct())
    gone = gone.union(links_of(found, sets, percent).select(F.col("a").alias("fp"))).distinct()

    whole = known.join(gone, "fp", "left_semi").select("at.id", "at.digest", "at.line")
    out = filed.where("kind = 1").select("id", "digest", "line").union(whole)
    out = scratch.keep(out.groupBy("id", "digest").agg(F.collect_set("line").alias("lines")))
    scratch.clear(out)
    return out


def kept_text(text: Column, gone: Column) -> Column:
    """The text without the lines of the given numbers, each once; work follows lines, not lines times numbers."""
    lines = F.split(text, "\n", -1)
    every = F.sequence(F.lit(0), F.size(lines) - 1)
    mark = lambda numbers, kept: F.transform(numbers, lambda i: F.struct(i.alias("i"), F.lit(kept).alias("kept")))
    marked = F.array_sort(F.concat(mark(F.array_except(every, gone), True), mark(F.array_intersect(every, gone), False)))
    kept = F.zip_with(lines, marked, lambda line, m: F.when(m["kept"], line))
    return F.when(gone.isNull(), text).otherwise(F.array_join(F.array_compact(kept), "\n"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75) -> DataFrame:
    """docs, all columns, without later matches of lines; with `lines_removed`, numbers from 0, ascending.

    Lines are parted by newlines. A line without words stays. Rows come by id (an
    integer; null first), then by a digest of the text; rows equal in both are one
    document, whose lines are treated alike. A null text stays null, an empty one
    empty; a text that loses all lines is empty. A column named lines_removed
    gives way. An empty table gives an empty one.
    """
    own = docs.drop("lines_removed").withColumn("__digest", F.xxhash64(F.col(text_col)))
    gone = duplicate_lines(own.select(F.col(id_col).cast("long").alias("id"), F.col("__digest").alias("digest"), F.col(text_col).alias("text")), width, percent)
    gone = gone.withColumnRenamed("id", "__id").withColumnRenamed("digest", "__d").withColumnRenamed("lines", "__lines")
    out = own.join(gone, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__digest") == F.col("__d")), "left")
    cleaned = [kept_text(F.col(c), F.col("__lines")).alias(c) if c == text_col else F.col(c) for c in docs.columns if c != "lines_removed"]
    return out.select(*cleaned, F.coalesce(F.array_sort("__lines"), F.array().cast("array<int>")).alias("lines_removed"))
