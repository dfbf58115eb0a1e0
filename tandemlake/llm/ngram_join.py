"""Exact n-gram Jaccard join by prefix filters under several global token orders.

A document is the set of its distinct word shingles, hashed to 64 bits. Two sets
of similarity t or more share, under ANY one order of all tokens, a token among
the first n - ceil(t n) + 1 of each. Every order here puts rare tokens first
(document frequency over the whole corpus); the orders differ in how they break
ties. A pair is a candidate only if it shares such a token under every order.

How it scales:
- Tokens travel as packed bytes (6 a token), dealt out by token range; the
  number of ranges follows the corpus, so a range holds about RANGE_TOKENS. Where
  ranges are many they are dealt in two steps, so that packs stay large.
- Tokens of a large share of all documents are found first. Their number is
  bounded (sum of set sizes / (share * documents)), so they go along with the code.
- A token of one document only can't link it; a document whose prefix holds no
  other is dropped before any pair is looked at.
- Equal sets are one class from the first step on. A set is told by its 64-bit
  sum: two of n different sets are taken for one with probability n^2 / 2^65.
- Groups of near copies: a few times, each class is held against one head that
  shares some of its least tokens, and components are formed. This only finds
  links early: two sets of one component needn't be held against each other, and
  the result is the same without it.
- Sets and components that are still apart and share a prefix token are then found
  order by order, long lists in blocks; where every order has them, the set is held
  against the component's members, block by block, in one pass over their tokens.
- Token lists are bucketed by set, so that pairs come to them, not they to pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import textvec as tv
from .graph import components
from .scratch import Scratch
from .skew import bring, meet

RANGE_TOKENS = 2_000_000
BATCH_TOKENS = 2_000_000
HEAVY_SHARE = 0.01
#: Tokens of a set's sketch, how often sets are held against heads before the full search, and against how many at once.
SKETCH, ROUNDS, TRIES = 8, 2, 8
#: Rows of one token, or sets of one component, that one block holds, about.
BLOCK = 1024
#: Ranges up to which a batch is dealt in one step; more are dealt in two, by the square root.
ONE_STEP = 1024
#: Buckets that a table may have.
MOST_BUCKETS = 100_000
U64 = np.uint64


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """ceil(n * percent / 100): tokens that a set of similarity `percent` must share."""
    return (n * percent + 99) // 100


def _pack(tok: np.ndarray) -> bytes:
    return np.ascontiguousarray(tok.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpack(raw: np.ndarray) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = raw.reshape(-1, 6)
    return wide.view("<u8").ravel()


def _blob(fp, n, count, tok, code) -> bytes:
    """Sets (fp, n; 0 unknown), how many tokens of each follow, the tokens, their frequency codes."""
    return b"".join((np.uint32(len(fp)).tobytes(), fp.astype("<u8").tobytes(), n.astype("<u4").tobytes(), count.astype("<u4").tobytes(), _pack(tok), code.astype(np.uint8).tobytes()))


def _unblob(raw) -> tuple[np.ndarray, ...]:
    raw = np.frombuffer(raw, np.uint8)
    m = int(raw[:4].view("<u4")[0])
    fp, n, count = raw[4 : 4 + 8 * m].copy().view("<u8"), raw[4 + 8 * m : 4 + 12 * m].copy().view("<u4").astype(np.int64), raw[4 + 12 * m : 4 + 16 * m].copy().view("<u4").astype(np.int64)
    rest, total = raw[4 + 16 * m :], int(count.sum())
    return fp, n, count, _unpack(rest[: 6 * total]), rest[6 * total :]


def by_token(fp: np.ndarray, row: np.ndarray, tok: np.ndarray, group: np.ndarray) -> tuple[list, list]:
    """Blobs by group of tokens; row: each token's set."""
    order = np.argsort(group, kind="stable")
    row, tok, group = row[order], tok[order], group[order]
    cut = np.flatnonzero(group[1:] != group[:-1]) + 1
    keys, blobs = [], []
    for a, b in zip(np.r_[0, cut].tolist() if len(group) else [], np.r_[cut, len(group)].tolist()):
        own = row[a:b]
        new = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
        keys.append(int(group[a]))
        blobs.append(_blob(fp[own[new]], np.zeros(len(new)), np.diff(np.r_[new, b - a]), tok[a:b], np.zeros(0)))
    return keys, blobs


def by_set(fp: np.ndarray, n: np.ndarray, count: np.ndarray, tok: np.ndarray, code: np.ndarray, group: np.ndarray) -> tuple[list, list]:
    """Blobs by group of sets."""
    at = np.r_[0, np.cumsum(count)]
    order = np.argsort(group, kind="stable")
    fp, n, count, group = fp[order], n[order], count[order], group[order]
    pick = np.repeat(at[:-1][order] - np.r_[0, np.cumsum(count)[:-1]], count) + np.arange(count.sum()) if len(order) else np.zeros(0, np.int64)
    tok, code, at = tok[pick], code[pick], np.r_[0, np.cumsum(count)]
    cut = np.flatnonzero(group[1:] != group[:-1]) + 1
    keys, blobs = [], []
    for a, b in zip(np.r_[0, cut].tolist() if len(group) else [], np.r_[cut, len(group)].tolist()):
        keys.append(int(group[a]))
        blobs.append(_blob(fp[a:b], n[a:b], count[a:b], tok[at[a] : at[b]], code[at[a] : at[b]]))
    return keys, blobs


def range_of(tok: np.ndarray, ranges: int) -> np.ndarray:
    return ((tok >> U64(16)) * U64(ranges) >> U64(32)).astype(np.int64)


def _packs(keys: list, blobs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(blobs, pa.binary())], PACKS)


PACKS = ["key", "blob"]


def _deal_again(ranges: int, fan: int, sets: bool):
    """Blobs of coarse groups (keys -1, -2, ...) dealt to the ranges, or groups of sets, in them; others pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, have = [], 0

        def flush():
            fp, n, count, tok, code = (np.concatenate([h[k] for h in held]) for k in range(5))
            held.clear()
            if sets:
                return _packs(*by_set(fp, n, count, tok, code, (fp % U64(ranges)).astype(np.int64)))
            return _packs(*by_token(fp, np.repeat(np.arange(len(fp)), count), tok, range_of(tok, ranges)))

        for batch in batches:
            coarse = batch.column(0).to_numpy() < 0
            yield batch.filter(pa.array(~coarse))
            for blob in batch.column(1).filter(pa.array(coarse)):
                held.append(_unblob(blob.as_buffer()))
                have += len(held[-1][3])
                if have >= BATCH_TOKENS:
                    yield flush()
                    have = 0
        if held:
            yield flush()
        tv.release()

    return run


def again(packs: DataFrame, ranges: int, fan: int, sets: bool) -> DataFrame:
    """The second step of a deal in two: each coarse group's packs come together, then go out by range."""
    if fan == 1:
        return packs
    return packs.repartition("key").sortWithinPartitions("key").mapInArrow(_deal_again(ranges, fan, sets), "key long, blob binary")


def code_of(df: np.ndarray) -> np.ndarray:
    """A document frequency as one byte, eight steps an octave: only the order matters."""
    return np.minimum(255, np.floor(8 * np.log2(np.maximum(df, 1)))).astype(np.uint8)


def token_sets(column: pa.Array, width: int, by_line: bool = False):
    """(first row, end row, lines' firsts, 48-bit tokens, their firsts, fingerprints) of runs of rows.

    With by_line each line is a set of its own, and lines' firsts tell whose it is.
    """
    for i, j, data, bounds in tv.steps(column):
        start, end, first = tv.words(data, bounds)
        of_row = np.arange(j - i + 1)
        if by_line:
            line, _, of_row = tv.lines(data, bounds)
            first = np.append(np.searchsorted(start, line), len(start))
        tok, at = tv.distinct(*tv.shingles(tv.span_hash(data, start, end), first, width))
        yield i, j, of_row, tok >> U64(16), at, tv.row_sum(tv.mix64(tok + U64(77)), at)


def frequent(held: list[np.ndarray], share: float, sets: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens, and their counts, that half of `share` of these sets hold, and 16 at least."""
    tok, n = np.unique(np.concatenate(held), return_counts=True) if held else (np.zeros(0, U64), np.zeros(0, np.int64))
    m = n >= max(16, share / 2 * sets)
    return tok[m].view(np.int64), n[m].astype(np.int64)


def _meta(width: int, share: float, more: tuple[str, ...] = ()):
    """Rows of documents (kind 0: id, fp, n) and of locally frequent tokens (kind 1: token, count); more: longs after id and text, kept."""
    names = ["kind", "id", "fp", "n", *more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, docs = [], 0

        def heavy():
            tok, n = frequent(held, share, docs)
            m = len(tok)
            return pa.RecordBatch.from_arrays([pa.array(np.ones(m, np.int8)), pa.array(tok), pa.nulls(m, pa.int64()), pa.array(n), *(pa.nulls(m, pa.int64()) for _ in more)], names)

        for batch in batches:
            for i, j, _, tok, at, fp in token_sets(batch.column(1), width):
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(j - i, np.int8)), batch.column(0).slice(i, j - i).cast(pa.int64()), pa.array(fp.view(np.int64)), pa.array(np.diff(at)), *(batch.column(2 + k).slice(i, j - i) for k in range(len(more)))], names)
                held.append(tok)
                docs += j - i
                if sum(map(len, held)) >= BATCH_TOKENS:
                    yield heavy()
                    held, docs = [], 0
        yield heavy()

    return run


def _deal(width: int, ranges: int, fan: int, heavy: np.ndarray, heavy_code: np.ndarray):
    """Blobs of rare-enough tokens by token range, or -1 less `fan` ranges together; of sizes and heavy tokens by set (keys from `ranges` on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush():
            tok = np.concatenate([h[0] for h in held])
            n = np.concatenate([np.diff(h[1]) for h in held])
            fp = np.concatenate([h[2] for h in held])
            held.clear()
            row = np.repeat(np.arange(len(fp)), n)
            first = np.zeros(len(fp), bool)
            first[np.unique(fp, return_index=True)[1]] = True
            first &= n > 0
            keep = first[row]
            tok, row = tok[keep], row[keep]
            place = np.minimum(np.searchsorted(heavy, tok), max(len(heavy) - 1, 0))
            is_heavy = heavy[place] == tok if len(heavy) else np.zeros(len(tok), bool)
            t = tok[~is_heavy]
            group = range_of(t, ranges)
            keys, blobs = by_token(fp, row[~is_heavy], t, group if fan == 1 else -1 - group // fan)
            code = heavy_code[place[is_heavy]] if len(heavy) else np.zeros(0, np.uint8)
            some = np.flatnonzero(first)
            count = np.bincount(row[is_heavy], minlength=len(fp))[some]
            more = by_set(fp[some], n[some], count, tok[is_heavy], code, ranges + (fp[some] % U64(ranges)).astype(np.int64))
            return _packs(keys + more[0], blobs + more[1])

        for batch in batches:
            for _, _, _, tok, at, fp in token_sets(batch.column(0), width):
                held.append((tok, at, fp))
                if sum(len(h[0]) for h in held) >= BATCH_TOKENS:
                    yield flush()
        if held:
            yield flush()
        tv.release()

    return run


def _count(ranges: int, fan: int):
    """Of one token range: the tokens of two sets or more, with their frequency, dealt out by set."""

    def run(table: pa.Table) -> pa.Table:
        key, blobs = table.column("key")[0].as_py(), table.column("blob")
        if key >= ranges:
            return pa.table({"key": pa.array(np.full(len(table), key - ranges, np.int64)), "blob": blobs})
        parts = [_unblob(x.as_buffer()) for x in blobs]
        fp, count, tok = (np.concatenate([p[k] for p in parts]) for k in (0, 2, 3))
        one = np.zeros(len(fp), bool)
        one[np.unique(fp, return_index=True)[1]] = True
        keep = np.repeat(one, count)
        fp, tok = np.repeat(fp, count)[keep], tok[keep]
        order = np.argsort(tok, kind="stable")
        tok, fp = tok[order], fp[order]
        start = np.flatnonzero(np.r_[True, tok[1:] != tok[:-1]]) if len(tok) else np.zeros(0, np.int64)
        df = np.diff(np.r_[start, len(tok)])
        df = np.repeat(df, df)
        tok, fp, code = tok[df > 1], fp[df > 1], code_of(df[df > 1])
        order = np.argsort(fp, kind="stable")
        tok, fp, code = tok[order], fp[order], code[order]
        new = np.flatnonzero(np.r_[True, fp[1:] != fp[:-1]]) if len(fp) else np.zeros(0, np.int64)
        group = (fp[new] % U64(ranges)).astype(np.int64)
        keys, out = by_set(fp[new], np.zeros(len(new), np.int64), np.diff(np.r_[new, len(fp)]), tok, code, group if fan == 1 else -1 - group // fan)
        return pa.Table.from_batches([_packs(keys, out)])

    return tv.releasing(run)


def _gather(percent: int):
    """Of one group of sets: each set whose prefix holds a token of another, with its shared tokens, rare first."""

    def run(table: pa.Table) -> pa.Table:
        parts = [_unblob(x.as_buffer()) for x in table.column("blob")]
        fp, n, count, tok, code = (np.concatenate([p[k] for p in parts]) for k in range(5))
        sets, which = np.unique(fp, return_inverse=True)
        size = np.zeros(len(sets), np.int64)
        np.maximum.at(size, which, n)
        row = np.repeat(which, count)
        order = np.lexsort((tok, code, row))
        row, tok, code = row[order], tok[order], code[order]
        new = np.r_[True, (row[1:] != row[:-1]) | (tok[1:] != tok[:-1])] if len(row) else np.zeros(0, bool)
        row, tok, code = row[new], tok[new], code[new]
        have = np.bincount(row, minlength=len(sets))
        alone = size - have
        pick = np.flatnonzero((alone < size - need(size, percent) + 1) & (have > 0))
        at = np.r_[0, np.cumsum(have)]
        return pa.table({
            "fp": pa.array(sets[pick].view(np.int64)), "n": pa.array(size[pick].astype(np.int32)), "alone": pa.array(alone[pick].astype(np.int32)),
            "tok": pa.array([_pack(tok[at[k] : at[k + 1]]) for k in pick], pa.binary()), "code": pa.array([code[at[k] : at[k + 1]].tobytes() for k in pick], pa.binary()),
        })

    return tv.releasing(run)


POSTINGS = "ord int, tok long, fp long, label long, n int, rest int"


def _prefixes(percent: int, orders: int):
    """POSTINGS: the prefix tokens of each set under each order (1, 2, 4, ...); rest: how many of the set's tokens are left from there on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                toks = [_unpack(np.frombuffer(x.as_buffer(), np.uint8)) for x in part.column("tok")]
                code = np.concatenate([np.frombuffer(x.as_buffer(), np.uint8) for x in part.column("code")])
                size, alone = part.column("n").to_numpy().astype(np.int64), part.column("alone").to_numpy().astype(np.int64)
                length = size - need(size, percent) + 1 - alone
                count = np.array([len(x) for x in toks])
                row, tok = np.repeat(np.arange(len(toks)), count), np.concatenate(toks)
                place = np.arange(len(tok)) - np.repeat(np.cumsum(count) - count, count)
                inside = place < length[row]
                fp, label = part.column("fp").to_numpy(), part.column("label").to_numpy()
                for k in range(orders):
                    order = np.lexsort((tv.mix64(tok + U64(1_000_003 * k)) if k else tok, code, row))
                    take = order[inside]
                    r = row[take]
                    rest = size[r] - alone[r] - place[inside]
                    cols = (np.full(len(r), 1 << k, np.int32), tok[take].astype(np.int64), fp[r], label[r], size[r].astype(np.int32), rest.astype(np.int32))
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], [x.split()[0] for x in POSTINGS.split(", ")])

    return run


def _tries(rows: DataFrame, turn: int) -> DataFrame:
    """(a, b): sets with heads of other labels that they meet most often, from (tok, fp, label).

    In the first turn a token has one head, drawn by set, so that a group's sets
    meet under few heads, and a set one try. Later it has TRIES heads, drawn anew by
    set and token, and sets have as many tries, at smaller labels: large components
    mostly have those, so it is the sets that are left over that try.
    """
    tries, apart = (1, "label <> head_label") if turn == 0 else (TRIES, "label > head_label")
    draw = F.xxhash64(*(["fp"] if turn == 0 else ["fp", "tok"]), F.lit(turn))
    head = rows.withColumn("r", F.row_number().over(Window.partitionBy("tok").orderBy(draw, "fp"))).where(F.col("r") <= tries)
    met = rows.join(head.select("tok", F.col("fp").alias("b"), F.col("label").alias("head_label")), "tok").where(apart)
    met = met.groupBy(F.col("fp").alias("a"), "b").agg(F.count("*").alias("m"))
    most = met.groupBy("a").agg(F.slice(F.reverse(F.array_sort(F.collect_list(F.struct("m", "b")))), 1, tries).alias("x"))
    return most.select("a", F.explode("x.b").alias("b"))


def candidates(postings: DataFrame, percent: int, orders: int) -> DataFrame:
    """(fp, label, other): sets with components, of smaller labels, that they share a prefix token with under every order; from POSTINGS.

    A component is in a token's list once, with the range of its sizes, so that a
    set that is left over meets a group of near copies in one row, not in as many
    as there are copies. Lengths, and what is left after a shared token, must
    allow the similarity.
    """
    key = ["ord", "tok"]
    least, most, rest = F.min("n").alias("least"), F.max("n").alias("most"), F.max("rest").alias("left")
    lists = postings.groupBy(*key, F.col("label").alias("other")).agg(least, most, rest)
    mixed = lists.groupBy(*key).agg(F.count("*").alias("k")).where("k > 1").select(*key)
    length = (F.col("n") * 100 >= F.col("least") * percent) & (F.col("most") * 100 >= F.col("n") * percent)
    position = F.least("rest", "left") * (100 + percent) >= (F.col("n") + F.col("least")) * percent
    # of two sets the smaller one shares a token of its short prefix: one that leaves 2 t / (1 + t) of it
    short = lambda rest, n: F.col(rest) * (100 + percent) >= F.col(n) * (2 * percent)
    own, lists = postings.join(mixed, key, "left_semi"), lists.join(mixed, key, "left_semi")
    met = meet(own.where(short("rest", "n")), lists, key, BLOCK).union(meet(own.where(~short("rest", "n")), lists.where(short("left", "least")), key, BLOCK))
    met = met.where((F.col("label") > F.col("other")) & length & position)
    pair = met.groupBy("fp", "label", "other").agg(F.bit_or("ord").alias("all"))
    return pair.where(F.col("all") == (1 << orders) - 1).select("fp", "label", "other")


def _verify(percent: int):
    """Of pairs with both token lists: those of the wanted similarity. Tokens of one set only can't be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(k).to_numpy().astype(np.int64) for k in ("na", "nb"))
            both = np.array([len(np.intersect1d(_unpack(np.frombuffer(x.as_buffer(), np.uint8)), _unpack(np.frombuffer(y.as_buffer(), np.uint8)), assume_unique=True)) for x, y in zip(batch.column("ta"), batch.column("tb"))], np.int64)
            good = pa.array(100 * both >= percent * (na + nb - both))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], ["a", "b"])

    return run


def sketch_of(turn: int):
    """(tok, fp): of each set the SKETCH shared tokens that come first in an order drawn for this turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toks = [_unpack(np.frombuffer(x.as_buffer(), np.uint8)) for x in batch.column("tok")]
            if turn:
                toks = [t[np.argsort(tv.mix64(t + U64(7_000_003 * turn)))] for t in toks]
            toks = [(t if turn else np.sort(t))[:SKETCH] for t in toks]
            fp = np.repeat(batch.column("fp").to_numpy(), [len(x) for x in toks])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(toks).astype(np.int64) if toks else np.zeros(0, np.int64)), pa.array(fp)], ["tok", "fp"])

    return run


def _labelled(rows: DataFrame, group: DataFrame | None) -> DataFrame:
    """rows with the component of their set, at first the set itself."""
    if group is None:
        return rows.withColumn("label", F.col("fp"))
    return rows.join(group.withColumnRenamed("v", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))


def links_of(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of the wanted similarity; a set of very many pairs is in many tasks."""
    left = sets.select(F.col("fp").alias("a"), F.col("n").alias("na"), F.col("tok").alias("ta"))
    right = sets.select(F.col("fp").alias("b"), F.col("n").alias("nb"), F.col("tok").alias("tb"))
    return bring(bring(pairs.select("a", "b"), "a", "b", left), "b", "a", right).mapInArrow(_verify(percent), "a long, b long")


def _across(percent: int):
    """Of sets (side 0) and members (side 1) of the components that they met: a link of each set and component, if there is one."""

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        fp, n, side = table.column("fp").to_numpy(), table.column("n").to_numpy().astype(np.int64), table.column("side").to_numpy()
        met = np.unique(table.column("other").to_numpy(), return_inverse=True)[1]
        toks = [_unpack(np.frombuffer(x.as_buffer(), np.uint8)) for x in table.column("tok")]
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        out_a, out_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for few in np.split(np.arange(met.max() + 1), np.arange(1 << 15, met.max() + 1, 1 << 15)):  # component and token in one word
            own = right[(met[right] >= few[0]) & (met[right] <= few[-1])]
            if not len(own):
                continue
            word = np.concatenate([toks[k] | U64(int(met[k] - few[0]) << 48) for k in own])
            owner = np.repeat(np.arange(len(own)), [len(toks[k]) for k in own])
            order = np.argsort(word, kind="stable")
            word, owner = word[order], owner[order]
            for k in left[(met[left] >= few[0]) & (met[left] <= few[-1])].tolist():
                mine = np.sort(toks[k]) | U64(int(met[k] - few[0]) << 48)
                lo, hi = np.searchsorted(word, mine, "left"), np.searchsorted(word, mine, "right")
                many = hi - lo
                both = np.bincount(owner[np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())], minlength=len(own))
                good = np.flatnonzero((both > 0) & (100 * both >= percent * (n[k] + n[own] - both)))
                out_a.append(fp[k : k + 1][: len(good)])
                out_b.append(fp[own[good[:1]]])
        return pa.table({"a": pa.array(np.concatenate(out_a)), "b": pa.array(np.concatenate(out_b))})

    return tv.releasing(run)


def links_across(pairs: DataFrame, marked: DataFrame, percent: int) -> DataFrame:
    """(a, b): for each set and component (fp, other) that link a link, from the sets (fp, n, tok, label).

    Sets and members meet in units of a block of each; small components share units.
    """
    sizes = pairs.groupBy("other").agg(F.count("*").alias("l")).join(marked.groupBy(F.col("label").alias("other")).agg(F.count("*").alias("r")), "other")
    small = (F.col("l") < BLOCK / 16) & (F.col("r") < BLOCK / 16)
    plan = sizes.select("other", small.alias("small"), F.ceil(F.col("l") / BLOCK).alias("l"), F.ceil(F.col("r") / BLOCK).alias("r"))
    units = F.lit(max(1, pairs.count() * 16 // BLOCK))
    unit = lambda i, j: F.when(F.col("small"), F.struct(F.lit(None).cast("long").alias("o"), F.pmod(F.xxhash64("other"), units).alias("i"), F.lit(0).cast("long").alias("j"))).otherwise(F.struct(F.col("other").alias("o"), i.alias("i"), j.alias("j")))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    mine = bring(pairs.select("fp", "other"), "fp", "other", marked.select("fp", "n", "tok")).join(plan, "other").withColumn("j", every("r"))
    mine = mine.select(unit(F.pmod(F.xxhash64("fp"), "l"), F.col("j")).alias("unit"), F.lit(0).alias("side"), "other", "fp", "n", "tok")
    theirs = marked.select(F.col("label").alias("other"), "fp", "n", "tok").join(plan, "other").withColumn("i", every("l"))
    theirs = theirs.select(unit(F.col("i"), F.pmod(F.xxhash64("fp"), "r")).alias("unit"), F.lit(1).alias("side"), "other", "fp", "n", "tok")
    return mine.union(theirs).groupBy("unit").applyInArrow(_across(percent), "a long, b long")


def shared_tokens(texts: DataFrame, meta: DataFrame, count: int, tokens: int, width: int, percent: int, share: float, scratch: Scratch) -> DataFrame:
    """The sets whose prefix holds a token of another: (fp, n, alone, tok, code), bucketed by fp.

    texts: one column. meta: rows of kind 1 have locally frequent tokens (id, n).
    tok: the set's tokens that other sets hold, rarest first; alone: how many it
    has to itself.
    """
    ranges = max(12, -(-tokens // RANGE_TOKENS))
    fan = 1 if ranges <= ONE_STEP else int(np.ceil(np.sqrt(ranges)))
    # at most 2 * tokens / (share * sets) rows: bounded whatever the corpus' size
    rows = meta.where("kind = 1").groupBy("id").agg(F.sum("n").alias("n")).where(F.col("n") >= F.lit(share / 2 * count)).orderBy("id").toPandas()
    heavy, heavy_code = rows["id"].to_numpy(np.int64).view(U64), code_of(rows["n"].to_numpy(np.int64))
    dealt = again(texts.mapInArrow(_deal(width, ranges, fan, heavy, heavy_code), "key long, blob binary"), ranges, fan, False)
    own = again(dealt.groupBy("key").applyInArrow(_count(ranges, fan), "key long, blob binary"), ranges, fan, True)
    sets = own.groupBy("key").applyInArrow(_gather(percent), "fp long, n int, alone int, tok binary, code binary")
    return scratch.bucketed(sets, "fp", min(ranges, MOST_BUCKETS))


def _grouped(source: DataFrame, width: int, percent: int, orders: int, heavy_share: float) -> tuple[DataFrame, DataFrame]:
    """Of (id, text, more longs): its rows as (id, fp, n, more), and (v, label) of the sets that link with another."""
    more = tuple(source.columns[2:])
    scratch = Scratch(source.sparkSession, "ngram_join")
    meta = scratch.keep(source.mapInArrow(_meta(width, heavy_share, more), ", ".join(["kind tinyint, id long, fp long, n long", *(f"{c} long" for c in more)])))
    own = meta.where("kind = 0")
    total = own.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    sets = shared_tokens(source.select("text"), meta, total.docs, total.tokens, width, percent, heavy_share, scratch)

    # near copies first: each set against a few heads of its sketch's buckets, a few times over
    links, group = None, None
    for turn in range(ROUNDS):
        sketch = _labelled(sets.select("fp", "tok").mapInArrow(sketch_of(turn), "tok long, fp long"), group)
        new = scratch.keep(links_of(_tries(scratch.keep(sketch), turn), sets, percent))
        links = new if links is None else links.union(new)
        if not new.limit(1).count():
            break
        group = components(links, scratch)

    # then all sets and components that are still apart and share a prefix token under every order
    marked = _labelled(sets, group)
    postings = scratch.keep(marked.mapInArrow(_prefixes(percent, orders), POSTINGS))
    found = links_across(scratch.keep(candidates(postings, percent, orders)), marked, percent)
    group = components(found if links is None else links.union(found), scratch)
    scratch.clear(meta, group)
    return own, group


def ngram_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, orders: int = 3, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """Documents with their set size and component: (doc_id, n_shingles, component_id, set_id).

    docs: any columns beside the id (an integer) and the text; others aren't read.
    Words are runs of bytes other than blank and 9 to 13, A-Z lower-cased. A text
    of fewer than `width` words has its whole sequence as its one token. Two texts
    link when 100 * shared >= percent * union; component_id is the least id that
    links reach. A null or wordless text has size 0, links with nothing and is its
    own component. Repeated rows each give a row. A null id stays null and doesn't
    count in the minimum (a component of null ids only has null). An empty table
    gives an empty one. set_id tells sets apart (equal texts, equal set_id).
    """
    own, group = _grouped(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), width, percent, orders, heavy_share)
    least = own.where("n > 0").groupBy("fp").agg(F.min("id").alias("least"))
    classes = least.join(group.withColumnRenamed("v", "fp"), "fp", "left").withColumn("label", F.coalesce("label", "fp"))
    of_label = classes.groupBy("label").agg(F.min("least").alias("component_id"))
    classes = classes.join(of_label, "label").select("fp", "component_id")
    out = own.where("n > 0").join(classes, "fp").select("id", "n", "component_id", "fp")
    none = own.where("n = 0").select("id", "n", F.col("id").alias("component_id"), F.lit(None).cast("long").alias("fp"))
    return out.union(none).select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.col("fp").alias("set_id"))


def first_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 75, orders: int = 3, heavy_share: float = HEAVY_SHARE) -> DataFrame:
    """(no_id, id, digest): of each component of texts with words its first row, as row_key names it.

    Components as in ngram_components, but told by their sets, so null and
    repeated ids don't join texts that don't link. The least id is first, null
    last; of one id the least digest. Rows equal in id and text have one key.
    """
    key = row_key(F.col(id_col), F.col(text_col))
    own, group = _grouped(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), key[2]), width, percent, orders, heavy_share)
    least = own.where("n > 0").groupBy("fp").agg(F.min(F.struct(*row_key(F.col("id")), "digest")).alias("least"))
    return _labelled(least, group).groupBy("label").agg(F.min("least").alias("least")).select("least.*")


def row_key(doc_id: Column, text: Column | None = None) -> list[Column]:
    """no_id, id (0 for null), digest of the text: without nulls, so that keys compare as they are."""
    key = [doc_id.isNull().alias("no_id"), F.coalesce(doc_id.cast("long"), F.lit(0)).alias("id")]
    return key if text is None else [*key, F.xxhash64(text).alias("digest")]
