"""SentencePiece encoding and decoding by a streaming Viterbi search.

The vocabulary is a public model file's pieces, never trained here. A text is
segmented so that the sum of its pieces' log probabilities is largest; these are
by Zipf's law from the pieces' rank in the file. A character that is no piece
falls back to byte pieces. Decoding joins the pieces' bytes: it gives every text
back exactly, blanks and blank marks included.

The search is a stream. Only boundaries within the longest piece's length can
still be left, so only they are kept; ids are committed as soon as the paths back
from all of them meet in one boundary. Many stretches of text run in lockstep in
numpy (`search`), whatever their length, each with its own window; `Stream` is the
same for one text that comes in portions, and takes over the few stretches that
outlive all others. What was committed never changes, so a stretch's rest is a
stretch of its own.

Where no piece can cross a place (a blank after other text, a newline), all paths
meet there whatever comes: texts are cut there beforehand, and each distinct
stretch is searched once a task (`Encoder`).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import textvec as tv

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLANK = "▁"
#: Distinct stretches that a task remembers, and how many run together; how few go on alone.
REMEMBERED, TOGETHER, FEW = 1 << 20, 1 << 14, 8
#: Bytes that stretches advance before ids are committed.
ADVANCE = 24
#: Log probabilities are whole multiples of this part of 1, so that sums are exact and ties the same everywhere.
SCORE_UNITS = 1024


class Vocabulary:
    """Pieces as bytes (a blank for the blank mark), scores, and ids of the byte pieces."""

    def __init__(self, pieces: list[tuple[int, bytes, float]], byte_ids: list[int], size: int):
        self.pieces, self.byte_ids = pieces, np.array(byte_ids, np.int32)
        self.longest = max((len(p) for _, p, _ in pieces), default=1)
        self.unknown = min((s for *_, s in pieces), default=0.0) - 10.0 * SCORE_UNITS
        self.by_bytes = {p: (i, s) for i, p, s in pieces}
        self._trie(pieces)
        # the bytes of every id, for decoding
        own = {i: p for i, p, _ in pieces} | {int(i): bytes([b]) for b, i in enumerate(byte_ids)}
        parts = [own.get(i, b"") for i in range(size)]
        self.width = np.array([len(p) for p in parts], np.int64)
        self.start = np.r_[0, np.cumsum(self.width)[:-1]]
        self.flat = np.frombuffer(b"".join(parts), np.uint8)
        #: no piece has a blank after something else, nor a newline
        self.parted = not any(b"\n" in p or b" " in p.lstrip(b" ") for _, p, _ in pieces)

    def _trie(self, pieces: list[tuple[int, bytes, float]]) -> None:
        """Nodes by a table of (node, byte), probed in turn; a node's piece and its score."""
        step: dict[int, int] = {}
        ends: dict[int, tuple[int, float]] = {}
        for i, p, s in pieces:
            node = 0
            for b in p:
                node = step.setdefault(node << 8 | b, len(step) + 1)
            ends[node] = (i, s)
        self.piece = np.full(len(step) + 1, -1, np.int32)
        self.score = np.zeros(len(step) + 1)
        for node, (i, s) in ends.items():
            self.piece[node], self.score[node] = i, s
        bits = max(4, (4 * len(step)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.edge, self.into = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        key, into = np.array(list(step), np.int64), np.array(list(step.values()), np.int32)
        cell = self._cell(key)
        while len(key):
            free = np.flatnonzero(self.edge[cell] < 0)
            one = free[np.unique(cell[free], return_index=True)[1]]
            self.edge[cell[one]], self.into[cell[one]] = key[one], into[one]
            rest = np.ones(len(key), bool)
            rest[one] = False
            key, into, cell = key[rest], into[rest], (cell[rest] + 1) & self.mask

    def _cell(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E6C63D0876A9A47) >> self.shift).astype(np.int64)

    def next(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The node after each node's byte, or -1."""
        key = node.astype(np.int64) << 8 | byte
        cell = self._cell(key)
        out = np.full(len(key), -1, np.int32)
        left = np.arange(len(key))
        while len(left):
            held = self.edge[cell[left]]
            hit = held == key[left]
            out[left[hit]] = self.into[cell[left[hit]]]
            left = left[~hit & (held >= 0)]
            cell[left] = (cell[left] + 1) & self.mask
        return out


def load(path: str = MODEL) -> Vocabulary:
    """Of a SentencePiece model file: its normal pieces, ranked by their score in it, and its byte pieces."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    byte_ids = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
    normal = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
    ranked = sorted(normal, key=lambda i: (-sp.get_score(i), i))
    scale = np.log(np.sum(1 / np.arange(1, len(ranked) + 1)))
    return Vocabulary([(i, sp.id_to_piece(i).replace(BLANK, " ").encode(), float(np.round((-np.log(r + 1) - scale) * SCORE_UNITS))) for r, i in enumerate(ranked)], byte_ids, n)


class Stream:
    """One text's search: feed() bytes of whole characters, get ids as they become certain, then finish().

    Held are the boundaries that later pieces can still leave from, and the
    paths to them back to where they meet.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.data = bytearray()  # bytes since the meeting place
        self.base = 0  # index in data of the earliest byte still needed
        self.node: dict[int, tuple[float, int, int]] = {0: (0.0, -1, -1)}  # boundary: score, the one before, id
        self.at = 0
        self.met = 0

    def feed(self, raw: bytes) -> list[int]:
        out: list[int] = []
        self.data += raw
        v, w = self.v, self.v.longest
        while self.at < len(self.data):
            lead = self.data[self.at]
            n = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            end = self.at + n
            best = None
            for start in range(max(self.met, end - w), end):
                if start in self.node and (hit := v.by_bytes.get(bytes(self.data[start:end]))):
                    score = self.node[start][0] + hit[1]
                    if best is None or score > best[0]:
                        best = (score, start, hit[0])
            if bytes(self.data[self.at : end]) not in v.by_bytes:
                score = self.node[self.at][0] + v.unknown
                if best is None or score > best[0]:
                    best = (score, self.at, -1)
            self.node[end], self.at = best, end
            if end - self.met >= 2 * w:
                out += self._commit([k for k in self.node if k > end - w])
        return out

    def _commit(self, ends: list[int]) -> list[int]:
        """Ids up to the last boundary that the paths to all `ends` share."""
        front = set(ends)
        while len(front) > 1:
            top = max(front)
            front.remove(top)
            front.add(self.node[top][1])
        meet = front.pop()
        ids, k = [], meet
        while k > self.met:
            _, before, i = self.node[k]
            ids.append([i] if i >= 0 else [int(self.v.byte_ids[b]) for b in self.data[before:k]])
            k = before
        if meet > self.met:
            for old in [k for k in self.node if k < meet]:
                del self.node[old]
            cut, self.met = meet, 0
            del self.data[:cut]
            self.at -= cut
            self.node = {k - cut: (s, b - cut, i) for k, (s, b, i) in self.node.items()}
            self.node[0] = (self.node[0][0], -1, -1)
        return [i for part in reversed(ids) for i in part]

    def finish(self) -> list[int]:
        return self._commit([self.at])


def encode_stream(vocabulary: Vocabulary, raw: bytes) -> list[int]:
    s = Stream(vocabulary)
    return s.feed(raw) + s.finish()


_LEAD = np.ones(256, np.int64)  # bytes of the character that a byte begins
_LEAD[0xC0:0xE0], _LEAD[0xE0:0xF0], _LEAD[0xF0:] = 2, 3, 4


class _Lanes:
    """Stretches in lockstep. Places count from each stretch's last commit; `at` is where it stands."""

    def __init__(self, v: Vocabulary, data: np.ndarray, start: np.ndarray, size: np.ndarray):
        self.v, self.data = v, data
        self.name, self.start, self.left = np.arange(len(start)), start.copy(), size.copy()
        self.at = np.zeros(len(start), np.int64)
        room = v.longest + 4 + ADVANCE
        self.best = np.full((len(start), room), -np.inf)
        self.back, self.made = (np.zeros((len(start), room), np.int32) for _ in range(2))
        self.best[:, 0] = 0
        self.out: list[tuple] = []  # (stretch, commit, place from its end, id)

    def _offer(self, lane: np.ndarray, width: np.ndarray, score: np.ndarray, piece: np.ndarray) -> None:
        to = self.at[lane] + width
        better = score > self.best[lane, to]
        lane, to = lane[better], to[better]
        self.best[lane, to], self.back[lane, to], self.made[lane, to] = score[better], width[better], piece[better]

    def advance(self, lane: np.ndarray) -> None:
        """One place on: all pieces from there are offered to the boundaries that they reach."""
        v = self.v
        lane = lane[self.best[lane, self.at[lane]] > -np.inf]
        base, where, left = self.best[lane, self.at[lane]], self.start[lane] + self.at[lane], self.left[lane] - self.at[lane]
        one = np.minimum(_LEAD[self.data[where]], left)
        known = np.zeros(len(lane), bool)
        live, node, depth = np.arange(len(lane)), np.zeros(len(lane), np.int32), 0
        while len(live):
            node = v.next(node, self.data[where[live] + depth])
            live, node, depth = live[node >= 0], node[node >= 0], depth + 1
            hit = v.piece[node] >= 0
            some, end = live[hit], node[hit]
            self._offer(lane[some], np.full(len(some), depth), base[some] + v.score[end], v.piece[end])
            known[some[one[some] == depth]] = True
            more = left[live] > depth
            live, node = live[more], node[more]
        self._offer(lane[~known], one[~known], base[~known] + v.unknown, np.full((~known).sum(), -1))

    def commit(self, turn: int) -> None:
        """Ids up to where all paths meet (the end, for stretches at their end), then windows move there."""
        v, n = self.v, len(self.name)
        meet = self.left.copy()
        going = np.flatnonzero(self.at < self.left)
        if len(going):
            front = self.at[going, None] + np.arange(v.longest + 4)
            reached = self.best[going[:, None], front] > -np.inf
            front = np.where(reached, front, -1)
            top = front.max(axis=1)
            front = np.where(front < 0, top[:, None], front)
            while len(apart := np.flatnonzero(front.min(axis=1) < top)):
                own = front[apart]
                high = top[apart]
                own = np.where(own == high[:, None], (high - self.back[going[apart], high])[:, None], own)
                front[apart], top[apart] = own, own.max(axis=1)
            meet[going] = top
        lane, place, rank = np.arange(n), meet.copy(), np.zeros(n, np.int64)
        while len(lane := lane[place[lane] > 0]):
            width, piece = self.back[lane, place[lane]], self.made[lane, place[lane]]
            plain = lane[piece >= 0]
            self.out.append((self.name[plain], turn, rank[plain].copy(), piece[piece >= 0]))
            rank[plain] += 1
            odd, long = lane[piece < 0], width[piece < 0]
            for j in range(1, 5):  # a character that is no piece: its bytes, from the last
                own = odd[long >= j]
                self.out.append((self.name[own], turn, rank[own].copy(), v.byte_ids[self.data[self.start[own] + place[own] - j]]))
                rank[own] += 1
            place[lane] -= width
        room = self.best.shape[1]
        after = meet[going, None] + np.arange(room)
        inside, after = after < room, np.minimum(after, room - 1)
        self.best = np.where(inside, self.best[going[:, None], after], -np.inf)
        self.back, self.made = self.back[going[:, None], after], self.made[going[:, None], after]
        self.name, self.start, self.left, self.at = self.name[going], self.start[going] + meet[going], self.left[going] - meet[going], self.at[going] - meet[going]
        if len(going) and self.at.max() + v.longest + 4 + ADVANCE > room:  # paths that don't meet: a wider window
            more = ((0, 0), (0, room))
            self.best = np.pad(self.best, more, constant_values=-np.inf)
            self.back, self.made = np.pad(self.back, more), np.pad(self.made, more)


def search(v: Vocabulary, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(how many ids each stretch of the bytes has, all ids)."""
    lanes, turn = _Lanes(v, data, start, size), 0
    while len(lanes.name) > (FEW if turn else 0):
        for _ in range(ADVANCE):
            on = np.flatnonzero(lanes.at < lanes.left)
            if not len(on):
                break
            lanes.advance(on)
            lanes.at[on] += 1
        lanes.commit(turn)
        turn += 1
    for name, a, left in zip(lanes.name.tolist(), lanes.start.tolist(), lanes.left.tolist()):
        ids = encode_stream(v, data[a : a + left].tobytes())
        lanes.out.append((np.full(len(ids), name), turn, -np.arange(len(ids)), np.array(ids, np.int32)))
    if not lanes.out:
        return np.zeros(len(start), np.int64), np.zeros(0, np.int32)
    name, rank, ids = (np.concatenate([o[k] for o in lanes.out]) for k in (0, 2, 3))
    turns = np.concatenate([np.full(len(o[0]), o[1]) for o in lanes.out])
    return np.bincount(name, minlength=len(start)), ids[np.lexsort((-rank, turns, name))].astype(np.int32)


class Encoder:
    """Encodes batches; remembers stretches by a 64-bit hash of their bytes, REMEMBERED at most.

    What a row's ids decode to is held against its bytes; should hashes ever meet,
    the row is searched again by itself.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self._forget()

    def _forget(self):
        self.key, self.slot = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.n, self.at = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.int32)

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, key: np.ndarray) -> None:
        size = end - start
        counts, ids = [], []
        for a in range(0, len(start), TOGETHER):
            n, got = search(self.v, data, start[a : a + TOGETHER], size[a : a + TOGETHER])
            counts.append(n)
            ids.append(got)
        n = np.concatenate(counts)
        self.at = np.concatenate([self.at, len(self.ids) + np.cumsum(n) - n])
        self.n = np.concatenate([self.n, n])
        self.ids = np.concatenate([self.ids, *ids])
        slot = np.concatenate([self.slot, len(self.slot) + np.arange(len(n))])
        key = np.concatenate([self.key, key])
        order = np.argsort(key)
        self.key, self.slot = key[order], slot[order]

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, each row's first): rows that aren't empty begin with a blank of their own."""
        ids, first = self._from_memory(data, bounds)
        back, at = decode(self.v, ids, first)
        if np.array_equal(back, data) and np.array_equal(at, bounds):
            return ids, first
        parts = []
        for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
            own = ids[first[k] : first[k + 1]]
            if not np.array_equal(back[at[k] : at[k + 1]], data[a:b]):
                text = np.r_[np.uint8(32), data[a:b]]
                own = search(self.v, text, np.zeros(1, np.int64), np.array([len(text)]))[1]
            parts.append(own)
        return np.concatenate(parts), np.r_[0, np.cumsum([len(x) for x in parts])]

    def _from_memory(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        filled = np.diff(bounds) > 0
        text = np.insert(data, bounds[:-1][filled], 32)
        bounds = bounds + np.r_[0, np.cumsum(filled)]
        if not len(text):
            return np.zeros(0, np.int32), np.zeros(len(bounds), np.int64)
        new = np.zeros(len(text), bool)
        if self.v.parted:
            new[1:] = ((text[1:] == 32) & (text[:-1] != 32)) | (text[1:] == 10) | (text[:-1] == 10)
        new[bounds[:-1][bounds[:-1] < len(text)]] = True
        start = np.flatnonzero(new)
        end = np.r_[start[1:], len(text)]
        key = tv.span_hash(text, start, end, lower=False)
        one, where, inverse = np.unique(key, return_index=True, return_inverse=True)
        if len(self.key) > REMEMBERED:
            self._forget()
        at = np.minimum(np.searchsorted(self.key, one), max(len(self.key) - 1, 0))
        fresh = self.key[at] != one if len(self.key) else np.ones(len(one), bool)
        if fresh.any():
            self._learn(text, start[where[fresh]], end[where[fresh]], one[fresh])
            at = np.searchsorted(self.key, one)
        slot = self.slot[at][inverse]
        n = self.n[slot]
        total = np.r_[0, np.cumsum(n)]
        pick = np.repeat(self.at[slot] - total[:-1], n) + np.arange(total[-1])
        return self.ids[pick], total[np.searchsorted(start, bounds)]


def decode(v: Vocabulary, ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, each row's first) of ids: the pieces' bytes, without each row's own blank."""
    n = v.width[ids]
    total = np.r_[0, np.cumsum(n)]
    out = v.flat[np.repeat(v.start[ids] - total[:-1], n) + np.arange(total[-1])]
    at = total[first]
    filled = np.diff(at) > 0
    return np.delete(out, at[:-1][filled]), at - np.r_[0, np.cumsum(filled)]


def _encode(vocabulary_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary_of.value)
        for batch in batches:
            for i, j, data, bounds in tv.steps(batch.column("text")):
                ids, first = encoder.encode(data, bounds)
                own = pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(ids))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in range(batch.num_columns)), own], [*batch.schema.names, "ids"])

    return run


def _decode(vocabulary_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column("ids").fill_null([])
            flat = own.flatten().to_numpy(zero_copy_only=False).astype(np.int32)
            first = np.r_[0, np.cumsum(own.value_lengths().to_numpy())].astype(np.int64)
            out, at = decode(vocabulary_of.value, flat, first)
            text = pa.StringArray.from_buffers(len(own), pa.py_buffer(at.astype(np.int32)), pa.py_buffer(out.tobytes()))
            yield pa.RecordBatch.from_arrays([*batch.columns, text], [*batch.schema.names, "decoded"])

    return run


def _fields(df: DataFrame) -> str:
    return "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema)


def encode(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """docs (all columns, `text` among them) with `ids`, array<int>; a column so named gives way.

    Null and empty texts have no ids. Each row alone decides its ids.
    """
    kept = docs.drop("ids")
    return kept.mapInArrow(_encode(docs.sparkSession.sparkContext.broadcast(load(path))), f"{_fields(kept)}ids array<int>")


def decode_ids(rows: DataFrame, path: str = MODEL) -> DataFrame:
    """rows (all columns, `ids` among them) with `decoded`: the text. Null ids are none."""
    kept = rows.drop("decoded")
    return kept.mapInArrow(_decode(rows.sparkSession.sparkContext.broadcast(load(path))), f"{_fields(kept)}decoded string")


DIGEST = "doc_id long, n_bytes long, n_ids long, ids_sha256 string, text_sha256 string, round_trip boolean"


def _digest(vocabulary_of):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary_of.value)
        for batch in batches:
            for i, j, data, bounds in tv.steps(batch.column("text")):
                ids, first = encoder.encode(data, bounds)
                out, at = decode(encoder.v, ids, first)
                raw, text, given = ids.astype("<i4").tobytes(), out.tobytes(), data.tobytes()
                f, a, b = first.tolist(), at.tolist(), bounds.tolist()
                rows = range(j - i)
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(i, j - i).cast(pa.int64()), pa.array(np.diff(bounds)), pa.array(np.diff(first)),
                    pa.array([hashlib.sha256(raw[4 * f[k] : 4 * f[k + 1]]).hexdigest() for k in rows]), pa.array([hashlib.sha256(text[a[k] : a[k + 1]]).hexdigest() for k in rows]),
                    pa.array([text[a[k] : a[k + 1]] == given[b[k] : b[k + 1]] for k in rows]),
                ], [x.split()[0] for x in DIGEST.split(", ")])

    return run


def piece_digest(docs: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, n_bytes, n_ids, ids_sha256, text_sha256, round_trip): of each text's ids (little-endian int32), and of what they decode to.

    Null and empty texts have no ids and the digests of nothing. Each row alone
    decides its values; ids may be null or repeat; an empty table gives an empty one.
    """
    return docs.select("doc_id", "text").mapInArrow(_digest(docs.sparkSession.sparkContext.broadcast(load(path))), DIGEST)
