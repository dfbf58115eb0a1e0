"""Approximate nearest neighbours by learned partitions.

On a bounded sample, the graph of nearest neighbours is cut into parts of equal
size with few edges between them (recursive bisection: a spectral order split at
its middle, then swaps that save edges). A small network learns, from a vector
alone, the parts in which its neighbours lie. Every row is filed under its most
probable part; a query goes to as many of its most probable parts as the sample
shows are needed for RECALL, and all rows there are ranked by the exact measure.

Parts are split into blocks of bounded size by a digest of the id, so a part that
holds a third of all rows (equal vectors, say) is many tasks' work. Queries come
to blocks in bounded lots too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .scratch import Scratch

#: Rows that the index is fitted on at most, parts (a power of 2), neighbours in the graph, hidden units.
SAMPLE, PARTS, NEAR, HIDDEN = 4096, 16, 12, 64
#: Mean share of the MEASURED nearest that the parts searched must hold, on the sample.
RECALL, MEASURED = 0.96, 20
#: Rows of one block, and queries that it meets at once.
BLOCK, LOT = 4096, 2048


@dataclass
class Index:
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: np.ndarray
    probes: int

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.maximum(x @ self.w1 + self.b1, 0) @ self.w2 + self.b2


def _neighbours(x: np.ndarray, k: int) -> np.ndarray:
    out = np.empty((len(x), k), np.int64)
    for a in range(0, len(x), 1024):
        s = x[a : a + 1024] @ x.T
        s[np.arange(len(s)), np.arange(a, a + len(s))] = -np.inf
        out[a : a + len(s)] = np.argpartition(-s, k - 1, axis=1)[:, :k]
    return out


def _bisect(nodes: np.ndarray, i: np.ndarray, j: np.ndarray, rng) -> np.ndarray:
    """Half of the nodes as True, of equal sizes, with few of the edges (i, j) between the halves."""
    n = len(nodes)
    degree = np.maximum(np.bincount(i, minlength=n), 1)
    v = rng.standard_normal(n)
    for _ in range(60):  # the second eigenvector of the random walk, by powers of half-lazy steps
        v = 0.5 * v + 0.5 * np.bincount(i, v[j], n) / degree
        v -= np.average(v, weights=degree)
        v /= np.linalg.norm(v) or 1
    side = np.zeros(n, bool)
    side[np.argsort(v, kind="stable")[n // 2 :]] = True
    for _ in range(30):  # swap the pairs whose move saves most
        across = np.bincount(i, side[i] != side[j], n)
        gain = 2 * across - degree
        a, b = np.flatnonzero(side), np.flatnonzero(~side)
        a, b = a[np.argsort(-gain[a], kind="stable")], b[np.argsort(-gain[b], kind="stable")]
        m = min(len(a), len(b), max(1, n // 50))
        good = gain[a[:m]] + gain[b[:m]] > 2
        if not good.any():
            break
        new = side.copy()
        new[a[:m][good]], new[b[:m][good]] = False, True
        if (new[i] != new[j]).sum() >= (side[i] != side[j]).sum():
            break
        side = new
    return side


def balanced_parts(near: np.ndarray, parts: int, seed: int = 7) -> np.ndarray:
    """A part for each node of the graph, all of the same size but for rounding."""
    rng = np.random.default_rng(seed)
    n, k = near.shape
    i, j = np.repeat(np.arange(n), k), near.ravel()
    i, j = np.r_[i, j], np.r_[j, i]
    part = np.zeros(n, np.int64)
    for _ in range(int(np.log2(parts))):
        new = part * 2
        for p in np.unique(part):
            own = np.flatnonzero(part == p)
            place = np.full(n, -1)
            place[own] = np.arange(len(own))
            keep = (place[i] >= 0) & (place[j] >= 0)
            new[own] += _bisect(own, place[i[keep]], place[j[keep]], rng)
        part = new
    return part


def fit(x: np.ndarray, parts: int = PARTS, seed: int = 7) -> Index:
    """The index of sampled vectors (a row each). Fewer rows than two a part: one part."""
    x = np.unique(x, axis=0)
    dim = x.shape[1]
    if len(x) < 2 * parts:
        return Index(np.zeros((dim, 1)), np.zeros(1), np.zeros((1, 1)), np.zeros(1), 1)
    near = _neighbours(x, min(NEAR, len(x) - 1))
    part = balanced_parts(near, parts)
    # soft labels: the parts of a node's neighbours and its own
    aim = np.zeros((len(x), parts))
    for c in range(near.shape[1]):
        np.add.at(aim, (np.arange(len(x)), part[near[:, c]]), 1.0)
    aim[np.arange(len(x)), part] += near.shape[1] / 2
    aim /= aim.sum(axis=1, keepdims=True)
    rng = np.random.default_rng(seed)
    scale = 1 / (np.sqrt((x**2).sum(axis=1).mean()) or 1)
    net = [rng.standard_normal((dim, HIDDEN)) * scale * 1.5, np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * 0.1, np.zeros(parts)]
    m, v = [np.zeros_like(w) for w in net], [np.zeros_like(w) for w in net]
    for step in range(1, 401):
        own = rng.integers(0, len(x), min(512, len(x)))
        h = np.maximum(x[own] @ net[0] + net[1], 0)
        z = h @ net[2] + net[3]
        p = np.exp(z - z.max(axis=1, keepdims=True))
        d = (p / p.sum(axis=1, keepdims=True) - aim[own]) / len(own)
        back = (d @ net[2].T) * (h > 0)
        for k, g in enumerate((x[own].T @ back, back.sum(axis=0), h.T @ d, d.sum(axis=0))):
            g = g + 1e-4 * net[k]
            m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.99 * v[k] + 0.01 * g**2
            net[k] = net[k] - 0.01 * (1 - step / 420) * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-9)
    index = Index(*net, parts)
    # how many parts a query needs: those before the part of each neighbour, as rows are filed
    z = index.logits(x)
    filed = z.argmax(axis=1)
    rank = np.argsort(np.argsort(-z, axis=1), axis=1)
    near = _neighbours(x, min(MEASURED, len(x) - 1))
    found = np.concatenate([rank[np.arange(len(x)), filed[near[:, c]]] for c in range(near.shape[1])])
    share = np.cumsum(np.bincount(found, minlength=parts)) / len(found)
    index.probes = int(np.searchsorted(share, RECALL) + 1)
    return index


def usable(vector: Column) -> Column:
    """Vectors that take part: no null or non-finite component, and one that isn't zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _file(index_of, queries: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of.value
        for batch in batches:
            x = _matrix(batch.column("vector"))
            if not len(x):
                continue
            z = index.logits(x)
            k = index.probes if queries else 1
            part = np.argsort(-z, axis=1, kind="stable")[:, :k]
            take = pa.array(np.repeat(np.arange(len(x)), part.shape[1]))
            yield pa.RecordBatch.from_arrays([batch.column(c).take(take) for c in ("id", "vector")] + [pa.array(part.ravel().astype(np.int32))], ["id", "vector", "part"])

    return run


def _rank(k: int):
    """Of a lot of queries and a block of rows: each query's k best, ties to the smaller id."""

    def run(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if len(queries) and len(rows):
            q, b = _matrix(queries.column("vector")), _matrix(rows.column("vector"))
            qid, bid = queries.column("id").to_numpy(), rows.column("id").to_numpy()
            order = np.argsort(bid, kind="stable")
            b, bid = b[order], bid[order]
            for a in range(0, len(q), 256):
                s = q[a : a + 256] @ b.T
                s[qid[a : a + 256, None] == bid[None, :]] = -np.inf
                least = np.partition(s, max(s.shape[1] - k, 0), axis=1)[:, max(s.shape[1] - k, 0)]
                for r in range(len(s)):
                    # all that rounding could bring among the best, then the measure itself, summed one way for all
                    near = np.flatnonzero((s[r] >= least[r] - 1e-9 * max(1.0, abs(least[r]))) & (s[r] > -np.inf)) if np.isfinite(least[r]) else np.flatnonzero(s[r] > -np.inf)
                    exact = (b[near] * q[a + r]).sum(axis=1)
                    best = np.lexsort((bid[near], -exact))[:k]
                    out_q.append(np.full(len(best), qid[a + r]))
                    out_v.append(bid[near[best]])
                    out_s.append(exact[best])
        none = np.zeros(0, np.int64)
        return pa.table({"query_id": pa.array(np.concatenate([none, *out_q])), "vec_id": pa.array(np.concatenate([none, *out_v])), "score": pa.array(np.concatenate([np.zeros(0), *out_s]))})

    return run


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", sample: int = SAMPLE, parts: int = PARTS) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query row its k rows of largest inner product found, itself left out.

    Null ids, vectors that are null, zero, or hold null or non-finite components,
    and vectors of another length than most of the sample take no part. Of rows
    with one id the least vector counts. Ties go to the smaller id. No usable
    rows: an empty table. Columns beside the two named are read for is_query only.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "ann")
    v = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector_col))).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("vector"), is_query.alias("is_query"))
    v = scratch.keep(v.groupBy("id").agg(F.min("vector").alias("vector"), F.max("is_query").alias("is_query")))
    fitted = v.orderBy(F.xxhash64("id"), "id").limit(sample).select("vector").toArrow().column("vector").to_pylist()
    if not fitted:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    sizes, counts = np.unique([len(x) for x in fitted], return_counts=True)
    dim = int(sizes[counts.argmax()])
    index = fit(np.array([x for x in fitted if len(x) == dim]), parts)
    index_of = spark.sparkContext.broadcast(index)
    v = v.where(F.size("vector") == dim)
    shape = "id long, vector array<double>, part int"
    rows = scratch.keep(v.select("id", "vector").mapInArrow(_file(index_of, False), shape))
    asked = scratch.keep(v.where("is_query").select("id", "vector").mapInArrow(_file(index_of, True), shape))
    blocks = rows.groupBy("part").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    lots = asked.groupBy("part").agg(F.ceil(F.count("*") / LOT).alias("lots"))
    plan = F.broadcast(blocks.join(lots, "part"))  # a row a part at most
    no = lambda n: F.sequence(F.lit(0).cast("long"), F.col(n) - 1)
    own = rows.join(plan, "part").withColumn("block", F.pmod(F.xxhash64("id"), "blocks")).withColumn("lot", F.explode(no("lots"))).select("part", "block", "lot", "id", "vector")
    came = asked.join(plan, "part").withColumn("lot", F.pmod(F.xxhash64("id"), "lots")).withColumn("block", F.explode(no("blocks"))).select("part", "block", "lot", "id", "vector")
    key = ["part", "block", "lot"]
    some = came.groupBy(*key).cogroup(own.groupBy(*key)).applyInArrow(_rank(k), "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return some.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
