"""Most similar vectors for every vector: vantage-point trees per shard.

A small tree fitted on a bounded sample splits the vectors into shards; each shard builds its own tree
over all its vectors. A ball around a vantage point splits a node; a query enters the near side, and the
far side too if it is within `factor` times its search radius of the border. Factor 1 is the triangle
inequality and restores exact search; smaller factors leave out far sides that rarely hold a neighbour.
Trees are walked by blocks of queries, one matrix product per node.

Vectors that are copies of each other are one vector in the trees and are put back afterwards, each with
the smallest ids of its copies, so that a group of copies costs no more than its size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import cut

#: What the shard tree is fitted on: at least SAMPLE vectors, SAMPLE_SHARD for each shard, at most MAX_SAMPLE (67 MB). Every vector is indexed.
SAMPLE, SAMPLE_SHARD, MAX_SAMPLE = 8192, 64, 262_144
#: Vectors a shard may hold (64 MB of 64 floats), and levels of the shard tree from which all executors have work.
SHARD_VECTORS, MIN_LEVELS = 250_000, 5
LEAF = 256
_GRID = 1e5  # vectors equal on this grid are copies
_CANDIDATES = 8


def _matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Rows of a binary column as float32."""
    return np.frombuffer(b"".join(col.to_pylist()), dtype=np.float32).reshape(-1, dim)


def _binary(x: np.ndarray) -> pa.Array:
    x = np.ascontiguousarray(x, dtype=np.float32)
    w = x.shape[1] * 4
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(w), len(x), [None, pa.py_buffer(x.tobytes())]).cast(pa.binary())


def usable(vectors: DataFrame, dim: int) -> DataFrame:
    """(id, key, vec) of vectors (id, embedding) with dim finite floats that are not all zero, scaled to length 1; key is equal for copies."""
    mix = np.random.default_rng(11).integers(1, 2**62, dim, dtype=np.int64) * 2 + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, emb = b.column(0), b.column(1)
            n = np.asarray(emb.value_lengths().fill_null(0))
            full = np.flatnonzero((n == dim) & np.asarray(ids.is_valid()))
            if not len(full):
                continue
            x = np.asarray(emb.take(pa.array(full)).flatten().cast(pa.float64()).fill_null(np.nan)).reshape(-1, dim)
            with np.errstate(over="ignore", invalid="ignore"):
                scale = np.abs(x).max(axis=1)
                ok = np.isfinite(scale) & (scale > 0)
                x, full = x[ok] / scale[ok][:, None], full[ok]
            if not len(full):
                continue
            x /= np.sqrt((x * x).sum(axis=1))[:, None]
            key = (np.rint(x * _GRID).astype(np.int64) * mix).sum(axis=1)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(full)).cast(pa.int64()), pa.array(key), _binary(x)], ["id", "key", "vec"])

    return vectors.select("id", "embedding").mapInArrow(run, "id bigint, key bigint, vec binary")


def _vantage(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The point from which the distances to x spread most: of some members and the principal axis."""
    some = x[rng.choice(len(x), min(len(x), 1024), replace=False)]
    axis = np.linalg.eigh(some.T.astype(np.float64) @ some)[1][:, -3:].T.astype(np.float32)
    mean = some.mean(axis=0, keepdims=True)
    norm = float(np.linalg.norm(mean))
    cand = np.concatenate([some[:_CANDIDATES], axis, mean / norm if norm > 1e-6 else mean[:0]])
    return cand[np.argmax(_dist(some, cand).std(axis=0))]


def _dist(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (x @ y.T), 0))


def shard_tree(x: np.ndarray, levels: int) -> list[tuple[np.ndarray, float] | None]:
    """A heap of (vantage point, radius): node i has children 2i+1 (inside) and 2i+2; None passes all inside."""
    rng = np.random.default_rng(5)
    heap: list = [None] * (2**levels - 1)
    todo = [(0, x)]
    while todo:
        i, part = todo.pop()
        if i >= len(heap) or len(part) < 4:
            continue
        v = _vantage(part, rng)
        d = _dist(part, v[None])[:, 0]
        r = float(np.median(d))
        heap[i] = (v, r)
        todo += [(2 * i + 1, part[d < r]), (2 * i + 2, part[d >= r])]
    return heap


def route(heap: list, levels: int, x: np.ndarray, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shard, home) of all shards within reach of each row of x; home marks the one it belongs to."""
    out = []
    todo = [(0, 0, np.arange(len(x)), np.ones(len(x), bool))]
    while todo:
        i, level, rows, home = todo.pop()
        if not len(rows):
            continue
        if level == levels:
            out.append((rows, np.full(len(rows), i - (2**levels - 1), np.int64), home))
        elif heap[i] is None:
            todo.append((2 * i + 1, level + 1, rows, home))
        else:
            v, r = heap[i]
            d = _dist(x[rows], v[None])[:, 0]
            into = d < r
            near, far = d - reach[rows] < r, d + reach[rows] >= r
            todo += [(2 * i + 1, level + 1, rows[near], (home & into)[near]), (2 * i + 2, level + 1, rows[far], (home & ~into)[far])]
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return tuple(np.concatenate(c) for c in zip(*out))  # type: ignore[return-value]


class ShardTree:
    """A vantage-point tree over the rows of x."""

    def __init__(self, x: np.ndarray, seed: int = 3):
        self.x = x
        rng = np.random.default_rng(seed)
        self.root = self._build(np.arange(len(x)), rng, 0)

    def _build(self, rows: np.ndarray, rng: np.random.Generator, depth: int):
        if len(rows) <= LEAF or depth > 40:
            return rows
        part = self.x[rows]
        v = _vantage(part, rng)
        d = _dist(part, v[None])[:, 0]
        r = float(np.median(d))
        into = d < r
        if not into.any() or into.all():
            return rows
        return v, r, self._build(rows[into], rng, depth + 1), self._build(rows[~into], rng, depth + 1)

    def leaves(self, q: np.ndarray, reach: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(query rows, leaf rows) of all leaves within reach."""
        todo = [(self.root, np.arange(len(q)))]
        while todo:
            node, rows = todo.pop()
            if not len(rows):
                continue
            if isinstance(node, np.ndarray):
                for lo in range(0, len(rows), 4096):
                    yield rows[lo : lo + 4096], node
                continue
            v, r, inner, outer = node
            d = _dist(q[rows], v[None])[:, 0]
            todo += [(inner, rows[d - reach[rows] < r]), (outer, rows[d + reach[rows] >= r])]

    def search(self, q: np.ndarray, qid: np.ndarray, xid: np.ndarray, k: int, radius: np.ndarray, factor: float, min_cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, row of x, cosine): up to k rows nearest to each query, itself (equal id) left out, within min_cosine."""
        best = np.full((len(q), k), -2.0, np.float32)
        who = np.full((len(q), k), -1, np.int64)

        def take(rows: np.ndarray, leaf: np.ndarray) -> None:
            s = q[rows] @ self.x[leaf].T
            s[qid[rows][:, None] == xid[leaf][None]] = -2
            good = np.flatnonzero((s > np.maximum(best[rows, -1], min_cosine - 1e-6)[:, None]).any(axis=1))
            if not len(good):
                return
            rows, s = rows[good], s[good]
            both = np.concatenate([best[rows], s], axis=1)
            names = np.concatenate([who[rows], np.broadcast_to(leaf, s.shape)], axis=1)
            top = np.argsort(-both, axis=1, kind="stable")[:, :k] if both.shape[1] <= 2 * k else None
            if top is None:
                part = np.argpartition(-both, k - 1, axis=1)[:, :k]
                top = np.take_along_axis(part, np.argsort(-np.take_along_axis(both, part, 1), axis=1, kind="stable"), 1)
            best[rows], who[rows] = np.take_along_axis(both, top, 1), np.take_along_axis(names, top, 1)

        open_ = np.isinf(radius)
        if open_.any():  # the leaf a query falls into gives it a first radius
            rows = np.flatnonzero(open_)
            for sub, leaf in self.leaves(q[rows], np.zeros(len(rows))):
                take(rows[sub], leaf)
            kth = np.where(best[:, -1] > -2, np.sqrt(np.maximum(2 - 2 * best[:, -1], 0)), 2.0)
            radius = np.where(open_, kth, radius)
            best[rows], who[rows] = -2, -1
        for rows, leaf in self.leaves(q, factor * radius):
            take(rows, leaf)
        row, at = np.nonzero((who >= 0) & (best >= min_cosine - 1e-6))
        return row, who[row, at], best[row, at]


def _search_shards(routed: DataFrame, shards: int, dim: int, k: int, factor: float, min_cosine: float, home_queries: bool) -> DataFrame:
    """(q, n, cosine) from (shard, id, vec, radius): rows with a null radius are the shard's vectors, the others its queries."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        ids = np.asarray(t["id"].combine_chunks())
        x = _matrix(t["vec"], dim)
        radius = np.asarray(t["radius"].combine_chunks().fill_null(np.nan))
        base = np.isnan(radius)
        tree = ShardTree(x[base])
        if home_queries:
            q, qid, qr = x, ids, np.where(base, math.sqrt(max(0.0, 2 - 2 * min_cosine)) if min_cosine > -1 else np.inf, radius)
        else:
            q, qid, qr = x[~base], ids[~base], radius[~base]
        if not base.any() or not len(q):
            row, at, cos = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.float32)
        else:
            row, at, cos = tree.search(q, qid, ids[base], k, qr, factor, min_cosine)
        return pa.table({"q": qid[row], "n": ids[base][at], "cosine": cos.astype(np.float64)})

    # a partition per shard and more, so that no task takes many shards
    return routed.repartition(2 * shards, "shard").groupBy("shard").applyInArrow(run, "q bigint, n bigint, cosine double")


def _routed(vectors: DataFrame, heap: list, levels: int, dim: int, mode: str, reach: float) -> DataFrame:
    """Rows (shard, id, vec, radius) for vectors (id, vec[, radius]): 'home' the vectors, 'away' queries for the other shards, 'query' for the home shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = _matrix(b.column("vec"), dim)
            radius = np.asarray(b.column("radius")) if "radius" in b.schema.names else np.full(len(x), np.inf)
            band = np.zeros(len(x)) if mode in ("home", "query") else reach * np.where(np.isinf(radius), 2.0, radius)
            row, shard, home = route(heap, levels, x, band)
            if mode == "away":
                row, shard = row[~home], shard[~home]
            else:
                row, shard = row[home], shard[home]
            take = pa.array(row)
            r = pa.nulls(len(row), pa.float64()) if mode == "home" else pa.array(radius[row], pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(shard), b.column("id").take(take), b.column("vec").take(take), r], ["shard", "id", "vec", "radius"])

    return vectors.mapInArrow(run, "shard bigint, id bigint, vec binary, radius double")


def _top(hits: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("cosine"), "n")
    return hits.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")


def nearest(base: DataFrame, queries: DataFrame | None, k: int, factor: float, dim: int = 64, min_cosine: float = -2.0) -> DataFrame:
    """(q, n, cosine): for each query its up to k nearest different rows of base with at least min_cosine.

    base and queries: (id, vec) of unit vectors without copies, ids from one space; queries None: all of
    base. With a min_cosine below -1 the radius of a query is the distance of its k-th neighbour in its
    home shard; else no radius is larger than that of min_cosine, and one pass suffices.
    """
    n = base.count()
    levels = max(MIN_LEVELS, math.ceil(math.log2(max(n, 1) / SHARD_VECTORS)))
    size = min(MAX_SAMPLE, max(SAMPLE, SAMPLE_SHARD * 2**levels))
    sample = base.orderBy(F.xxhash64("id"), "id").limit(size).select("vec").toArrow()["vec"]
    heap = shard_tree(_matrix(sample, dim), levels) if len(sample) else [None] * (2**levels - 1)
    home = _routed(base, heap, levels, dim, "home", 0.0)
    if min_cosine > -1:
        limit = math.sqrt(max(0.0, 2 - 2 * min_cosine))
        asked = (base if queries is None else queries).select("id", "vec", F.lit(limit).alias("radius"))
        parts = home.unionByName(_routed(asked, heap, levels, dim, "away", factor))
        if queries is not None:
            parts = parts.unionByName(_routed(asked, heap, levels, dim, "query", 0.0))
        return _top(_search_shards(parts, 2**levels, dim, k, factor, min_cosine, queries is None), k)
    asked = base if queries is None else queries
    first = home.unionByName(_routed(asked.select("id", "vec"), heap, levels, dim, "query", 0.0))
    near = cut(_search_shards(first, 2**levels, dim, k, factor, min_cosine, False))
    kth = near.groupBy("q").agg(F.count("*").alias("c"), F.min("cosine").alias("m"))
    radius = F.when(F.col("c") >= k, F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("m")))).otherwise(2.0)
    known = asked.select("id", "vec").join(kth.select(F.col("q").alias("id"), radius.alias("radius")), "id", "left").select("id", "vec", F.coalesce("radius", F.lit(2.0)).alias("radius"))
    far = _search_shards(home.unionByName(_routed(known, heap, levels, dim, "away", factor)), 2**levels, dim, k, factor, min_cosine, False)
    return _top(near.unionByName(far), k)


def similar(vectors: DataFrame, k: int, factor: float, dim: int = 64, min_cosine: float = -2.0, ask=None) -> DataFrame:
    """(id, neighbour, cosine): for every usable vector (id, embedding) the up to k most similar others.

    ask: a condition on id that selects the queries; all vectors are searched. Ties go to the smaller id.
    Vectors that are null, of another length, all zero or not finite take no part; length does not matter.
    """
    rows = usable(vectors, dim)
    reps = cut(rows.groupBy("key").agg(F.min("id").alias("id"), F.first("vec").alias("vec"), F.min("id").alias("lo"), F.max("id").alias("hi")))
    twin = reps.where("lo <> hi").select("key", F.col("id").alias("rep"))
    members = cut(rows.select("id", "key").join(twin, "key").select("rep", "id").distinct())
    w = Window.partitionBy("rep").orderBy("id")
    heads = members.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).groupBy("rep").agg(F.sort_array(F.collect_list("id")).alias("copies"))
    base = reps.select("id", "vec")
    asked = None
    if ask is not None:
        wanted = members.where(ask).select(F.col("rep").alias("id")).distinct()
        asked = base.where(ask).unionByName(base.where(~ask).join(wanted, "id", "left_semi"))
    near = nearest(base, asked, k, factor, dim, min_cosine)
    # copies of the neighbours, then of the query
    hits = near.join(heads.select(F.col("rep").alias("n"), "copies"), "n", "left").select("q", F.explode(F.coalesce("copies", F.array("n"))).alias("n"), "cosine")
    own = heads.select(F.col("rep").alias("q"), F.explode("copies").alias("n"), F.lit(1.0).alias("cosine"))
    hits = _top(hits.unionByName(own), k + 1)  # one more than asked, as each copy leaves out itself
    ids = members.select(F.col("rep").alias("q"), "id")
    hits = hits.join(ids, "q", "left").select(F.coalesce("id", "q").alias("id"), F.col("n").alias("neighbour"), "cosine").where("id <> neighbour")
    if ask is not None:
        hits = hits.where(ask)
    w = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return hits.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
