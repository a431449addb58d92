"""Approximate nearest neighbours by inner product: a vantage-point tree in each shard.

One more coordinate, sqrt(M^2 - |x|^2) with M the largest norm, puts all vectors
on a sphere, where the largest inner product is the smallest distance and the
triangle inequality holds.  Shards are the vectors nearest to each of some
sampled pivots; a shard that is too large is dealt into several.  A query first
searches the shard of its own pivot, which tells how near its k-th neighbour is
at least, and then only those shards whose span of distances to their pivot can
hold anything nearer.  In a task a shard's vectors come first and build its
tree, and the queries stream past it in batches: no vector is copied for the
queries' sake.  A branch, and likewise a shard, is left out when ``factor``
times the least distance it can hold exceeds the distance of the k-th best so
far: at factor 1 nothing nearer can be missed, above it the search gets faster
and approximate.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.staging import stage

#: Slack for rounding in distances, relative to the sphere's radius.
SLACK = 1e-6
#: Bytes of vectors in a shard; pivots, at most, whatever the table (more vectors make larger shards, which are then dealt out).
SHARD_BYTES, MOST_PIVOTS = 1 << 25, 4096
#: Queries that descend a tree together.
TOGETHER = 1024
#: Vectors in a leaf, and pairs that are scored exactly at once.
LEAF, PAIRS = 512, 200_000


@dataclass
class Node:
    """A vantage point with its inner and outer branch and the span of distances in each; or a leaf with ``rows``."""

    rows: np.ndarray
    inner: "Node | None" = None
    outer: "Node | None" = None
    spans: tuple[float, float, float, float] = field(default=(0.0, 0.0, 0.0, 0.0))


class Tree:
    """Vectors (one a row) with their ids, on the sphere of radius ``most``."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, most: float, leaf: int = LEAF):
        self.ids, self.x, self.most, self.leaf = ids, vectors, most, leaf
        self.units = (vectors / most).astype(np.float32)
        lift = np.sqrt(np.maximum(0.0, most * most - np.einsum("ij,ij->i", vectors, vectors)))
        self.lifted = np.concatenate([vectors, lift[:, None]], axis=1)
        self.root = self._build(np.arange(len(ids)))

    def _build(self, rows: np.ndarray) -> Node:
        top = Node(rows)
        open_ = [top]
        while open_:
            node = open_.pop()
            if len(node.rows) <= self.leaf:
                continue
            # the row farthest from an arbitrary one sees the others at unlike distances
            some = self.lifted[node.rows[len(node.rows) // 2]]
            away = self._distance(node.rows, some)
            point = node.rows[int(np.argmax(away))]
            d = self._distance(node.rows, self.lifted[point])
            middle = np.median(d)
            near = d < middle if (d < middle).any() else d <= middle
            if near.all():  # all at one distance: nothing to tell them apart by
                continue
            node.inner, node.outer = Node(node.rows[near]), Node(node.rows[~near])
            node.spans = (float(d[near].min()), float(d[near].max()), float(d[~near].min()), float(d[~near].max()))
            node.rows = np.array([point])
            open_ += [node.inner, node.outer]
        return top

    def _distance(self, rows: np.ndarray, to: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 * self.most * self.most - 2 * (self.lifted[rows] @ to)))

    def search(self, ids: np.ndarray, queries: np.ndarray, k: int, factor: float, known: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best for each query, best first, ties to smaller ids; the score is -inf where there are fewer.

        ``known`` are scores that k others have at least: nothing below them is looked for.
        """
        best_s = np.full((len(ids), k), -np.inf)
        best_i = np.full((len(ids), k), np.iinfo(np.int64).max)
        own = np.einsum("ij,ij->i", queries, queries) + self.most * self.most
        least_score = np.full(len(ids), -np.inf) if known is None else known
        reach = self._reach(own, least_score)
        largest = np.abs(queries).max(axis=1)
        units = queries / largest[:, None]
        length = np.linalg.norm(units, axis=1)
        units, norms = (units / length[:, None]).astype(np.float32), largest * length
        slack = SLACK * max(self.most, 1e-300)
        stack = [(self.root, np.arange(len(ids)), np.zeros(len(ids)))]
        while stack:
            node, q, least = stack.pop()
            q = q[factor * least <= reach[q] + slack]
            if not len(q):
                continue
            if node.inner is None:
                for part in range(0, len(node.rows), 1024):
                    self._offer(node.rows[part : part + 1024], ids, queries, units, norms, q, k, best_s, best_i, least_score)
                reach[q] = self._reach(own[q], np.maximum(best_s[q, -1], least_score[q]))
                continue
            d = np.sqrt(np.maximum(0.0, own[q] - 2 * (queries[q] @ self.x[node.rows[0]])))
            low, high, low2, high2 = node.spans
            to_inner = np.maximum(0.0, np.maximum(d - high, low - d))
            to_outer = np.maximum(0.0, np.maximum(d - high2, low2 - d))
            first = to_inner <= to_outer
            # the likelier branch of each half is popped first
            stack += [(node.outer, q[first], to_outer[first]), (node.inner, q[~first], to_inner[~first])]
            stack += [(node.inner, q[first], to_inner[first]), (node.outer, q[~first], to_outer[~first])]
        return best_i, best_s

    @staticmethod
    def _reach(own: np.ndarray, worst: np.ndarray) -> np.ndarray:
        """The distance of a vector that scores ``worst``."""
        none = np.isneginf(worst)
        return np.where(none, np.inf, np.sqrt(np.maximum(0.0, own - 2 * np.where(none, 0.0, worst))))

    def _offer(self, rows, ids, queries, units, norms, q, k, best_s, best_i, floor) -> None:
        """Merges a leaf's rows into the best of the queries ``q``; ``floor`` are scores below which nothing counts.

        A product of single precision finds the few rows that can count, and only these are scored exactly.
        """
        rough = units[q] @ self.units[rows].T
        # twice the rounding of a product of unit vectors, each way
        slack = np.float32(4e-7 * (self.x.shape[1] + 8))
        span = norms[q] * self.most
        bar = np.maximum(best_s[q, -1], floor[q]) / np.where(span > 0, span, 1.0)
        bar = np.where(span > 0, bar, -np.inf).clip(-2.0, 2.0).astype(np.float32) - slack
        many = np.flatnonzero((rough >= bar[:, None]).sum(axis=1) > 2 * k)
        if len(many) and len(rows) > k + 1:
            # one more than k, since a query's own row is no candidate
            bar[many] = np.maximum(bar[many], -np.partition(-rough[many], k, axis=1)[:, k] - slack)
        at, row = np.nonzero(rough >= bar[:, None])
        if not len(at):
            return
        row = rows[row]
        s = np.empty(len(at))
        for lo in range(0, len(at), PAIRS):
            # a plain sum of products, so that equal vectors score equally wherever they lie
            s[lo : lo + PAIRS] = np.einsum("ij,ij->i", queries[q[at[lo : lo + PAIRS]]], self.x[row[lo : lo + PAIRS]])
        other = self.ids[row] != ids[q[at]]
        at, s, found = at[other], s[other], self.ids[row[other]]
        met = np.unique(at)
        at = np.concatenate([np.repeat(met, k), at])
        s, found = np.concatenate([best_s[q[met]].ravel(), s]), np.concatenate([best_i[q[met]].ravel(), found])
        order = np.lexsort((found, -s, at))
        own = at[order]
        nth = np.arange(len(own)) - np.searchsorted(own, own)
        order = order[nth < k]
        best_s[q[met]], best_i[q[met]] = s[order].reshape(-1, k), found[order].reshape(-1, k)


def usable(vectors: DataFrame, ident: str, column: str) -> DataFrame:
    """(id, vec): rows with an id and a vector that is finite throughout and not zero, in double precision."""
    v = F.col(f"`{column}`").cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return vectors.where(F.col(f"`{ident}`").isNotNull()).where(fine).select(F.col(f"`{ident}`").cast("long").alias("id"), v.alias("vec"))


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as the rows of an array."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def lengths_from(pivots: np.ndarray, lift: np.ndarray, x: np.ndarray, most: float) -> np.ndarray:
    """Distances on the sphere of each row of ``x`` from each pivot."""
    own = np.sqrt(np.maximum(0.0, most * most - np.einsum("ij,ij->i", x, x)))
    return np.sqrt(np.maximum(0.0, 2 * most * most - 2 * (x @ pivots.T + own[:, None] * lift[None, :])))


def placed(rows: DataFrame, pivots, most: float) -> DataFrame:
    """``rows`` with the nearest ``pivot`` and the ``away`` from it; ``pivots`` is a broadcast of (pivots, lift) by length."""

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column(1).to_numpy()
            pivot, away = np.zeros(len(dims), np.int64), np.zeros(len(dims))
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                far = lengths_from(*pivots.value[d], matrix(batch.column(2).take(pa.array(at))), most)
                pivot[at], away[at] = far.argmin(axis=1), far.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(away)], ["id", "dim", "vec", "pivot", "away"])

    return rows.select("id", "dim", "vec").mapInArrow(nearest, "id long, dim int, vec array<double>, pivot long, away double")


def met(base: DataFrame, asked: DataFrame, k: int, factor: float, most: float) -> DataFrame:
    """(query_id, vec_id, score): the k best of each query in each shard (dim, pivot, part) that it asks.

    ``base`` has the shard, ``id`` and ``vec``; ``asked`` also ``known``, the score to beat.
    """
    shard = ["dim", "pivot", "part"]
    both = base.select(*shard, F.lit(0).alias("asks"), "id", "vec", F.lit(float("-inf")).alias("known")).unionByName(asked.select(*shard, F.lit(1).alias("asks"), "id", "vec", "known"))
    dealt = both.repartition(*shard).sortWithinPartitions(*shard, "asks", "id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, tree = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.stack([batch.column(i).to_numpy() for i in range(4)])
            edges = [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for lo, hi in zip(edges[:-1], edges[1:]):
                own, asks = tuple(codes[:3, lo].tolist()), codes[3, lo]
                if own != key:
                    key, held, tree = own, [], None
                part = batch.slice(lo, hi - lo)
                ids, x = part.column(4).to_numpy(), matrix(part.column(5))
                if not asks:
                    held.append((ids, x))
                    continue
                if tree is None and held:
                    tree, held = Tree(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]), most), []
                if tree is None:  # a shard without vectors
                    continue
                known = part.column(6).to_numpy()
                for at in range(0, len(ids), TOGETHER):
                    q = slice(at, at + TOGETHER)
                    found, score = tree.search(ids[q], x[q], k, factor, known[q])
                    good = ~np.isneginf(score.ravel())
                    columns = [np.repeat(ids[q], found.shape[1])[good], found.ravel()[good], score.ravel()[good]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["query_id", "vec_id", "score"])

    return dealt.mapInArrow(run, "query_id long, vec_id long, score double")


def search(vectors: DataFrame, ident: str = "vec_id", column: str = "embedding", every: int = 20, k: int = 20, factor: float = 1.0, shard_bytes: int = SHARD_BYTES, least_shards: int = 16) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row whose id is divisible by ``every``.

    Rows with a NULL id, and vectors that are NULL, empty, zero or hold NULL or
    non-finite parts, take no part; vectors of unlike lengths are not compared.
    Where an id repeats, its least vector counts.  A query's own id is no
    candidate; with fewer than ``k`` candidates all are returned.  Vectors of
    more than some thousand different lengths are not meant.
    """
    spark = vectors.sparkSession
    once = usable(vectors, ident, column).groupBy("id").agg(F.min("vec").alias("vec"))
    rows = stage(once.select("id", F.size("vec").alias("dim"), "vec"), "vectors")
    square = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)
    sums = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(square).alias("m")).collect()
    if not sums:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    most = math.sqrt(max(r["m"] for r in sums))
    rows_in = {r["dim"]: max(64, shard_bytes // (8 * r["dim"])) for r in sums}
    wanted = {r["dim"]: min(MOST_PIVOTS, r["n"], max(least_shards, math.ceil(r["n"] / rows_in[r["dim"]]))) for r in sums}
    # pivots are the vectors with the least hash of their id, as many as there are shards; few but these are below the cut, so no task sorts more than some thousand
    likely = {r["dim"]: min(1.0, (2 * wanted[r["dim"]] + 64) / r["n"]) for r in sums}
    cuts = spark.createDataFrame([(d, min((1 << 63) - 1, int(p * (1 << 64)) - (1 << 63))) for d, p in likely.items()], "dim int, cut long")
    low = rows.select("id", "dim", F.xxhash64("id").alias("h")).join(F.broadcast(cuts), "dim").where(F.col("h") <= F.col("cut"))
    first = Window.partitionBy("dim").orderBy("h", "id")
    ids = low.withColumn("nth", F.row_number().over(first)).select("id", "dim", "nth")
    some = rows.join(F.broadcast(ids), ["id", "dim"]).select("dim", "nth", "vec").collect()
    chosen = {}
    for d in wanted:
        own = sorted((r for r in some if r["dim"] == d and r["nth"] <= wanted[d]), key=lambda r: r["nth"])
        wanted[d] = len(own)
        x = np.array([r["vec"] for r in own], float)
        chosen[d] = (x, np.sqrt(np.maximum(0.0, most * most - np.einsum("ij,ij->i", x, x))))
    pivots = spark.sparkContext.broadcast(chosen)
    base = stage(placed(rows, pivots, most), "placed")
    # one row for each pivot: its rows, the span of their distances, and the parts it is dealt into
    shards = {(r["dim"], r["pivot"]): r for r in base.groupBy("dim", "pivot").agg(F.count(F.lit(1)).alias("n"), F.min("away").alias("low"), F.max("away").alias("high")).collect()}
    spans = {}
    for d, n in wanted.items():
        got = [shards.get((d, p)) for p in range(n)]
        spans[d] = tuple(np.array([0 if r is None else f(r) for r in got]) for f in (lambda r: r["low"], lambda r: r["high"], lambda r: math.ceil(r["n"] / rows_in[d])))
    held = spark.sparkContext.broadcast(spans)
    parts = spark.createDataFrame([(d, p, math.ceil(r["n"] / rows_in[d])) for (d, p), r in shards.items()], "dim int, pivot long, parts int")
    dealt = base.join(F.broadcast(parts), ["dim", "pivot"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    is_query = F.pmod("id", F.lit(every)) == 0
    asked = base.where(is_query).join(F.broadcast(parts), ["dim", "pivot"])
    own = asked.withColumns({"part": F.explode(F.sequence(F.lit(0), F.col("parts") - 1)), "known": F.lit(float("-inf"))})
    nearest = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = lambda df: df.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    near = stage(top(met(dealt, own, k, factor, most)), "near")
    known = near.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("known"))
    slack = SLACK * max(most, 1e-300)

    def others(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query once for each further part of a shard that can hold something as near as its k-th best."""
        for batch in batches:
            dims, pivot, score = (batch.column(i).to_numpy() for i in (1, 3, 4))
            for d in np.unique(dims).tolist():
                at = np.flatnonzero(dims == d)
                x = matrix(batch.column(2).take(pa.array(at)))
                low, high, count = held.value[d]
                far = lengths_from(*pivots.value[d], x, most)
                reach = Tree._reach(np.einsum("ij,ij->i", x, x) + most * most, score[at])
                least = np.maximum(0.0, np.maximum(far - high, low - far))
                open_ = (factor * least <= (reach + slack)[:, None]) & (count > 0)
                open_[np.arange(len(at)), pivot[at]] = False
                for lo in range(0, len(at), 256):
                    q, p = np.nonzero(open_[lo : lo + 256])
                    each = np.repeat(np.arange(len(q)), count[p])
                    part = np.arange(len(each)) - np.repeat(np.cumsum(count[p]) - count[p], count[p])
                    row = at[lo + q[each]]
                    taken = batch.take(pa.array(row))
                    yield pa.RecordBatch.from_arrays([taken.column(0), taken.column(1), taken.column(2), pa.array(p[each].astype(np.int64)), taken.column(4), pa.array(part.astype(np.int32))], ["id", "dim", "vec", "pivot", "known", "part"])

    open_ = base.where(is_query).join(known, "id", "left").select("id", "dim", "vec", "pivot", F.coalesce("known", F.lit(float("-inf"))).alias("known"))
    further = open_.mapInArrow(others, "id long, dim int, vec array<double>, pivot long, known double, part int")
    found = near.select("query_id", "vec_id", "score").unionByName(met(dealt, further, k, factor, most))
    return top(found).select("query_id", "rank", "vec_id", "score")
