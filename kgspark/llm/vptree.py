"""Nearest neighbours by vantage-point trees (Yianilos, 1993), one tree for each shard of the vectors.

Equal vectors are one point with its smallest ids. Points are dealt to cells by their nearest pivot, and a cell to
shards of bounded size. A query goes only to cells that the triangle inequality leaves open; inside a shard the tree
prunes by it as well. `relax` weakens that: a subtree is left out where `relax` times its lower bound passes the
distance to beat, so with 1 the search is exact.

A shard's points and the queries that visit it lie one after the other in a task: the tree is built, then any number of
queries streams by it. No task holds more than one shard, one batch of queries, and a bounded number of results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

_NULL = np.iinfo(np.int64).max  #: in place of a null id
_FREE = _NULL - 1  #: in place of an id where a list has no more
_PART = 256  #: queries that walk a tree together


def _open(least: np.ndarray, most: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a lower bound does not pass a distance; rounding, in proportion to the `size` of what was subtracted, never closes."""
    return least <= most * (1 + 1e-9) + 1e-12 * size


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of x to all of y: squares are added one component after the other, so that a
    pair has the same distance wherever it is computed."""
    out = np.zeros((len(x), len(y)))
    for a, b in zip(x.T, y.T, strict=True):
        d = a[:, None] - b[None, :]
        out += d * d
    return np.sqrt(out)


def pair_distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The same for each row of x and the row of y beside it, or the one row of y."""
    d = x - y
    d *= d
    return np.sqrt(np.cumsum(d, axis=1)[:, -1])


@dataclass
class _Node:
    point: int = -1  # the vantage point; -1: a leaf
    middle: float = 0.0
    inside: _Node | None = None
    outside: _Node | None = None
    rows: np.ndarray | None = None  # of a leaf


class VantageTree:
    """A tree over the rows of `x`; row i stands for the ids `ids[i]`, ascending, `_FREE` where it has fewer."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, leaf: int = 64, relax: float = 1.0):
        self.x, self.ids, self.leaf, self.relax = x, ids, leaf, relax
        self.square = np.einsum("ij,ij->i", x, x)
        self.computed = 0  # distances, for tests and figures
        self.root = self._grown(np.arange(len(x)))

    def _grown(self, rows: np.ndarray) -> _Node:
        if len(rows) <= self.leaf:
            return _Node(rows=rows)
        # the point far from an arbitrary one sees the widest spread of distances
        far = int(np.argmax(pair_distances(self.x[rows], self.x[rows[:1]])))
        point, rest = rows[far], np.delete(rows, far)
        d = pair_distances(self.x[rest], self.x[[point]])
        middle = float(np.median(d))
        near = d <= middle
        if near.all():  # all on one sphere: no split by distance
            return _Node(rows=rows)
        return _Node(int(point), middle, self._grown(rest[near]), self._grown(rest[~near]))

    def search(self, q: np.ndarray, best_d: np.ndarray, best_id: np.ndarray) -> None:
        """Betters the ascending lists `best_d`, `best_id` (one row for each query) by the tree's points."""
        self.best_d, self.best_id, self.q, self.q_square = best_d, best_id, q, np.einsum("ij,ij->i", q, q)
        self._visit(self.root, np.arange(len(q)))

    def _take(self, of: np.ndarray, rows: np.ndarray, d: np.ndarray) -> None:
        k = self.best_d.shape[1]
        close = (d <= self.best_d[of, -1:]).any(axis=1)
        of, d = of[close], d[close]
        if not len(of):
            return
        if len(rows) > k:  # no more than k points can be among the k nearest, but for ties
            nearest = np.partition(d, k - 1, axis=1)[:, k - 1]
            some = (d <= nearest[:, None]).any(axis=0)
            rows, d = rows[some], d[:, some]
        many = int((self.ids[rows] != _FREE).sum(axis=1).max())
        ids = self.ids[rows, :many].reshape(1, -1)
        new_d = np.concatenate([self.best_d[of], np.where(ids == _FREE, np.inf, np.repeat(d, many, axis=1))], axis=1)
        new_id = np.concatenate([self.best_id[of], np.broadcast_to(ids, (len(of), ids.shape[1]))], axis=1)
        order = np.lexsort((new_id, new_d), axis=-1)[:, :k]
        self.best_d[of], self.best_id[of] = np.take_along_axis(new_d, order, 1), np.take_along_axis(new_id, order, 1)

    def _leaf(self, rows: np.ndarray, of: np.ndarray) -> None:
        """Squares by a matrix product tell, up to rounding, which pairs are close enough; those are measured."""
        if not len(rows):
            return
        size = self.q_square[of][:, None] + self.square[rows][None, :]
        most = self.best_d[of, -1:]
        close = size - 2 * (self.q[of] @ self.x[rows].T) <= most * most * (1 + 1e-9) + 1e-11 * size
        a, b = np.nonzero(close)
        self.computed += close.size
        if len(a):
            d = np.full(close.shape, np.inf)
            for at in range(0, len(a), 1 << 14):
                x, y = a[at : at + (1 << 14)], b[at : at + (1 << 14)]
                d[x, y] = pair_distances(self.q[of[x]], self.x[rows[y]])
            self._take(of, rows, d)

    def _visit(self, node: _Node, of: np.ndarray) -> None:
        if not len(of):
            return
        if node.rows is not None:
            self._leaf(node.rows, of)
            return
        d = pair_distances(self.q[of], self.x[[node.point]])
        self.computed += len(d)
        self._take(of, np.array([node.point]), d[:, None])
        gap = d - node.middle
        first = gap <= 0
        for near, far, side in ((node.inside, node.outside, first), (node.outside, node.inside, ~first)):
            self._visit(near, of[side])
            # the far side lies at least |gap| away; it is open while that does not pass the distance to beat
            left = _open(self.relax * np.abs(gap[side]), self.best_d[of[side], -1], d[side] + node.middle)
            self._visit(far, of[side][left])


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of one length, as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _id_matrix(column: pa.Array, most: int) -> np.ndarray:
    out = np.full((len(column), most), _FREE, np.int64)
    for i, x in enumerate(column.to_pylist()):
        out[i, : len(x)] = x
    return out


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """`(id, v)` of the rows that take part: neither null nor zero, all components finite. A null id is the largest."""
    d = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NULL)).alias("id"), F.col(vector_col).alias("v"))
    d = d.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))))
    return d.where(F.col("v").isNotNull() & F.exists("v", lambda x: x != 0))


def points(rows: DataFrame, most: int) -> DataFrame:
    """`(key, v, ids)`: one row for each distinct vector, with its `most` smallest ids (more can never be needed)."""
    key = F.xxhash64("v")
    w = W.partitionBy("key", "v").orderBy("id")
    few = rows.select(key.alias("key"), "v", "id").withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    return few.groupBy("key", "v").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _sent_pivots(spark, sample: list, pivots: int):
    """Pivots by length of vector, as matrices; the sample is bounded by its caller."""
    by: dict[int, list] = {}
    for r in sample:
        by.setdefault(len(r["v"]), []).append(r)
    return spark.sparkContext.broadcast({n: (np.array([r["v"] for r in x]), [r["ids"] for r in x], max(1, round(pivots * len(x) / len(sample)))) for n, x in by.items()})


def nearest(vectors: DataFrame, queries: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 10, relax: float = 1.0, sample: int = 2048, shard: int = 8192, leaf: int = 64) -> DataFrame:
    """`(query_id, rank, <id_col>, score)`: for each row of `queries` its `k` nearest among `vectors`, its own id excepted.

    score is the Euclidean distance in double precision, the smallest first; equal distances by the smaller id, a null
    id last. With `relax` = 1 the result is exact; with more it is found by fewer distances and may miss some.

    Vectors that are null, zero, or hold a null or non-finite component take no part, on either side. Vectors of
    another length than the query's are not its candidates. A row that repeats both id and vector counts once; a query
    id with several vectors is searched for each of them. Fewer candidates than `k` give fewer rows, empty tables none.

    `sample` bounds the vectors that are broadcast: pivots come from them, and the distance to the nearest of them is
    each query's first bound. Every vector is indexed. A cell of very many points has as many shards as it needs.
    """
    spark = vectors.sparkSession
    most = k + 1  # the query's own id may be among them
    rows = usable(vectors, id_col, vector_col).distinct()
    asked = usable(queries, id_col, vector_col).where(F.col("id") != _NULL).distinct().withColumn("key", F.xxhash64("v"))
    p = stored(points(rows, most))
    n = p.count()
    if not n:
        return spark.createDataFrame([], f"query_id long, rank int, `{id_col}` long, score double")
    # shards are as many as keep all tasks busy, but of no more points than a task should hold
    size = min(shard, max(256, n // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))))
    few = p.where(F.pmod(F.xxhash64("key", F.lit(3)), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 0.9 * sample / n)) + 1)
    got = few.limit(sample).collect()
    kind = p.schema["v"].dataType.simpleString()
    pivots = max(1, min(len(got), 1024, n // (4 * size)))
    sent = _sent_pivots(spark, got, pivots)

    def assign(batches):
        for b in batches:
            lengths = b.column(1).value_lengths().to_numpy()
            for m in np.unique(lengths):
                c = b.filter(pa.array(lengths == m))
                cell, far = np.zeros(c.num_rows, np.int32), np.zeros(c.num_rows)
                if m in sent.value:
                    x, _, count = sent.value[m]
                    for at in range(0, c.num_rows, 1024):
                        d = distances(_matrix(c.column(1).slice(at, 1024)), x[:count])
                        cell[at : at + 1024], far[at : at + 1024] = d.argmin(axis=1), d.min(axis=1)
                yield pa.RecordBatch.from_arrays([*c.columns, pa.array(np.full(c.num_rows, m, np.int32)), pa.array(cell), pa.array(far)], names=["key", "v", "ids", "length", "cell", "far"])

    p = stored(p.mapInArrow(assign, f"key long, v {kind}, ids array<long>, length int, cell int, far double"))
    cells = p.groupBy("length", "cell").agg(F.count("*").alias("n"), F.min("far").alias("low"), F.max("far").alias("high"))
    # one row for each pivot, and one for each length of vector without a pivot: at most the sample and the lengths
    known = {(r["length"], r["cell"]): (-(-r["n"] // size), r["low"], r["high"]) for r in cells.collect()}
    shards = spark.sparkContext.broadcast(known)

    def first_bound(q: np.ndarray, x: np.ndarray, ids: list) -> np.ndarray:
        """For each query the distance within which the sample alone has enough ids."""
        d = distances(q, x)
        order = np.argsort(d, axis=1, kind="stable")
        enough = np.cumsum(np.array([len(i) for i in ids])[order], axis=1) >= most
        at = np.where(enough[:, -1], enough.argmax(axis=1), 0)
        rows = np.arange(len(q))
        return np.where(enough[:, -1], d[rows, order[rows, at]], np.inf)

    def route(batches):
        """Queries to the cells they must visit: `(length, cell, parts, key, v, bound)`."""
        for b in batches:
            lengths = b.column(1).value_lengths().to_numpy()
            for m in np.unique(lengths):
                every = b.filter(pa.array(lengths == m))
                for at in range(0, every.num_rows, 1024):
                    c = every.slice(at, 1024)
                    q = _matrix(c.column(1))
                    bound, d = np.full(len(q), np.inf), np.zeros((len(q), 1))
                    if m in sent.value:
                        x, ids, count = sent.value[m]
                        bound, d = first_bound(q, x, ids), distances(q, x[:count])
                    for (length, cell), (parts, low, high) in shards.value.items():
                        if length != m:
                            continue
                        away = d[:, cell]
                        least = np.maximum(np.maximum(away - high, low - away), (away - d.min(axis=1)) / 2)
                        go = np.flatnonzero(_open(relax * least, bound, away + high)) if m in sent.value else np.arange(len(q))
                        t = c.take(pa.array(go))
                        where = [pa.array(np.full(len(go), w, np.int32)) for w in (m, cell, parts)]
                        yield pa.RecordBatch.from_arrays([*where, *t.columns, pa.array(bound[go])], names=["length", "cell", "parts", "key", "v", "bound"])

    visits = asked.select("key", "v").distinct().mapInArrow(route, f"length int, cell int, parts int, key long, v {kind}, bound double")
    visits = visits.select("length", "cell", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "key", "v", F.array().cast("array<long>").alias("ids"), "bound")
    counted = cells.select("length", "cell", F.ceil(F.col("n") / size).cast("int").alias("parts"))
    held = p.join(F.broadcast(counted), ["length", "cell"])
    held = held.select("length", "cell", F.pmod(F.xxhash64("key", F.lit(5)), F.col("parts")).cast("int").alias("part"), F.lit(0).alias("kind"), "key", "v", "ids", F.lit(0.0).alias("bound"))
    place = ["length", "cell", "part"]
    lined = held.unionByName(visits).repartition(*place).sortWithinPartitions(*place, "kind")

    def search(batches):
        """Points come before the queries of their shard. A query's results are brought together over the shards of a task."""
        at, have, tree = None, [], None
        best: dict[tuple, list] = {}

        def flush():
            keys = [k for k, _ in best]
            d, ids = (np.array([x[j] for x in best.values()]).reshape(len(best), most) for j in (0, 1))
            good = ids != _FREE
            of = np.repeat(np.arange(len(best)), good.sum(axis=1))
            v = pa.array([list(np.frombuffer(v)) for _, v in best], pa.list_(pa.float64())).take(pa.array(of))
            out = pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.int64)[of]), v, pa.array(ids[good].astype(np.int64)), pa.array(d[good].astype(float))], names=["key", "v", "near", "score"])
            best.clear()
            return out

        for b in batches:
            where = np.stack([b.column(c).to_numpy() for c in range(4)], axis=1)
            edge = np.flatnonzero(np.append(True, (where[1:] != where[:-1]).any(axis=1)))[: len(where)]
            for x, z in zip(edge, np.append(edge[1:], len(where)), strict=True):
                c = b.slice(x, z - x)
                if tuple(where[x, :3]) != at:
                    at, have, tree = tuple(where[x, :3]), [], None
                if where[x, 3] == 0:
                    have.append((_matrix(c.column(5)), _id_matrix(c.column(6), most)))
                    continue
                if tree is None and have:
                    tree = VantageTree(*(np.concatenate(m) for m in zip(*have, strict=True)), leaf, relax)
                for y in range(0, c.num_rows if have else 0, _PART):
                    q, bound = _matrix(c.column(5).slice(y, _PART)), c.column(7).slice(y, _PART).to_numpy()
                    names = list(zip(c.column(4).slice(y, _PART).to_pylist(), map(bytes, q), strict=True))
                    # a place that is still free counts as taken just beyond the query's first bound
                    old = [best.get(s) or (np.full(most, np.nextafter(u, np.inf)), np.full(most, _FREE, np.int64)) for s, u in zip(names, bound, strict=True)]
                    d, ids = np.array([o[0] for o in old]), np.array([o[1] for o in old])
                    tree.search(q, d, ids)
                    best.update(zip(names, zip(d, ids, strict=True), strict=True))
                    if len(best) >= 50_000:
                        yield flush()
        yield flush()

    found = lined.mapInArrow(search, "key long, v array<double>, near long, score double").withColumn("v", F.col("v").cast(kind))
    few = W.partitionBy("key", "v").orderBy("score", "near")
    found = found.withColumn("place", F.row_number().over(few)).where(F.col("place") <= most)
    mine = asked.select(F.col("id").alias("query_id"), "key", "v").join(found, ["key", "v"]).where(F.col("query_id") != F.col("near"))
    last = W.partitionBy("query_id", "key", "v").orderBy("score", "near")
    out = mine.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", F.when(F.col("near") != _NULL, F.col("near")).alias(id_col), "score")
