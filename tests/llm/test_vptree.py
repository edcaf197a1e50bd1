"""Nearest neighbours against all distances, with ties, copies and rows that take no part."""

import math

import numpy as np
import pytest

from kgspark.llm import vptree
from kgspark.llm.queries import op12_neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, score double, rank int, v string, id string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 0.5, 2, "v", None) for i, v in rows], SCHEMA)


def brute(vectors, queries, k):
    def good(v):
        return v is not None and any(x is not None and x != 0 for x in v) and all(x is not None and math.isfinite(x) for x in v)

    rows = {(i, tuple(map(float, np.float32(v)))) for i, v in vectors if good(v)}
    out = []
    for q, x in {(i, tuple(map(float, np.float32(v)))) for i, v in queries if good(v) and i is not None}:
        near = []
        for i, y in rows:
            if i != q and len(x) == len(y):
                total = 0.0
                for a, b in zip(x, y, strict=True):
                    total += (a - b) * (a - b)
                near.append((math.sqrt(total), i is None, i or 0, i))
        out += [(q, r, i, s) for r, (s, _, _, i) in enumerate(sorted(near, key=lambda n: n[:3])[:k], 1)]
    return sorted(out, key=repr)


def clusters(n=900, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 8))
    x = (centres[rng.integers(0, 6, n)] + 0.1 * rng.normal(size=(n, 8))).astype(np.float32)
    x[n // 2 : n // 2 + n // 3] = x[0]  # a third of all rows is one vector
    x[5] = x[6] = x[7] + np.float32(1e-6)
    return [(int(i), [float(v) for v in row]) for i, row in enumerate(x)]


@pytest.mark.parametrize(("sample", "shard", "leaf"), [(2048, 8192, 32), (20, 40, 4), (1, 100, 1)])
def test_equals_all_distances(spark, sample, shard, leaf):
    rows = clusters()
    queries = [r for r in rows if r[0] % 10 == 0]
    got = vptree.nearest(frame(spark, rows), frame(spark, queries), sample=sample, shard=shard, leaf=leaf)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, queries, 10)


def test_rows_of_every_awkward_kind(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.5]), (None, [0.5, 0.5]), (None, [9.0, 9.0])]
    rows += [(3, None), (4, []), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, [inf, 1.0]), (9, [1.0, 0.0, 0.0]), (10, [1.0, 0.1, 0.0]), (11, [-0.0, 1.0]), (-100, [3.0, 3.0])]
    for k in (1, 3, 10):
        got = vptree.nearest(frame(spark, rows), frame(spark, rows), k=k, sample=3, shard=2, leaf=1)
        assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, rows, k)


def test_empty_tables(spark):
    some = frame(spark, clusters(20))
    for x, q in ((frame(spark, []), some), (some, frame(spark, [])), (frame(spark, [(1, [0.0])]), some)):
        got = vptree.nearest(x, q)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert got.collect() == []


def test_the_tree_prunes_and_relaxing_trades_recall_for_distances():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4000, 4))
    ids = np.arange(4000)[:, None]
    q = rng.normal(size=(50, 4))
    want = np.argsort(vptree.distances(q, x), axis=1, kind="stable")[:, :10]
    done, recall = [], []
    for relax in (1.0, 1.5, 3.0):
        tree = vptree.VantageTree(x, ids, 16, relax)
        d, i = np.full((50, 10), np.inf), np.full((50, 10), vptree._FREE)
        tree.search(q, d, i)
        done.append(tree.computed)
        recall.append(np.mean([len(set(a) & set(b)) / 10 for a, b in zip(i, want, strict=True)]))
    assert recall[0] == 1 and recall[1] >= 0.9
    assert done[0] < 4000 * 50 / 3 and done[2] < done[1] < done[0]


def test_equal_distances_everywhere(spark):
    rows = [(i, [float(i == j) for j in range(40)]) for i in range(40)]
    got = vptree.nearest(frame(spark, rows), frame(spark, rows), sample=4, shard=8, leaf=2)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, rows, 10)


def test_query_is_the_operator_over_the_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    got = op12_neighbours(spark, sf)
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows, [r for r in rows if r[0] % 100 == 0], 10)
