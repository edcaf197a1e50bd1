"""Ranked search against scores of all documents in plain integers, with ties, copies and awkward rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from kgspark.llm import balltree
from kgspark.llm.queries import op13_ranked

DOCS = "doc_id long, text string, item_id long, score long, rank int, terms string, name string"
ITEMS = "item_id long, text string, doc_id long, name string, terms string"
LOWER = {c: c + 32 for c in range(65, 91)}


def terms(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOWER))


def brute(docs, items, k=10):
    rows = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, total = len(rows), sum(c.total() for _, c in rows)
    df = Counter(t for _, c in rows for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in rows:
            m = 100 - 75 + (75 * c.total() * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                found.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


def frames(spark, docs, items):
    d = spark.createDataFrame([(i, t, 1, 2, 3, "x", None) for i, t in docs], DOCS)
    return d, spark.createDataFrame([(i, t, 1, "n", None) for i, t in items], ITEMS)


def awkward(seed=2):
    rng = random.Random(seed)
    words = ["The", "cat's", "é😀", "x1", "ß", "no break", "42", "ÀB", "sat"] + [f"w{i}" for i in range(60)]

    def text(n):
        return "".join(rng.choice(words) + rng.choice([" ", "-", "\n", "\x7f", "_"]) for _ in range(n))

    docs = [(None, "the cat"), (None, "the cat"), (0, None), (1, ""), (2, "!?\x00_"), (3, "the cat"), (3, "the cat"), (3, "w1 w1 w2"), (-5, text(3000))]
    docs += [(10 + i, text(rng.randrange(1, 60))) for i in range(300)]
    docs += [(1000 + i, docs[20][1]) for i in range(150)]  # copies: ties by id
    items = [(0, None), (1, ""), (2, "nowhere"), (3, "the the cat"), (3, "the the cat"), (None, "w1 w2"), (4, docs[20][1]), (5, text(4000))]
    items += [(10 + i, text(rng.randrange(1, 30))) for i in range(40)]
    return docs, items


@pytest.mark.parametrize(("chunk", "block", "bits"), [(2048, 256, 26), (37, 5, 8), (1, 1, 6)])
def test_equals_scores_of_all_documents(spark, monkeypatch, chunk, block, bits):
    docs, items = awkward()
    if chunk == 1:
        docs, items = docs[:60], items[:12]
    monkeypatch.setattr(balltree, "_CHUNK", chunk)
    got = balltree.rank(*frames(spark, docs, items), block=block, salts=3, bits=bits)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(docs, items)


def test_empty_tables(spark):
    docs, items = awkward()
    for d, i in (([], items), (docs, []), ([], []), ([(1, None)], items), (docs, [(1, "")])):
        got = balltree.rank(*frames(spark, d, i))
        assert got.columns == ["item_id", "rank", "doc_id", "score"]
        assert got.collect() == []


def sparse(rng, n, width):
    rows = [np.sort(rng.choice(width, rng.integers(1, 20), replace=False)) for _ in range(n)]
    start = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    col = np.concatenate(rows)
    return start, col, rng.integers(1, 1_000_000, len(col))


def test_bounds_hold_and_the_tree_prunes():
    rng = np.random.default_rng(5)
    start, col, val = sparse(rng, 1500, 400)
    tree = balltree.BallTree(start, col, val, 400, leaf=8)
    dense = np.zeros((1500, 400), np.int64)
    dense[np.repeat(np.arange(1500), np.diff(start)), col] = val
    names = [(False, i) for i in range(1500)]
    for _ in range(50):
        some = rng.choice(400, 12, replace=False)
        weights = rng.integers(1, 10_000, 12)
        scores = dense[:, some] @ weights
        bounds = tree.bounds(some, weights)
        for node, leaf in enumerate(tree.leaves):
            if leaf:
                assert bounds[node] >= scores[leaf[0]].max()
        want = sorted((-int(s), names[i]) for i, s in enumerate(scores) if s > 0)[:10]
        assert tree.search(some, weights, [], 10, names) == want
    assert tree.summed < 50 * 1500 / 2


def test_rows_alike_make_a_bounded_tree():
    start = np.arange(0, 3 * 501, 3)
    tree = balltree.BallTree(start, np.tile([0, 1, 2], 500), np.full(1500, 7), 3, leaf=4)
    assert len(tree.leaves) < 500
    assert [n for _, (_, n) in tree.search(np.array([1]), np.array([5]), [], 10, [(False, i) for i in range(500)])] == list(range(10))


def test_query_is_the_operator_over_the_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [[tuple(r) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(c, "text").collect()] for t, c in (("documents", "doc_id"), ("benchmark", "item_id"))]
    assert sorted(map(tuple, op13_ranked(spark, sf).collect()), key=repr) == brute(*rows)
