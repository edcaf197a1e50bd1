"""Ranked lexical search as exact inner-product search in sparse ball trees (Ram and Gray, 2012).

A document is the sparse vector of its term scores, an item that of its terms' weights, and a score is their inner
product. Documents are packed into chunks of bounded size, each with one tree: a ball's centre c and radius r bound the
score of every document in it by q c + |q| r. A tree is searched from the ball of the highest bound down, and a subtree
goes as soon as its bound, rounded up safely, is under the score to beat. At the leaves scores are summed in integers.

Only terms of some item can add to a score. A table of bits of fixed size tells them while texts are split, so that
chunks are small beside the texts; what passes it by chance meets no item's term and adds nothing.
"""

from __future__ import annotations

from collections import Counter
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators.order import numbered
from .bits import BITS, among, bit_table
from .common import stored, text_bytes

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_CHUNK = 2048  #: documents of a tree
_ENTRIES = 1 << 19  #: terms of a tree's documents together
_CELLS = 1 << 22  #: numbers in the centres of a tree
_UP = 1 + 1e-9  #: bounds are rounded up by more than sums of doubles can lose


def terms_of(text: bytes) -> list[bytes]:
    """Lower-cased terms of letters, digits and signs beyond ASCII."""
    return text.translate(_KEEP).split()


def _hashes(terms) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(t) for t in terms), np.uint64, len(terms))


class BallTree:
    """A tree over sparse rows, none empty: row i has the values `val[start[i]:start[i + 1]]` in the columns `col[…]`.

    A ball has a centre, a radius over all columns, and for each column a radius of its own: how far a row passes the
    centre there at most. A query of few columns meets only theirs, which is by far the tighter bound for sparse rows.
    """

    def __init__(self, start: np.ndarray, col: np.ndarray, val: np.ndarray, width: int, leaf: int = 16):
        self.start, self.col, self.val, self.width = start, col, val, width
        self.leaf = max(leaf, 8 * width * (len(start) - 1) // _CELLS)
        self.square = np.bincount(np.repeat(np.arange(len(start) - 1), np.diff(start)), val.astype(float) ** 2, len(start) - 1)
        self.summed = 0  # rows whose score was summed, for tests and figures
        self.centres, self.highest, self.radius, self.children, self.leaves = [], [], [], [], []
        self._grow(np.arange(len(start) - 1))
        self.centres, self.highest, self.radius = (np.ascontiguousarray(np.array(x).T) for x in (self.centres, self.highest, self.radius))

    def _entries(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the entries of some rows, and for each the number of its row among them."""
        size = self.start[rows + 1] - self.start[rows]
        of = np.repeat(np.arange(len(rows)), size)
        return np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.start[rows], size), of

    def _grow(self, rows: np.ndarray) -> int:
        at, of = self._entries(rows)
        col, whole = self.col[at], self.val[at]
        val = whole.astype(float)
        centre = np.bincount(col, val, self.width) / len(rows)

        def away(v: np.ndarray) -> np.ndarray:
            """Squared distance of each row from v."""
            return np.maximum(self.square[rows] - 2 * np.bincount(of, val * v[col], len(rows)) + v @ v, 0)

        def dense(row: int) -> np.ndarray:
            x = np.zeros(self.width)
            x[self.col[self.start[row] : self.start[row + 1]]] = self.val[self.start[row] : self.start[row + 1]]
            return x

        d = away(centre)
        # what rounding may have taken from a squared distance is in proportion to the squares that it came from
        self.radius.append(np.sqrt((d + 1e-12 * (self.square[rows] + centre @ centre)).max()) * _UP)
        highest = np.zeros(self.width)
        np.maximum.at(highest, col, val)
        self.centres.append(centre)
        self.highest.append(highest)  # the centre and the column's radius together
        self.children.append(None)
        self.leaves.append(None)
        me = len(self.leaves) - 1
        if len(rows) <= self.leaf:
            self.leaves[me] = rows, col, whole, np.flatnonzero(np.diff(of, prepend=-1))
            return me
        one = dense(rows[d.argmax()])
        from_one = away(one)
        other = dense(rows[from_one.argmax()])
        side = from_one - away(other)
        left = side <= 0
        if not len(rows) <= 8 * np.count_nonzero(left) <= 7 * len(rows):  # else the tree might be as deep as it has rows
            left = np.zeros(len(rows), bool)
            left[np.argsort(side, kind="stable")[: len(rows) // 2]] = True
        self.children[me] = (self._grow(rows[left]), self._grow(rows[~left]))
        return me

    def bounds(self, some: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """For each ball what no row of it can pass; the query has `weights` in the columns `some`."""
        w = weights.astype(float)
        return np.minimum(w @ self.centres[some] + np.sqrt(w @ w) * self.radius, w @ self.highest[some]) * _UP

    def search(self, some: np.ndarray, weights: np.ndarray, best: list[tuple], k: int, names: list) -> list[tuple]:
        """The k best of `best` and the tree's rows, as `(-score, name)` in order, by whole weights in some columns.

        A row of score 0 is none. Of equal scores the smaller name stands first.
        """
        bounds = self.bounds(some, weights).tolist()
        q = np.zeros(self.width, np.int64)
        q[some] = weights
        least = -best[-1][0] if len(best) >= k else 1
        open_ = [(-bounds[0], 0)]
        while open_:
            bound, node = heappop(open_)
            if -bound < least:
                break  # all others are bounded lower
            if self.children[node] is not None:
                for child in self.children[node]:
                    if bounds[child] >= least:
                        heappush(open_, (max(-bounds[child], bound), child))
                continue
            rows, col, val, first = self.leaves[node]
            score = np.add.reduceat(val * q[col], first)
            self.summed += len(rows)
            new = np.flatnonzero(score >= least)
            if len(new):
                best = sorted([*best, *((-int(score[i]), names[rows[i]]) for i in new)])[:k]
                least = -best[-1][0] if len(best) >= k else 1
        return best


def _packed(batches, known: np.ndarray):
    """Documents to chunks: ids, term counts, and the terms that may be an item's with their occurrences."""
    ids, sizes, lens, terms, tfs = [], [], [], [], []

    def flush():
        out = [pa.array([x], t) for x, t in ((ids, pa.list_(pa.int64())), (sizes, pa.list_(pa.int64())), (lens, pa.list_(pa.int32())), (terms, pa.list_(pa.binary())), (tfs, pa.list_(pa.int64())))]
        for x in (ids, sizes, lens, terms, tfs):
            x.clear()
        return pa.RecordBatch.from_arrays(out, names=["ids", "sizes", "lens", "terms", "tfs"])

    wanted: dict[bytes, bool] = {}
    for b in batches:
        for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            counts = Counter(terms_of(text))
            if not counts:
                continue
            new = [t for t in counts if t not in wanted]
            if len(wanted) > 1 << 18:
                wanted, new = {}, list(counts)
            wanted.update(zip(new, among(known, _hashes(new)).tolist(), strict=True))
            kept = [t for t in counts if wanted[t]]
            ids.append(name)
            sizes.append(counts.total())
            lens.append(len(kept))
            terms += kept
            tfs += [counts[t] for t in kept]
            if len(ids) >= _CHUNK or len(terms) >= _ENTRIES:
                yield flush()
    if ids:
        yield flush()


def chunks_of(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_text: str, bits: int = BITS) -> DataFrame:
    """`(ids, sizes, lens, terms, tfs)`: the documents with at least one term, packed; terms that no item has are mostly left out."""

    def hashed(batches):
        for b in batches:
            h = _hashes({t for x in b.column(0).to_pylist() for t in terms_of(x)})
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64))], names=["h"])

    table = bit_table(items.select(text_bytes(item_text).alias("t")).mapInArrow(hashed, "h long"), bits)
    sent = docs.sparkSession.sparkContext.broadcast(table)
    d = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("t"))
    return stored(d.mapInArrow(lambda batches: _packed(batches, sent.value), "ids array<long>, sizes array<long>, lens array<int>, terms array<binary>, tfs array<long>"))


def weighed_items(items: DataFrame, df: DataFrame, n: int, item_id: str, item_text: str) -> DataFrame:
    """`(place, name, terms)`: each row of `items` with a term that some document has, numbered; terms is an array of (term, weight).

    The weight is floor(1000 ln((2N + 2) / (2 df + 1))) times the term's occurrences in the item.
    """

    def split(batches):
        for b in batches:
            rows = [(i, t, c) for i, x in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True) for t, c in Counter(terms_of(x)).items()]
            name = dict(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([name[r[0]] for r in rows], b.schema.field(1).type), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())], names=["place", "name", "term", "times"])

    kind = items.schema[item_id].dataType.simpleString()
    d = numbered(items.select(F.col(item_id).alias("name"), text_bytes(item_text).alias("t")), ["name", "t"], "place").select("place", "name", "t")
    d = d.mapInArrow(split, f"place long, name {kind}, term binary, times long")
    w = F.floor(F.lit(1000.0) * F.log((2 * F.lit(n) + 2) / (2 * F.col("df") + 1))).cast("long")
    d = d.join(df, "term").select("place", "name", "term", (w * F.col("times")).alias("weight")).where(F.col("weight") > 0)
    return d.groupBy("place", "name").agg(F.collect_list(F.struct("term", "weight")).alias("terms"))


def rank(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", k: int = 10, block: int = 256, block_terms: int = 1 << 15, salts: int = 64, bits: int = BITS) -> DataFrame:
    """`(<item_id>, rank, <id_col>, score)`: for each row of `items` its `k` documents of the highest score above 0.

    Terms are runs of ASCII letters and digits and of signs beyond ASCII, with only A-Z lower-cased; null texts have none.
    A score sums over the item's terms, repeats included, weight * (10^9 tf div (1000 tf + 8 m)), where
    m = 25 + 75 n N div L, by the counts of all documents. Equal scores stand by ascending id, a null id last.

    Repeated rows of `docs` are documents of their own, with equal scores; repeated rows of `items` are each answered.
    An item without terms, or with none that a document has, gives no rows; nor do empty tables. Very long texts are
    read whole; their distinct terms make a chunk of its own if they are many. Extra columns are not read.

    Items are packed into blocks of about `block` items and `block_terms` terms; each chunk meets each block once.
    """
    chunks = chunks_of(docs, items, id_col, text_col, item_text, bits)
    n, total = chunks.select(F.size("ids").cast("long").alias("n"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("l")).agg(F.sum("n"), F.sum("l")).first()
    df = chunks.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    kind = items.schema[item_id].dataType.simpleString()
    asked = stored(weighed_items(items, df, n or 0, item_id, item_text).withColumn("size", F.size("terms")))
    # items are dealt by a hash, so blocks are about alike in items and in terms
    count, size = asked.agg(F.count("*"), F.sum("size")).first()
    blocks = max(1, -(-(count or 0) // block), -(-(size or 0) // block_terms))
    packed = asked.groupBy(F.pmod(F.xxhash64("place"), F.lit(blocks)).cast("int").alias("block")).agg(F.collect_list(F.struct("place", "name", "terms")).alias("items"))
    salted = packed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    spread = chunks.withColumn("salt", F.pmod(F.xxhash64("ids", "sizes"), F.lit(salts)).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    pairs = spread.join(salted, ["block", "salt"]).select("ids", "sizes", "lens", "terms", "tfs", "block", "items")

    def search(batches):
        at, asked, ids = None, [], {}
        best: dict[int, tuple] = {}  # by place: the item's name, and its best documents so far in this task

        def flush():
            rows = [(place, name, doc, -s) for place, (name, x) in best.items() for s, (_, doc) in x]
            best.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), named, pa.int64(), pa.int64()))], names=["place", "name", "doc", "score"])

        for b in batches:
            named = b.schema.field("items").type.value_type.field("name").type
            for i in range(b.num_rows):
                names, sizes, lens, terms, tf, block, items = (c[i] for c in b.columns)
                if at != block.as_py():
                    at, items = block.as_py(), items.as_py()
                    ids = {t: j for j, t in enumerate({x["term"]: None for r in items for x in r["terms"]})}
                    asked = [(r["place"], r["name"], np.array([ids[x["term"]] for x in r["terms"]]), np.array([x["weight"] for x in r["terms"]])) for r in items]
                sizes, lens, tf = (x.values.to_numpy().astype(np.int64) for x in (sizes, lens, tf))
                of = np.repeat(np.arange(len(sizes)), lens)
                value = (1_000_000_000 * tf) // (1000 * tf + 8 * (25 + (75 * sizes * n) // total)[of])
                col = np.fromiter((ids.get(t, -1) for t in terms.as_py()), np.int64, len(tf))
                of, col, value = (x[(col >= 0) & (value > 0)] for x in (of, col, value))
                some, start = np.unique(of, return_index=True)
                if not len(some):
                    continue
                tree = BallTree(np.append(start, len(of)), col, value, len(ids))
                docs_of = [(x is None, x) for x in names.as_py()]
                docs_of = [docs_of[j] for j in some]
                for place, name, cols, weights in asked:
                    best[place] = name, tree.search(cols, weights, best.get(place, (name, []))[1], k, docs_of)
                if len(best) >= 50_000:
                    yield flush()
        if best:
            yield flush()

    found = pairs.mapInArrow(search, f"place long, name {kind}, doc long, score long")
    w = W.partitionBy("place").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    found = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
    return found.select(F.col("name").alias(item_id), "rank", F.col("doc").alias(id_col), "score")
