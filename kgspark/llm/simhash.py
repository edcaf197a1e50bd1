"""SimHash near-duplicates through a Gray-order hierarchical index.

1. Every document gets a 64-bit fingerprint of its word shingles. Equal fingerprints are grouped first
   (with map-side combine), so exact copies cost one row however many there are.
2. Fingerprints that differ in at most `d` bits agree on one of `d + 1` bit blocks. Rows are dealt by
   (block, value); a bucket of more than `bucket_rows` fingerprints is dealt once more by blocks of the
   bits that are left, which again loses no link. A bucket that is still larger, as of a cluster of very many
   different fingerprints, is cut into parts, and every two parts meet in a task of at most about `bucket_rows`.
3. In a bucket the fingerprints are sorted by Gray rank, so neighbours share long bit patterns. A node of
   the index holds the bits on which all below it agree (mask and pattern). A query meets the nodes level
   by level; a node is dropped with everything below it once the differences on its mask exceed `d`.
   A node whose members all lie within `d` bits of the query is joined as a whole.
4. A bucket reports one edge per document to its local root (a spanning forest), never all pairs; the
   forests are joined by star contraction.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, join_few, stored, text_bytes
from .components import connected_components

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
FAN = 16  #: children of an index node


def shingle_hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of every word shingle of UTF-8 text, A-Z lower-cased, repeats included; a text of fewer words is one shingle, one without words has none."""
    words = text.translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    flat = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= shingle:
        return np.array([digest(flat, seed)], np.uint64)
    stop = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    first = np.concatenate(([0], stop[:-1] + 1))[: len(words) - shingle + 1].tolist()
    return np.fromiter((digest(flat[a:b], seed) for a, b in zip(first, stop[shingle - 1 :].tolist(), strict=True)), np.uint64, len(first))


def majority(h: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; zero without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 65536):
        part = np.ascontiguousarray(h[at : at + 65536], "<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h), bitorder="little").tobytes(), "little")


def fingerprint(text: bytes, shingle: int = 4, seed: int = 42) -> int:
    """Unsigned 64-bit SimHash of UTF-8 text; a text without words has fingerprint zero."""
    return majority(shingle_hashes(text, shingle, seed))


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42) -> DataFrame:
    """`(id_col, fp)` per row of `docs`; fp is the fingerprint as a signed long."""

    def run(batches):
        for b in batches:
            fp = [_signed(fingerprint(t, shingle, seed)) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp, pa.int64())], names=["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp long")
    return out.withColumnRenamed("id", id_col)


def gray_rank(fp: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    g = fp.copy()
    for s in (1, 2, 4, 8, 16, 32):
        g ^= g >> np.uint64(s)
    return g


class GrayIndex:
    """The hierarchy over one bucket: level 0 are the fingerprints in Gray order, each level above joins FAN nodes."""

    def __init__(self, fp: np.ndarray):
        self.order = np.argsort(gray_rank(fp), kind="stable")
        self.fp = fp[self.order]
        n, every = len(fp), np.uint64(2**64 - 1)
        self.levels = [(np.full(n, every), self.fp)]  # mask of the shared bits, their pattern
        while len(self.levels[-1][0]) > 1:
            mask, pattern = self.levels[-1]
            cut = np.arange(0, len(mask), FAN)
            ones = np.bitwise_and.reduceat(mask & pattern, cut)
            zeros = np.bitwise_and.reduceat(mask & ~pattern, cut)
            self.levels.append((ones | zeros, ones))

    def forest(self, d: int, block: int = 4096) -> np.ndarray:
        """For each fingerprint the index of its component's root in this bucket, in the order given."""
        n = len(self.fp)
        root = np.arange(n)

        def find(x: np.ndarray) -> np.ndarray:
            while True:
                up = root[x]
                if np.array_equal(up, x):
                    return x
                root[x] = root[up]
                x = root[x]

        def unite(a: np.ndarray, b: np.ndarray) -> None:
            while len(a):
                a, b = find(a), find(b)
                apart = a != b
                a, b = a[apart], b[apart]
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))

        sizes = [FAN**k for k in range(len(self.levels))]
        free = [64 - np.bitwise_count(mask).astype(np.int64) for mask, _ in self.levels]
        # nodes whose members all lie within d bits of each other are one component at once
        for level in range(1, len(self.levels)):
            whole = np.flatnonzero(free[level] <= d)
            if not len(whole):
                break
            at = (whole[:, None] * sizes[level] + np.arange(sizes[level])).ravel()
            at = at[at < n]
            unite(at // sizes[level] * sizes[level], at)
        for start in range(0, n, block):
            q = np.arange(start, min(n, start + block))
            node = np.zeros(len(q), np.int64)
            for level in range(len(self.levels) - 1, -1, -1):
                mask, pattern = self.levels[level]
                pieces = []
                for part in range(0, len(q), 1 << 20):  # bounds what one step holds
                    a, b = q[part : part + (1 << 20)], node[part : part + (1 << 20)]
                    keep = b * sizes[level] <= a  # each pair once, from its later member
                    a, b = a[keep], b[keep]
                    apart = np.bitwise_count((self.fp[a] ^ pattern[b]) & mask[b]).astype(np.int64)
                    near = apart <= d
                    a, b, apart = a[near], b[near], apart[near]
                    if level:
                        inside = apart + free[level][b] <= d
                        unite(a[inside], b[inside] * sizes[level])
                        inside |= (free[level][b] <= d) & (find(a) == find(b * sizes[level]))
                        # a node that is one component as a whole and already the query's can add no link
                        a, b = a[~inside], b[~inside]
                        child = (b[:, None] * FAN + np.arange(FAN)).ravel()
                        a = np.repeat(a, FAN)
                        there = child < len(self.levels[level - 1][0])
                        pieces.append((a[there], child[there]))
                    else:
                        unite(a, b)
                if level:
                    q = np.concatenate([x for x, _ in pieces]) if pieces else q[:0]
                    node = np.concatenate([y for _, y in pieces]) if pieces else node[:0]
        out = np.empty(n, np.int64)
        out[self.order] = self.order[find(np.arange(n))]
        return out


def _blocks(bits: list[int], parts: int) -> list[int]:
    """Masks of `parts` blocks of nearly equal size over the given bit positions."""
    return [sum(1 << b for b in bits[len(bits) * i // parts : len(bits) * (i + 1) // parts]) for i in range(parts)]


def links(fps: DataFrame, d: int = 4, bucket_rows: int = 16_384) -> DataFrame:
    """Edges `(a, b)` between distinct fingerprints that connect all that lie within `d` bits.

    `fps` has one row per distinct fingerprint in column `fp`. The edges are spanning forests of the
    buckets: at most `d + 1` for each fingerprint and round of dealing, whatever the size of a cluster.
    """
    parts = d + 1
    first = _blocks(list(range(64)), parts)
    keyed = fps.select("fp", F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(m))) for m in first])).alias("block", "value"))
    # stored, so that Spark knows how few they are and need not shuffle all fingerprints to meet them
    sizes = stored(keyed.groupBy("block", "value").count().where(F.col("count") > bucket_rows).select("block", "value", F.lit(True).alias("hot")))
    dealt = join_few(keyed, sizes, ["block", "value"], "fp")
    again = []
    for m in first:
        rest = [b for b in range(64) if not m >> b & 1]
        again.append(F.array(*[F.col("fp").bitwiseAND(F.lit(_signed(x))) for x in _blocks(rest, parts)]))
    rest_of = F.element_at(F.array(*again), F.col("block") + 1)
    cool = dealt.where("hot is null").select("fp", "block", "value", F.lit(-1).alias("block2"), F.lit(0).cast("long").alias("value2"), F.lit(-1).cast("long").alias("meet"))
    hot = dealt.where("hot").select("fp", "block", "value", F.posexplode(rest_of).alias("block2", "value2"))

    # what is still too large is cut into parts that meet two by two
    twice = ["block", "value", "block2", "value2"]
    large = stored(hot.groupBy(*twice).count().where(F.col("count") > bucket_rows).select(*twice, F.ceil(2 * F.col("count") / bucket_rows).cast("long").alias("cuts")))
    cut = join_few(hot, large, twice, "fp").withColumn("own", F.pmod(F.xxhash64("fp", F.lit(3)), F.col("cuts")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1), lambda x: x != F.col("own"))
    meets = F.when(F.col("cuts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.transform(others, lambda x: F.least(x, "own") * F.col("cuts") + F.greatest(x, "own")))
    keys = [*twice, "meet"]
    rows = cool.unionByName(cut.select("fp", *twice, F.explode(meets).alias("meet"))).repartition(*keys).sortWithinPartitions(*keys).select("fp", *keys)
    return rows.mapInArrow(lambda batches: _forests(batches, d), "a long, b long").distinct()


def _forests(batches, d: int):
    """Edges of each bucket's forest; rows come sorted by bucket, and a bucket may span batches."""
    rest: list[np.ndarray] = []

    def solve(x: np.ndarray):
        cut = np.flatnonzero((x[1:, 1:] != x[:-1, 1:]).any(axis=1)) + 1
        a, b = [], []
        for bucket in np.split(x[:, 0], cut):
            if len(bucket) > 1:
                fp = np.ascontiguousarray(bucket)
                top = GrayIndex(fp.view(np.uint64)).forest(d)
                own = top != np.arange(len(fp))
                a.append(fp[own])
                b.append(fp[top[own]])
        none = np.empty(0, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([none, *a])), pa.array(np.concatenate([none, *b]))], names=["a", "b"])

    for batch in batches:
        x = np.stack([c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns], axis=1)
        if not len(x):
            continue
        last = np.flatnonzero((x[:, 1:] != x[-1, 1:]).any(axis=1))
        if not len(last):
            if rest and (rest[0][0, 1:] != x[0, 1:]).any():
                yield solve(np.concatenate(rest))
                rest = []
            rest.append(x)
            continue
        yield solve(np.concatenate([*rest, x[: last[-1] + 1]]))
        rest = [x[last[-1] + 1 :]]
    if rest:
        yield solve(np.concatenate(rest))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, seed: int = 42, d: int = 4, bucket_rows: int = 16_384) -> DataFrame:
    """`(id_col, fingerprint, component_id)` for every row of `docs`.

    Fingerprints within `d` bits are linked; component_id is the smallest id reachable. Null and empty
    texts have fingerprint zero and are linked like any other; repeated rows give repeated rows; an empty
    table gives an empty one. Columns of `docs` other than the two named are not read.
    """
    fps = checkpointed(fingerprints(docs, id_col, text_col, shingle, seed))
    least = stored(fps.groupBy("fp").agg(F.min(id_col).alias("least")))
    label = connected_components(links(least.select("fp"), d, bucket_rows)).withColumnRenamed("node", "fp")
    linked = checkpointed(least.join(label, "fp"))
    smallest = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of = join_few(linked, smallest, ["root"], "fp", 8).select("fp", "component_id")
    of = least.join(of, "fp", "left").select("fp", F.coalesce("component_id", "least").alias("component_id"))
    return fps.join(of, "fp").select(id_col, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
