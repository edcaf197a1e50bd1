"""SimHash near-duplicates at a similarity of shingle sets: candidates are proposed, the sets themselves decide.

1. Texts of equal words are one node, named by a hash of the words.
2. The Gray-order index of `simhash` links nodes whose fingerprints lie within `d` bits; these pairs are proposed.
   At a similarity of 0.8 about ten of 64 bits differ, which no index of bounded work can cover (at ten bits nearly
   every bucket would hold a share of all fingerprints). So a second proposal completes it:
3. Every node has `BANDS` keys of `ROWS` minima over its shingle hashes. Sets of similarity 0.8 share a key with
   probability 1 - (1 - 0.8^4)^25, all but two in a million. Each key's nodes are first compared with one of them,
   chosen anew for each key, which joins a large cluster by a few edges for each node.
4. Keys whose nodes are still in different components are settled by groups of nodes that such keys hold together. A
   task compares up to `group_rows` nodes by a matrix product and reports a spanning forest, never pairs; a larger
   group is cut into parts that meet two by two. So every pair with a common key is compared or already joined.
5. A link is an exact comparison: common shingles over all shingles of both.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import join_few, stored, text_bytes
from .components import connected_components
from .simhash import _signed, links, majority, shingle_hashes

BANDS, ROWS = 25, 4


def node_of(text: Column | str) -> Column:
    """Hash of a text's words, A-Z lower-cased, with single spaces between them; a null text has no words."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    t = F.translate(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.xxhash64(F.trim(F.regexp_replace(t, r"[\x20\x09-\x0D]+", " ")))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """One signed key for each band, different between bands."""
    rng = np.random.default_rng(42)
    times = rng.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(1)
    plus = rng.integers(0, 2**64, BANDS * ROWS, np.uint64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        h = hashes[at : at + 1024, None] * times + plus
        h ^= h >> np.uint64(32)  # else the order of the products follows their high bits alone
        least = np.minimum(least, (h * times).min(axis=0))
    seeds = least.reshape(BANDS, ROWS)
    return np.array([xxhash.xxh64_intdigest(seeds[k].tobytes(), k) for k in range(BANDS)], np.uint64).view(np.int64)


def _keys(docs: DataFrame, size: int, seed: int) -> DataFrame:
    """`(node, n, fp, keys)` once for each node that has words; n is the number of its distinct shingles, fp its fingerprint."""

    def run(batches):
        for b in batches:
            n, fp, flat = [], [], [np.empty(0, np.int64)]
            for t in b.column(1).to_pylist():
                h = shingle_hashes(t, size, seed)
                held = np.unique(h)
                n.append(len(held))
                fp.append(_signed(majority(h)))
                flat.append(band_keys(held) if len(held) else np.zeros(BANDS, np.int64))
            flat = np.concatenate(flat)
            keys = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BANDS), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int32()), pa.array(fp, pa.int64()), keys], names=["node", "n", "fp", "keys"])

    return docs.mapInArrow(run, "node long, n int, fp long, keys array<long>").where("n > 0").dropDuplicates(["node"])


def _sets(docs: DataFrame, size: int, seed: int) -> DataFrame:
    def run(batches):
        for b in batches:
            sets = [np.unique(shingle_hashes(t, size, seed)).view(np.int64) for t in b.column(1).to_pylist()]
            stop = np.cumsum([0, *map(len, sets)])
            held = pa.ListArray.from_arrays(pa.array(stop, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([b.column(0), held], names=["node", "held"])

    return docs.mapInArrow(run, "node long, held array<long>")


def _alike(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Of `pairs (a, b)` those whose sets have at least that similarity."""
    d = pairs.join(sets.select(F.col("node").alias("b"), F.col("held").alias("hb")), "b").join(sets.select(F.col("node").alias("a"), F.col("held").alias("ha")), "a")
    both = F.size(F.array_intersect("ha", "hb"))
    return d.where(both >= least * (F.size("ha") + F.size("hb") - both)).select("a", "b")


def proposed(keyed: DataFrame, d: int) -> DataFrame:
    """Pairs `(a, b)` of nodes by their fingerprints: nodes of one fingerprint with the least of them, and the index's links between fingerprints."""
    least = stored(keyed.groupBy("fp").agg(F.min("node").alias("rep")))
    alike = keyed.join(least, "fp").select(F.col("node").alias("a"), F.col("rep").alias("b"))
    x, y = least.toDF("a", "ra"), least.toDF("b", "rb")
    near = links(least.select("fp"), d).join(x, "a").join(y, "b").select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b"))
    return alike.where("a <> b").unionByName(near)


def components(docs: DataFrame, text_col: str = "text", shingle: int = 5, similarity: float = 0.8, d: int = 4, seed: int = 42, group_rows: int = 1000) -> DataFrame:
    """`(node, root)` for every node that is linked to another, directly or through others.

    Nodes whose sets of `shingle`-word shingles have a Jaccard similarity of at least `similarity` are linked. Texts
    of equal words are one node already (`node_of`); null and empty texts are one node without links. An empty table
    gives an empty one. Columns of `docs` other than the text are not read.
    """
    texts = docs.select(node_of(text_col).alias("node"), text_bytes(text_col).alias("t"))
    keyed = stored(_keys(texts, shingle, seed))
    keys = keyed.select("node", "n", F.explode("keys").alias("key"))
    pick = F.struct(F.xxhash64("node", "key").alias("h"), F.col("node").alias("rep"), F.col("n").alias("rn"))
    shared = keys.groupBy("key").agg(F.count("*").alias("many"), F.min(pick).alias("pick")).where("many > 1").select("key", "pick.rep", "pick.rn")
    met = stored(keys.join(shared, "key"))  # the nodes of keys that several nodes have

    def near_size(x: str, y: str) -> Column:  # the similarity is at most the ratio of the sizes
        return F.least(x, y) >= similarity * F.greatest(x, y)

    first = met.where(F.col("node") != F.col("rep")).where(near_size("n", "rn")).select(F.greatest("node", "rep").alias("a"), F.least("node", "rep").alias("b"))
    first = stored(first.unionByName(proposed(keyed, d)).distinct())
    wanted = met.select("node").union(first.select("a")).union(first.select("b")).distinct()
    sets = stored(_sets(texts.join(wanted, "node", "left_semi").dropDuplicates(["node"]), shingle, seed))
    linked = stored(_alike(first, sets, similarity))
    label = connected_components(linked)
    now = met.join(label, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = now.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.min("node").alias("least")).where("r0 <> r1").select("key", "least")
    now = stored(now.join(mixed, "key"))
    rest = now.select("node", "root").distinct()
    groups = connected_components(now.select(F.col("node").alias("a"), F.col("least").alias("b")).distinct())
    rest = stored(rest.join(groups.withColumnRenamed("root", "grp"), "node"))
    cuts = rest.groupBy("grp").count().where(F.col("count") > group_rows).select("grp", F.ceil(2 * F.col("count") / group_rows).cast("long").alias("cuts"))
    cut = join_few(rest, cuts, ["grp"], "node").withColumn("own", F.pmod(F.xxhash64("node", F.lit(3)), F.col("cuts")))
    others = F.filter(F.sequence(F.lit(0).cast("long"), F.col("cuts") - 1), lambda x: x != F.col("own"))
    meets = F.when(F.col("cuts").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.transform(others, lambda x: F.least(x, "own") * F.col("cuts") + F.greatest(x, "own")))
    rows = cut.select("grp", F.explode(meets).alias("meet"), "node", "root").join(sets, "node").select("grp", "meet", "node", "root", "held")
    rows = rows.repartition("grp", "meet").sortWithinPartitions("grp", "meet")
    more = rows.mapInArrow(lambda batches: _compared(batches, similarity), "a long, b long")
    # what is joined already comes as stars, so that only the new edges need rounds
    return connected_components(label.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more))


def _compared(batches, similarity: float):
    """Edges of each group's forest; rows come sorted by group, and a group may span batches."""
    now, nodes, roots, sets = None, [], [], []
    for b in batches:
        a, z = [], []
        keys = zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)
        held = b.column(4)
        ends, flat = held.offsets.to_numpy() - held.offsets[0].as_py(), held.flatten().to_numpy()
        for k, key in enumerate(keys):
            if key != now and nodes:
                for x, y in forest(nodes, roots, sets, similarity):
                    a.append(x)
                    z.append(y)
                nodes, roots, sets = [], [], []
            now = key
            nodes.append(b.column(2)[k].as_py())
            roots.append(b.column(3)[k].as_py())
            sets.append(flat[ends[k] : ends[k + 1]])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(z, pa.int64())], names=["a", "b"])
    pairs = forest(nodes, roots, sets, similarity)
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], names=["a", "b"])


def forest(nodes: list[int], roots: list[int], sets: list[np.ndarray], similarity: float, width: int = 4096) -> list[tuple[int, int]]:
    """Edges that join what the exact similarities of all pairs join, beyond nodes of one root. Common shingles are counted by a matrix product, `width` shingles at a time."""
    if len(set(roots)) < 2:
        return []
    n = len(nodes)
    of = np.repeat(np.arange(n), [len(x) for x in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1  # a shingle of one node is common to no pair
    place = np.cumsum(shared) - 1
    keep = shared[column]
    of, column = of[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    of, column = of[order], column[order]
    both = np.zeros((n, n), np.float32)
    for low in range(0, int(shared.sum()), width):
        x, y = np.searchsorted(column, [low, low + width])
        part = np.zeros((n, width), np.float32)
        part[of[x:y], column[x:y] - low] = 1
        both += part @ part.T
    size = np.array([len(x) for x in sets], np.float32)
    near = both >= similarity * (size[:, None] + size[None, :] - both)
    label = np.unique(roots, return_inverse=True)[1]
    near |= label[:, None] == label[None, :]
    first, label = label, np.arange(n)
    while True:
        least = np.where(near, label[None, :], n).min(axis=1)
        if np.array_equal(least, label):
            break
        label = least
    out = {}
    for k in range(n):
        if first[k] != first[label[k]]:
            out[first[k], label[k]] = (nodes[k], nodes[label[k]])
    return list(out.values())
