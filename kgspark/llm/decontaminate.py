"""Benchmark decontamination with a generalised suffix automaton of the normalised test items.

The items' words (lower-cased, letters, digits and non-ASCII signs) form an automaton. Training words are
streamed through it; at each word the automaton's state tells the longest match that ends there. A match of
at least `window` words (or of a whole item, if that is shorter) marks its words as hit.

Items are dealt into blocks of bounded size. A block's automaton is built once, by one task, and frozen into
sorted arrays. As many automata as fit a number of bytes go to the tasks together, so the documents pass once for
each such load, and once in all for items of some 15 MB.

Before the automaton, runs of words are tested by their neighbours: a window can only lie where every two
neighbouring words are neighbours in some item too. This drops nearly all text at array speed and no window.
"""

from __future__ import annotations

import io
import re
from array import array
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_few, stored, text_bytes

_KEEP = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SLOTS = 1 << 22


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_KEEP).split()


def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * 2_654_435_761 + b * 40_503) & (_SLOTS - 1)


def _groups(pairs: set[tuple[int, int]], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted pairs as starts of each of n first members, and the second members."""
    x = np.array(sorted(pairs), np.int64).reshape(-1, 2)
    return np.searchsorted(x[:, 0], np.arange(n + 1)), x[:, 1]


def build(items: list[tuple[str | None, bytes]], window: int = 10) -> bytes:
    """The frozen suffix automaton of one block of items: arrays of links, lengths and sorted transitions, and for
    each state whose strings can be windows, or whole short items, the items that hold them."""
    ids: dict[bytes, int] = {}
    after: list[dict[int, int]] = [{}]
    link, length = [-1], [0]

    def new(size: int, up: int, to: dict[int, int]) -> int:
        length.append(size)
        link.append(up)
        after.append(to)
        return len(length) - 1

    def clone(p: int, c: int, q: int) -> int:
        copy = new(length[p] + 1, link[q], dict(after[q]))
        link[q] = copy
        while p >= 0 and after[p].get(c) == q:
            after[p][c] = copy
            p = link[p]
        return copy

    def extend(last: int, c: int) -> int:
        there = after[last].get(c)
        if there is not None:
            return there if length[there] == length[last] + 1 else clone(last, c, there)
        made, p = new(length[last] + 1, 0, {}), last
        while p >= 0 and c not in after[p]:
            after[p][c] = made
            p = link[p]
        if p >= 0:
            q = after[p][c]
            link[made] = q if length[q] == length[p] + 1 else clone(p, c, q)
        return made

    held, pairs, names, number = [], set(), [], {}
    for name, text in items:
        seq = [ids.setdefault(w, len(ids) + 1) for w in words_of(text)]
        if seq:
            if name is not None and name not in number:
                number[name] = len(names)
                names.append(name)
            held.append((-1 if name is None else number[name], seq))
            pairs.update(zip(seq, seq[1:], strict=False))
            last = 0
            for c in seq:
                last = extend(last, c)
    # a second walk, now that no state changes: which items stand at the states of windows and of whole short items
    at_window, at_short = set(), set()
    for name, seq in held:
        s = 0
        for e, c in enumerate(seq, 1):
            s = after[s][c]
            if e >= window:
                w = s
                while length[link[w]] >= window:
                    w = link[w]
                at_window.add((w, name))
        if len(seq) < window:
            at_short.add((s, len(seq), name))
    n = len(length)
    lasting = sorted((s << 32 | c, t) for s, to in enumerate(after) for c, t in to.items())
    # the next state along the links, itself included, at which short items end
    ends = np.zeros(n, bool)
    ends[[s for s, _, _ in at_short]] = True
    short = [-1] * n
    for s in sorted(range(1, n), key=length.__getitem__):
        short[s] = s if ends[s] else short[link[s]]
    table = np.zeros(_SLOTS, bool)
    if pairs:
        a = np.array(list(pairs), np.int64)
        table[_slot(a[:, 0], a[:, 1])] = True
    x = sorted(at_short)
    out = io.BytesIO()
    np.savez(
        out, words=np.frombuffer(b" ".join(ids), np.uint8), names=np.frombuffer("\0".join(names).encode(), np.uint8), many=np.array([len(names)]),
        keys=np.array([k for k, _ in lasting], np.int64), to=np.array([t for _, t in lasting], np.int32), link=np.array(link, np.int32), length=np.array(length, np.int32), short=np.array(short, np.int32),
        window_start=_groups(at_window, n)[0].astype(np.int32), window_items=_groups(at_window, n)[1].astype(np.int32),
        short_start=np.searchsorted([s for s, _, _ in x], np.arange(n + 1)).astype(np.int32), short_size=np.array([m for _, m, _ in x], np.int32), short_items=np.array([i for _, _, i in x], np.int32),
        pairs=np.packbits(table), least=np.array([min([window, *(len(q) for _, q in held)])]),
    )
    return out.getvalue()


class ItemAutomaton:
    """A frozen automaton as `build` makes it, and the search through it."""

    def __init__(self, frozen: bytes, window: int = 10):
        x = np.load(io.BytesIO(frozen))
        self.window, self.least = window, int(x["least"][0])
        self.id = {w: k for k, w in enumerate(x["words"].tobytes().split(b" "), 1)} if len(x["words"]) else {}
        self.names = x["names"].tobytes().decode().split("\0") if x["many"][0] else []
        plain = lambda name, kind: array(kind, x[name].tobytes())
        self.keys, self.to = plain("keys", "q"), plain("to", "i")
        self.link, self.length, self.short = (plain(n, "i") for n in ("link", "length", "short"))
        self.window_start, self.window_items = plain("window_start", "i"), plain("window_items", "i")
        self.short_start, self.short_size, self.short_items = (plain(f"short_{n}", "i") for n in ("start", "size", "items"))
        self.pairs = np.unpackbits(x["pairs"]).astype(bool)

    def step(self, state: int, c: int) -> int:
        """The state after one more word; -1 where there is none."""
        key = state << 32 | c
        k = bisect_left(self.keys, key)
        return self.to[k] if k < len(self.keys) and self.keys[k] == key else -1

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Word ranges (end exclusive, ascending, apart) inside occurrences, and the named items that have them."""
        n = len(words)
        if not self.id or n < self.least:
            return [], set()
        seq = np.fromiter(map(self.id.get, words, [0] * n), np.int64, n)
        if self.least == 1:
            good, extra = seq > 0, 1
        else:
            good, extra = self.pairs[_slot(seq[:-1], seq[1:])] & (seq[:-1] > 0) & (seq[1:] > 0), 2
        if np.count_nonzero(good) < self.least - extra + 1:
            return [], set()
        edge = np.flatnonzero(np.diff(np.concatenate([[False], good, [False]]).astype(np.int8)))
        first, stop = edge[::2], edge[1::2] + extra - 1
        found: list[tuple[int, int]] = []
        items: set[int] = set()
        done: set[int] = set()
        for k in np.flatnonzero(stop - first >= self.least):
            state = size = 0
            at = int(first[k])
            for e, c in enumerate(seq[at : stop[k]].tolist(), at + 1):
                to = self.step(state, c)
                while to < 0 and state:
                    state = self.link[state]
                    size = self.length[state]
                    to = self.step(state, c)
                if to >= 0:
                    state, size = to, size + 1
                span = 0
                if size >= self.window:
                    span, s = self.window, state
                    while self.length[self.link[s]] >= self.window:
                        s = self.link[s]
                    if s not in done:
                        done.add(s)
                        items.update(self.window_items[self.window_start[s] : self.window_start[s + 1]])
                s = self.short[state]
                while s >= 0:
                    for j in range(self.short_start[s], self.short_start[s + 1]):
                        if self.short_size[j] <= size:
                            span = max(span, self.short_size[j])
                            items.add(self.short_items[j])
                    s = self.short[self.link[s]]
                if span:
                    a = e - span
                    if found and a <= found[-1][1]:
                        found[-1] = (min(a, found[-1][0]), e)
                    else:
                        found.append((a, e))
        return _merged(found), {self.names[i] for i in items if i >= 0}


class ItemAutomata:
    """The automata of some blocks; what any of them finds is found."""

    def __init__(self, frozen: list[bytes], window: int = 10):
        self.each = [ItemAutomaton(f, window) for f in frozen]

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        found = [a.hits(words) for a in self.each]
        if len(found) == 1:
            return found[0]
        return _merged(r for ranges, _ in found for r in ranges), {x for _, names in found for x in names}


def loads(sizes: dict[int, int], most: int) -> list[list[int]]:
    """Blocks in loads of at most `most` bytes together, or of one block that has more."""
    out: list[list[int]] = []
    full = 0
    for block, size in sorted(sizes.items()):
        if not out or full + size > most:
            out.append([])
            full = 0
        out[-1].append(block)
        full += size
    return out


def _merged(ranges) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(text: bytes, ranges: list[tuple[int, int]]) -> bytes:
    """The text without the words of the ranges and what stands between them."""
    at = [m.span() for m in re.finditer(rb"[^ ]+", text.translate(_KEEP))]
    out, last = [], 0
    for a, b in ranges:
        out.append(text[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, text[last:]])


def item_blocks(items: DataFrame, id_col: str, text_col: str, window: int, block_words: int) -> DataFrame:
    """`(block, frozen)`: the automata of the items, dealt by a hash into blocks of about `block_words` words.

    An item of more words is cut into pieces that overlap by a window less one word, which holds the same windows.
    """

    def split(batches):
        for b in batches:
            names, texts, sizes = [], [], []
            for name, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                w = words_of(t)
                for at in range(0, max(1, len(w) - window + 1) if w else 0, block_words):
                    piece = w[at : at + block_words + window - 1]
                    names.append(name)
                    texts.append(b" ".join(piece))
                    sizes.append(len(piece))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary()), pa.array(sizes, pa.int64())], names=["name", "t", "n"])

    d = items.select(F.col(id_col).cast("string").alias("name"), text_bytes(text_col).alias("t")).mapInArrow(split, "name string, t binary, n long")
    d = stored(d.dropDuplicates(["name", "t"]))
    blocks = max(1, -(-(d.agg(F.sum("n")).first()[0] or 0) // block_words))
    d = d.select(F.pmod(F.xxhash64("t", "name"), F.lit(blocks)).cast("int").alias("block"), "name", "t")

    def freeze(key, rows):
        named = sorted(zip(rows.column("name").to_pylist(), rows.column("t").to_pylist(), strict=True), key=lambda r: (r[0] or "", r[1]))
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "frozen": pa.array([build(named, window)], pa.binary())})

    return stored(d.groupBy("block").applyInArrow(freeze, "block int, frozen binary"))


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, block_words: int = 500_000, load_bytes: int = 1 << 27, keep: list[str] | None = None, cut_limit: float | None = None) -> DataFrame:
    """`(id_col, *keep, n_words, n_hit, items)` for every row of `docs`; items are the names found, sorted.

    The automata travel to the tasks in loads of about `load_bytes` (a block of 500,000 words has 26 MB): neither the
    driver nor a task holds more. With one load the documents pass once, without a shuffle. With more, each pass keeps
    what it finds by a hash of the text (128 bits), and a last join brings the finds together. Null and empty texts have no words; an empty item table hits nothing;
    items without an id hit but are not named; repeated rows are judged alike. With `cut_limit` two columns follow:
    `clean`, the text without its hit spans, and `drop`, whether more than that share of the words is hit.
    """
    keep = keep or []
    sc = docs.sparkSession.sparkContext
    df = docs.select(F.col(id_col).alias("leak_id"), *[F.col(c).alias(f"keep_{c}") for c in keep], text_bytes(text_col).alias("leak_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields[:-1])
    more = "n_words long, n_hit long, items array<string>" + (", clean string, drop boolean" if cut_limit is not None else "")
    out = df.columns[:-1] + [x.split()[0] for x in more.split(", ")]
    lead = len(keep) + 1

    def columns(texts: list[bytes], sizes, ranges, names) -> list:
        hit = [sum(y - x for x, y in r) for r in ranges]
        cols = [pa.array(sizes, pa.int64()), pa.array(hit, pa.int64()), pa.array([sorted(x) for x in names], pa.list_(pa.string()))]
        if cut_limit is not None:
            cols.append(pa.array([without(t, r).decode() if r else t.decode() for t, r in zip(texts, ranges, strict=True)], pa.string()))
            cols.append(pa.array([h > cut_limit * n for h, n in zip(hit, sizes, strict=True)], pa.bool_()))
        return cols

    def judge(sent):
        def run(batches):
            sam = None
            for b in batches:
                sam = sam or ItemAutomata(sent.value, window)
                texts = b.column(lead).to_pylist()
                words = [words_of(t) for t in texts]
                found = [sam.hits(w) for w in words]
                yield pa.RecordBatch.from_arrays([*b.columns[:lead], *columns(texts, list(map(len, words)), [r for r, _ in found], [x for _, x in found])], names=out)

        return run

    def search(sent):
        def run(batches):
            sam = ItemAutomata(sent.value, window)
            for b in batches:
                keys, ranges, names = [], [], []
                for t in b.column(0).to_pylist():
                    r, x = sam.hits(words_of(t))
                    if r:
                        keys.append(xxhash.xxh3_128_digest(t))
                        ranges.append([y for z in r for y in z])
                        names.append(sorted(x))
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ranges, pa.list_(pa.int32())), pa.array(names, pa.list_(pa.string()))], names=["key", "ranges", "names"])

        return run

    def digest(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([xxhash.xxh3_128_digest(t) for t in b.column(lead).to_pylist()], pa.binary())], names=[*b.schema.names, "key"])

    def finish(batches):
        for b in batches:
            texts = b.column(lead).to_pylist()
            ranges = [_merged(zip(r[::2], r[1::2], strict=True)) if r else [] for r in b.column(lead + 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:lead], *columns(texts, [len(words_of(t)) for t in texts], ranges, [x or [] for x in b.column(lead + 2).to_pylist()])], names=out)

    frozen = item_blocks(items, item_id, item_text, window, block_words)
    every = loads({r["block"]: r["n"] for r in frozen.select("block", F.octet_length("frozen").alias("n")).collect()}, load_bytes)
    load = lambda ks: sc.broadcast([bytes(r["frozen"]) for r in frozen.where(F.col("block").isin(ks)).select("frozen").toLocalIterator()])
    if len(every) <= 1:
        sent = load(every[0]) if every else sc.broadcast([build([], window)])
        d = df.mapInArrow(judge(sent), f"{kinds}, {more}")
    else:
        passes = []
        for ks in every:
            sent = load(ks)
            passes.append(stored(df.select("leak_text").mapInArrow(search(sent), "key binary, ranges array<int>, names array<string>").dropDuplicates(["key"])))
            sent.unpersist()
        finds = passes[0]
        for p in passes[1:]:
            finds = finds.unionByName(p)
        finds = finds.groupBy("key").agg(F.flatten(F.collect_list("ranges")).alias("ranges"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"))
        d = join_few(df.mapInArrow(digest, f"{kinds}, leak_text binary, key binary"), finds, ["key"], "leak_id", 8).drop("key")
        d = d.select(*df.columns, "ranges", "names").mapInArrow(finish, f"{kinds}, {more}")
    return d.withColumnsRenamed({"leak_id": id_col, **{f"keep_{c}": c for c in keep}})
