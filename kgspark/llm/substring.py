"""Substring de-duplication by relative Lempel-Ziv parsing against indexed reference blocks.

A window is `window` consecutive words; it is repeated if its words also start in a row with a smaller id.

1. Anchors. Of every text the k-grams that are least (by hash) in some window are its anchors; equal windows
   hold the same anchor at the same place. One grouping gives each anchor's first and last row (combined
   before the shuffle); an anchor of one row can lie in no repeated window.
2. Blocks. The stretches around the shared anchors of which a row is the first holder form that row's
   reference block; other rows' stretches go to the blocks of their anchors' first holders. Stretches are
   grouped by content first, so copies of a stretch cost one row however many there are.
3. Parsing. A stretch is factored greedily from left to right into the longest factors found in its block
   (through an index of the block's k-grams). Factors of at least `window` words are repeated spans;
   windows that start in a factor and end behind it are looked up in the block's index of windows too.
4. What the parsing leaves undecided (windows whose first holder is not their anchor's first holder) is
   settled exactly by one grouping on window hashes. A window that some factor has covered needs no say
   there: its earliest holder is left undecided itself and is in the grouping.

Windows are told apart by 64 bits of hash, equal stretches of a block by 64 bits and their number of words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_few, stored, text_bytes
from .wordhash import gram_hashes, joined_words, portions, word_edges, word_hashes


def hashed(pieces: list[bytes], k: int, window: int):
    """For each piece (words joined by one space) the hashes of its words, k-grams and windows; many pieces are hashed together."""
    for at, stop in portions(pieces, 1 << 22):
        h = word_hashes(b" ".join(pieces[at:stop]))[0]
        grams, windows = gram_hashes(h, k), gram_hashes(h, window)
        base = 0
        for p in pieces[at:stop]:
            n = p.count(b" ") + 1
            yield h[base : base + n], grams[base : base + max(0, n - k + 1)], windows[base : base + max(0, n - window + 1)]
            base += n


def sliding(x: np.ndarray, w: int, pick) -> np.ndarray:
    """Least or greatest of every w neighbours, by doubling the width covered."""
    width = 1
    while 2 * width <= w:
        x = pick(x[:-width], x[width:])
        width *= 2
    return pick(x[: len(x) - (w - width)], x[w - width :]) if width < w else x


def anchors(texts: list[bytes], window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, place and hash of the k-grams that are least in some window of a text; all of several equal ones."""
    _, h, of = joined_words(texts)
    g, w = gram_hashes(h, k), window - k + 1
    if len(g) < w:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    least = sliding(g, w, np.minimum)
    least[of[window - 1 :] != of[: len(least)]] = 0  # runs from one text into the next
    wide = np.zeros(len(g) + w - 1, np.uint64)
    wide[w - 1 : len(g)] = least
    at = np.flatnonzero(sliding(wide, w, np.maximum) == g)
    first = np.searchsorted(of, np.arange(len(texts)))
    return of[at], at - first[of[at]], g[at]


def stretches(places: np.ndarray, n: int, window: int, k: int) -> list[tuple[int, int]]:
    """Word ranges that hold all windows around the given anchors; overlapping ones are one."""
    out: list[list[int]] = []
    for p in places.tolist():
        a, b = max(0, p - window + k), min(n, p + window)
        if out and a <= out[-1][1]:
            out[-1][1] = b
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


class Automaton:
    """Suffix automaton of a block's words: walking it from the root spells the block's factors, however often they stand there."""

    def __init__(self, words: list[int]):
        self.next: list[dict[int, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in words:
            made, p = len(length), last
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = made
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] > length[p] + 1:
                    copy = len(length)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    link[q] = copy
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = copy
                        p = link[p]
                    q = copy
                link[made] = q
            last = made

    def longest(self, words: list[int], i: int) -> int:
        """Length of the longest factor that starts at place i."""
        state, m = 0, i
        while m < len(words):
            state = self.next[state].get(words[m])
            if state is None:
                break
            m += 1
        return m - i


class Block:
    """One reference block: its words' hashes, and where each k-gram and which windows stand in it."""

    def __init__(self, window: int, k: int):
        self.window, self.k = window, k
        self.words: list[int] = []
        self.at: dict[int, list[int]] = {}
        self.windows: set[int] = set()
        self.automaton: Automaton | None = None

    def add(self, h: np.ndarray, grams: np.ndarray, windows: np.ndarray) -> None:
        base = len(self.words)
        for i, g in enumerate(grams.tolist(), base):
            self.at.setdefault(g, []).append(i)
        self.windows.update(windows.tolist())
        self.words += h.tolist()
        self.words.append(-1)  # factors do not run from one stretch into the next
        self.automaton = None

    def factors(self, h: np.ndarray, grams: np.ndarray) -> list[tuple[int, int]]:
        """Greedy parse: (start, length) of the longest factor at each step; length 1 where nothing matches.

        A factor is looked for at the places of its first k-gram. Where these are too many (a text that repeats
        itself) the block's automaton takes over, which finds the same factors in steps of one word.
        """
        words, grams, out, i, n = h.tolist(), grams.tolist(), [], 0, len(h)
        tried, most = 0, 8 * (n + len(self.words))
        while i < n:
            best = 0
            places = self.at.get(grams[i], ()) if i < len(grams) else ()
            tried += len(places)
            if tried > most and places:
                if self.automaton is None:
                    self.automaton = Automaton(self.words)
                best, places = self.automaton.longest(words, i), ()
            for r in places:
                if best and (r + best >= len(self.words) or self.words[r + best] != words[i + best]):
                    continue  # cannot become longer than the best so far
                m = 0
                while words[i + m : i + m + 64] == self.words[r + m : r + m + 64] and i + m < n:
                    m = min(m + 64, n - i)
                while i + m < n and self.words[r + m] == words[i + m]:
                    m += 1
                tried += m // 8
                if m > best:
                    best = m
                    if i + m == n:
                        break
            out.append((i, max(best, 1)))
            i += max(best, 1)
        return out

    def repeated(self, h: np.ndarray, grams: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """For each window of the stretch whether the block holds it: by factors, and by look-up at their boundaries."""
        n = len(windows)
        found = np.zeros(n, bool)
        if not n:
            return found
        edge = np.zeros(n, bool)
        for i, m in self.factors(h, grams):
            if m >= self.window:
                found[i : i + m - self.window + 1] = True
            edge[max(0, i + m - self.window + 1) : min(n, i + m)] = True
        at = np.flatnonzero(edge & ~found)
        if len(at):
            found[at] = [g in self.windows for g in windows[at].tolist()]
        return found


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, k: int = 5, stretches_per_task: int = 2000) -> DataFrame:
    """`(id_col, spans)` of the rows that hold repeated windows; spans are word ranges, flat: start, end, start, end, …

    Ids are longs; rows without one are left out, and windows of rows with equal ids do not repeat each other.
    """
    d = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("t"))

    def find_anchors(batches):
        for b in batches:
            ids, texts = b.column(0).to_numpy(), b.column(1).to_pylist()
            for x, y in portions(texts):
                of, _, g = anchors(texts[x:y], window, k)
                order = np.lexsort((g, of))
                of, g = of[order], g[order]
                first = np.ones(len(g), bool)
                first[1:] = (g[1:] != g[:-1]) | (of[1:] != of[:-1])
                yield pa.RecordBatch.from_arrays([pa.array(g[first].view(np.int64)), pa.array(ids[x:y][of[first]])], names=["g", "id"])

    a = d.mapInArrow(find_anchors, "g long, id long")
    shared = a.groupBy("g").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("g", "first")
    mine = a.join(shared, "g").groupBy("id").agg(F.collect_list(F.struct("g", "first")).alias("held"))

    def cut(batches):
        for b in batches:
            out: dict[str, list] = {n: [] for n in ("block", "key", "n", "id", "start", "own", "words")}
            held = b.column(2)
            ends, held = held.offsets.to_numpy() - held.offsets[0].as_py(), held.flatten()
            grams, firsts = held.field("g").to_numpy(), held.field("first").to_numpy()
            texts = b.column(1).to_pylist()
            places = [(at[u:v], g[u:v]) for x, y in portions(texts) for of, at, g in [anchors(texts[x:y], window, k)] for edge in [np.searchsorted(of, np.arange(y - x + 1))] for u, v in zip(edge[:-1], edge[1:], strict=True)]
            for i, t, lo, hi, (at, g) in zip(b.column(0).to_pylist(), texts, ends[:-1].tolist(), ends[1:].tolist(), places, strict=True):
                first, last = word_edges(t)
                order = np.argsort(grams[lo:hi])
                mine, holder = grams[lo:hi][order], firsts[lo:hi][order]
                where = np.minimum(np.searchsorted(mine, g.view(np.int64)), hi - lo - 1)
                there = mine[where] == g.view(np.int64)
                at, holder = at[there], holder[where[there]]
                order = np.argsort(holder, kind="stable")
                at, holder = at[order], holder[order]
                cuts = np.flatnonzero(np.diff(holder)) + 1
                for f, at in zip(holder[np.concatenate([[0], cuts])].tolist() if len(holder) else (), np.split(at, cuts)):
                    for x, y in stretches(at, len(first), window, k):
                        piece = b" ".join(t[first[x] : last[y - 1]].split())
                        for name, v in zip(out, (f, xxhash.xxh3_64_intdigest(piece) - (1 << 63), y - x, i, x, f == i, piece), strict=True):
                            out[name].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True)], names=list(out))

    pieces = stored(d.join(mine, "id").mapInArrow(cut, "block long, key long, n int, id long, start int, own boolean, words binary"))
    # equal stretches of one block are parsed once; a block with many is copied to as many tasks as it needs
    others = pieces.where("NOT own").groupBy("block", "key", "n").agg(F.first("words").alias("words"))
    parts = others.groupBy("block").agg(F.ceil(F.count("*") / stretches_per_task).cast("int").alias("parts")).where("parts > 1")
    dealt = join_few(others, parts, ["block"], "key")
    part = F.coalesce(F.pmod(F.xxhash64("key"), F.col("parts")), F.lit(0)).cast("int")
    dealt = dealt.select("block", part.alias("part"), "key", "n", F.lit(None).cast("long").alias("id"), F.lit(None).cast("int").alias("start"), "words")
    own = pieces.where("own").join(parts, "block", "left")
    own = own.select("block", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"), F.lit(None).cast("long").alias("key"), "n", "id", "start", "words")
    # references first (their key is null), then what is parsed against them
    rows = dealt.unionByName(own).repartition("block", "part").sortWithinPartitions("block", "part", F.col("key").asc_nulls_first())

    def parse(batches):
        now, block = None, None
        for b in batches:
            out: dict[str, list] = {n: [] for n in ("block", "key", "n", "id", "start", "found", "left")}
            columns = [c.to_pylist() for c in b.columns]
            for f, part, key, n, i, start, (h, grams, g) in zip(*columns[:-1], hashed(columns[-1], k, window), strict=True):
                if now != (f, part):
                    now, block = (f, part), Block(window, k)
                if key is None:
                    block.add(h, grams, g)
                    found = np.zeros(len(g), bool)
                    if part:
                        continue
                else:
                    found = block.repeated(h, grams, g)
                for name, v in zip(out, (f, key, n, i, start, np.packbits(found).tobytes(), g[~found].tobytes()), strict=True):
                    out[name].append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, kind) for v, kind in zip(out.values(), kinds, strict=True)], names=list(out))

    parsed = stored(rows.mapInArrow(parse, "block long, key long, n int, id long, start int, found binary, left binary"))
    said = ["found", "left"]
    members = pieces.where("NOT own").select("block", "key", "n", "id", "start").join(parsed.where("key IS NOT NULL").select("block", "key", "n", *said), ["block", "key", "n"])
    judged = members.select("id", "start", *said).unionByName(parsed.where("key IS NULL").select("id", "start", *said))

    def undecided(batches):
        for b in batches:
            ids, at, grams = [np.empty(0, np.int64)], [np.empty(0, np.int32)], [np.empty(0, np.uint64)]
            for i, s, found, left in zip(*[c.to_pylist() for c in b.columns], strict=True):
                g = np.frombuffer(left, np.uint64)
                if len(g):
                    bits = np.unpackbits(np.frombuffer(found, np.uint8))
                    ids.append(np.full(len(g), i, np.int64))
                    at.append((s + np.flatnonzero(bits == 0)[: len(g)]).astype(np.int32))
                    grams.append(g)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(ids)), pa.array(np.concatenate(at))], names=["g", "id", "at"])

    def covered(batches):
        for b in batches:
            ids, spans = [], []
            for i, s, found, _ in zip(*[c.to_pylist() for c in b.columns], strict=True):
                at = np.flatnonzero(np.unpackbits(np.frombuffer(found, np.uint8)))
                if len(at):
                    ids.append(i)
                    spans.append(ranges(s + at, window))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(spans, pa.list_(pa.int32()))], names=["id", "spans"])

    left = judged.mapInArrow(undecided, "g long, id long, at int")
    first = left.groupBy("g").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("g", "first")
    late = left.join(first, "g").where("id > first").groupBy("id").agg(F.collect_list("at").alias("at"))
    late = late.select("id", F.flatten(F.transform("at", lambda x: F.array(x, x + window))).alias("spans"))
    every = judged.mapInArrow(covered, "id long, spans array<int>").unionByName(late)
    return every.groupBy("id").agg(F.flatten(F.collect_list("spans")).alias("spans")).withColumnRenamed("id", id_col)


def ranges(at: np.ndarray, window: int) -> list[int]:
    """Flat word ranges covered by windows that start at the ascending places `at`."""
    cut = np.flatnonzero(np.diff(at) > window) + 1
    out: list[int] = []
    for x in np.split(at, cut):
        out += [int(x[0]), int(x[-1]) + window]
    return out


def remove_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13, k: int = 5) -> DataFrame:
    """`(id_col, n_words, n_removed, kept)` for every row; kept are the words outside repeated windows, joined by one space.

    Windows are judged on the input. Null and empty texts have no words; repeated rows (equal ids) are
    treated alike; rows without an id keep all words; an empty table gives an empty one.
    """
    spans = duplicate_spans(docs, id_col, text_col, window, k).withColumnRenamed(id_col, "span_id")
    d = docs.select(F.col(id_col).alias("id"), text_bytes(text_col).alias("t"))
    joined = d.join(spans, d["id"].cast("long") == spans["span_id"], "left").select("id", "t", "spans")
    kind = docs.schema[id_col].dataType.simpleString()

    def apply(batches):
        for b in batches:
            n, gone, kept = [], [], []
            for t, spans in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = t.split()
                n.append(len(words))
                if spans:
                    hit = np.zeros(len(words) + 1, np.int32)
                    np.add.at(hit, spans[::2], 1)
                    np.add.at(hit, spans[1::2], -1)
                    stay = np.cumsum(hit)[:-1] == 0
                    words = [w for w, s in zip(words, stay.tolist(), strict=True) if s]
                gone.append(n[-1] - len(words))
                kept.append(b" ".join(words).decode())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["id", "n_words", "n_removed", "kept"])

    return joined.mapInArrow(apply, f"id {kind}, n_words long, n_removed long, kept string").withColumnRenamed("id", id_col)
