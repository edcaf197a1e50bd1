"""Word n-gram indicators for the text classifiers: counting by class, and sparse rows of a bounded sample.

A gram is known by its 64-bit hash. The grams of many texts are hashed together; a `grams` function takes a list of
texts and gives the hashes and, for each, the number of its text. Repeats inside a text are allowed: they count once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_bytes
from .wordhash import joined_words, mixed, portions, word_hashes

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_SHAPE = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
_RUN = np.array([c in b"aA0" for c in range(256)])
_SLOTS = 1 << 22  #: of the table that tells most unknown grams at once
_PART = 1 << 19  #: bytes of text whose grams are held together


def plain_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased words of letters and digits."""
    _, h, at = joined_words([t.translate(_WORDS) for t in texts])
    return h, at


def shape_and_word_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Indicators of word form and word order, of whole texts.

    Word unigrams and bigrams as they stand, and unigrams, bigrams and trigrams over shapes: letters of
    one case and digits shrink to one sign each, other signs stay, and a word equal to the one before it
    or the one before that is written `=`. The number of words gives one indicator by powers of two.
    """
    joined, w, at = joined_words(texts)
    raw = np.frombuffer(joined.translate(_SHAPE), np.uint8)
    again = np.zeros(len(raw), bool)
    again[1:] = (raw[1:] == raw[:-1]) & _RUN[raw[1:]]
    s = word_hashes(raw[~again].tobytes())[0]
    two, three = at[1:] == at[:-1], at[2:] == at[:-2]
    same = np.zeros(len(w), bool)
    same[2:] = three & ((w[2:] == w[1:-1]) | (w[2:] == w[:-2]))
    s = np.where(same, np.uint64(61), s)
    size = np.bincount(at, minlength=len(texts))
    odd = np.uint64(0x9E3779B97F4A7C15)

    def kind(k: int, h: np.ndarray) -> np.ndarray:
        return mixed(h + np.uint64(k) * np.uint64(0xBF58476D1CE4E5B9))

    with np.errstate(over="ignore"):
        pair, shapes = (w[:-1] * odd + w[1:])[two], (s[:-1] * odd + s[1:])[two]
        triple = ((s[:-2] * odd + s[1:-1]) * odd + s[2:])[three]
        length = np.frexp(size)[1].astype(np.uint64)
        h = np.concatenate([kind(1, w), kind(2, pair), kind(3, s), kind(4, shapes), kind(5, triple), kind(6, length)])
    return h, np.concatenate([at, at[:-1][two], at, at[:-1][two], at[:-2][three], np.arange(len(texts))])


def class_counts(texts: DataFrame, grams, classes: int) -> DataFrame:
    """`(gram, n0, n1, …)`: in how many texts of each class `y` a gram occurs; combined before the shuffle."""

    def run(batches):
        for b in batches:
            y, t = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
            for x, z in portions(t, _PART):
                h, at = grams(t[x:z])
                order = np.lexsort((at, h))
                h, at = h[order], at[order]
                first = np.ones(len(h), bool)
                first[1:] = (h[1:] != h[:-1]) | (at[1:] != at[:-1])
                h, of = h[first], y[x:z][at[first]]
                cut = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
                counts = [np.add.reduceat((of == k).astype(np.int64), cut) if len(cut) else cut for k in range(classes)]
                yield pa.RecordBatch.from_arrays([pa.array(h[cut].view(np.int64)), *map(pa.array, counts)], names=["gram", *names])

    names = [f"n{k}" for k in range(classes)]
    parts = texts.select("y", text_bytes("text").alias("t")).mapInArrow(run, "gram long, " + ", ".join(f"{n} long" for n in names))
    return parts.groupBy("gram").agg(*[F.sum(n).alias(n) for n in names])


def known_grams(counts: DataFrame) -> tuple[np.ndarray, ...]:
    """The grams of a bounded table of `class_counts` as ascending hashes, and their counts, on the driver."""
    got = counts.toArrow()
    grams = got.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(grams)
    return grams[order], *[got.column(c).to_numpy()[order].astype(np.float64) for c in counts.columns[1:]]


class Index:
    """Column numbers of known grams. A table of bits passes over most others before the search among the sorted ones."""

    def __init__(self, grams: np.ndarray):
        """`grams` ascending and distinct, as unsigned hashes."""
        self.grams = grams
        self.slots = np.zeros(_SLOTS, bool)
        self.slots[(grams & np.uint64(_SLOTS - 1)).astype(np.int64)] = True

    def columns(self, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Text number and column of each known gram, once for each text, in order."""
        maybe = self.slots[(h & np.uint64(_SLOTS - 1)).astype(np.int64)]
        h, at = h[maybe], at[maybe]
        if not len(h) or not len(self.grams):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        k = np.minimum(np.searchsorted(self.grams, h), len(self.grams) - 1)
        there = self.grams[k] == h
        both = np.unique(at[there] * len(self.grams) + k[there])
        return both // len(self.grams), both % len(self.grams)


def sparse_rows(texts: DataFrame, grams, index: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, row starts and column numbers of the sample's indicators; the sample is bounded by its caller."""
    sent = texts.sparkSession.sparkContext.broadcast(index)

    def run(batches):
        known = Index(sent.value)
        for b in batches:
            t = b.column(2).to_pylist()
            for x, z in portions(t, _PART):
                at, cols = known.columns(*grams(t[x:z]))
                stop = np.searchsorted(at, np.arange(z - x + 1))
                rows = pa.ListArray.from_arrays(pa.array(stop, pa.int32()), pa.array(cols.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(x, z - x), b.column(1).slice(x, z - x), rows], names=["sample_id", "y", "cols"])

    kind = texts.schema["sample_id"].dataType.simpleString()
    got = texts.select("sample_id", "y", text_bytes("text").alias("t")).mapInArrow(run, f"sample_id {kind}, y int, cols array<int>").toArrow()
    sent.unpersist()
    got = got.add_column(3, "n", pc.list_value_length(got.column("cols"))).sort_by([("sample_id", "ascending"), ("y", "ascending"), ("n", "ascending")])
    sizes, y = got.column("n").to_numpy().astype(np.int64), got.column("y").to_numpy().astype(np.int64)
    parts = [c.flatten().to_numpy() for c in got.column("cols").chunks]
    return y, np.concatenate([[0], np.cumsum(sizes)]), np.concatenate([np.empty(0, np.int32), *parts])


def scored(docs: DataFrame, id_col: str, text_col: str, grams, weights: tuple[np.ndarray, np.ndarray], finish, schema: str, *more) -> DataFrame:
    """Rows `(id, *more, *finish(sum of weights))`, one for each row of `docs`; whole texts, no shuffle.

    `weights` are the ascending hashes of the grams and their weights. `finish` takes the array of sums and returns
    one array for each column of `schema`.
    """
    context = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches):
        known, w = Index(context.value[0]), context.value[1]
        for b in batches:
            t = b.column(b.num_columns - 1).to_pylist()
            sums = np.zeros(len(t))
            for x, z in portions(t, _PART):
                at, cols = known.columns(*grams(t[x:z]))
                sums[x:z] = np.bincount(at, w[cols], z - x)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *[pa.array(x) for x in finish(sums)]], names=names)

    base = docs.select(F.col(id_col), *more, text_bytes(text_col).alias("text_as_bytes"))
    lead = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields[:-1])
    names = base.columns[:-1] + [x.split()[0] for x in schema.split(", ")]
    return base.mapInArrow(run, f"{lead}, {schema}")
