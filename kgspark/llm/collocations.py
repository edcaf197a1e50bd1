"""Phrase collocations by top-order marginalisation.

Only the longest windows are counted: each word stands with the words that follow it in its piece, padded at the
piece's end. Spark's ROLLUP sums the windows over successively shorter prefixes, which gives the occurrences of every
shorter phrase and of every word; no shorter n-gram is exploded.

Nearly all windows occur once or twice and would fill the shuffle with their words. So a first pass counts the hashes of
windows and their prefixes, and a window is padded after its longest prefix that is frequent enough for a candidate.
That pads no candidate and no part of one, and the counts stay exact: a table of bits of fixed size tells the frequent
hashes, with false positives only.
"""

from __future__ import annotations

import re
from collections import defaultdict
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .bits import BITS, among, bit_table
from .common import stored, text_bytes
from .wordhash import mixed, portions

_CUT = 0xFF  #: ends a piece; no byte of UTF-8
_FOLD = bytes(c + 32 if 65 <= c <= 90 else _CUT if c in b".,;:!?" or 10 <= c <= 13 else c for c in range(256))
_TOKEN = re.compile(rb"\xff|[^\x20\x09\xff]+")
_MOST = 1 << 21  #: bytes of text that are coded together


def _tokens(folded: bytes) -> list[bytes]:
    return folded.replace(b"\xff", b" \xff ").split()


def _token_lists(texts: list[bytes], longest: int):
    """Token lists of about `_MOST` bytes, each with the number of tokens whose windows are its own.

    A longer text is cut between words; the tokens that follow a cut are added, since windows reach over it.
    """
    for x, z in portions(texts, _MOST):
        folded = b"\xff".join(texts[x:z]).translate(_FOLD)
        at = 0
        while len(folded) - at > 2 * _MOST:
            space = re.compile(rb"[\x20\x09\xff]").search(folded, at + _MOST)
            stop = space.start() if space else len(folded)
            own = _tokens(folded[at:stop])
            yield own + [m[0] for m in islice(_TOKEN.finditer(folded, stop), longest)], len(own)
            at = stop
        own = _tokens(folded[at:])
        yield own, len(own)


def _coded(tokens: list[bytes], own: int, longest: int) -> tuple[pa.Array, list[np.ndarray]]:
    """The distinct tokens, and for each word the codes of its window, -1 where padded: the lead columns."""
    coded = pa.array(tokens, pa.binary()).dictionary_encode()
    codes, names = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    cut = names.index(pa.scalar(b"\xff", pa.binary())).as_py()
    codes = np.concatenate([codes, np.full(longest, cut)])
    at = np.flatnonzero(codes[:own] != cut)
    lead = [codes[at]]
    for k in range(1, longest):
        c = codes[at + k]
        lead.append(np.where((lead[-1] < 0) | (c == cut), -1, c))
    return names, lead


def _prefix_hashes(names: pa.Array, lang: str, lead: list[np.ndarray]):
    """For each length from 2 on: the windows that are not padded before it, and the hashes of that many of their words."""
    h = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in names.to_pylist()), np.uint64, len(names))
    of = mixed(h[lead[0]] + np.full(1, xxhash.xxh3_64_intdigest(lang.encode()), np.uint64))
    for c in lead[1:]:
        there = np.flatnonzero(c >= 0)
        of[there] = mixed(of[there] * np.uint64(0x9E3779B97F4A7C15) + h[c[there]])
        yield there, of[there]


def _by_lang(batch: pa.RecordBatch):
    texts = defaultdict(list)
    for lang, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
        texts[lang].append(t)
    return texts.items()


def _prefixes(longest: int):
    """Arrow batches to `(h, n)`: hashed prefixes of windows, of two words or more, and how often they occur in a part of the batch."""

    def run(batches):
        for b in batches:
            for lang, texts in _by_lang(b):
                for tokens, own in _token_lists(texts, longest):
                    names, lead = _coded(tokens, own, longest)
                    for _, h in _prefix_hashes(names, lang, lead):
                        h, n = np.unique(h, return_counts=True)
                        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return run


def _windows(longest: int, sent):
    """Arrow batches to `(lang, w1, …, n)`: windows, and how often they occur in a part of the batch."""
    words = [f"w{k + 1}" for k in range(longest)]

    def run(batches):
        for b in batches:
            for lang, texts in _by_lang(b):
                for tokens, own in _token_lists(texts, longest):
                    names, lead = _coded(tokens, own, longest)
                    for k, (there, h) in enumerate(list(_prefix_hashes(names, lang, lead)), 1):
                        rare = there[~among(sent.value, h)]
                        for later in lead[k:]:
                            later[rare] = -1
                    key = lead[0]
                    for c in lead[1:]:
                        key = np.unique(key, return_inverse=True)[1] * (len(names) + 1) + c + 1
                    _, first, n = np.unique(key, return_index=True, return_counts=True)
                    spelled = pa.concat_arrays([names, pa.array([b""], pa.binary())]).cast(pa.string(), safe=False)
                    cols = [spelled.take(pa.array(np.where(c[first] < 0, len(names), c[first]))) for c in lead]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(first), pa.string()), *cols, pa.array(n)], names=["lang", *words, "n"])

    return run


def phrase_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, min_count: int = 10, bits: int = BITS) -> DataFrame:
    """`(lang, words, f)`: every phrase of at most `longest` words with `min_count` or more occurrences in its
    language; the row without words counts all words of the language.

    Every part of such a phrase is as frequent, so it is there too.
    """
    d = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), text_bytes(text_col).alias("t"))
    # nearly all hashes of a task are distinct already, so they are dealt before they are summed
    often = d.mapInArrow(_prefixes(longest), "h long, n long").repartition("h").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count)
    sent = docs.sparkSession.sparkContext.broadcast(bit_table(often.select("h"), bits))
    words = [f"w{k + 1}" for k in range(longest)]
    windows = d.mapInArrow(_windows(longest, sent), "lang string, " + ", ".join(f"{w} string" for w in words) + ", n long")
    # a column that is rolled up is null, one that is padded is empty
    names = ", ".join(words)
    sums = docs.sparkSession.sql(f"SELECT lang, {names}, sum(n) AS f FROM {{windows}} GROUP BY lang, ROLLUP({names}) HAVING sum(n) >= {int(min_count)}", windows=windows)
    phrase = F.array_compact(F.array(*words))
    return sums.where(~F.array_contains(phrase, "")).select("lang", phrase.alias("words"), "f")


def _score(a: str, left: str, right: str) -> Column:
    """floor(10^6 a^2 / (left right)) in 38 decimal digits; a is at most left and right, so the result is at most 10^6."""
    d = "cast({} as decimal(20, 0))".format
    return F.expr(f"cast((1000000 * {d(a)} * {d(a)}) div ({d(left)} * {d(right)}) as long)")


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 3, min_count: int = 10, share: int = 50, top: int = 2000, salts: int = 64, bits: int = BITS) -> DataFrame:
    """`(lang, rank, phrase, a, l, r, n, score)`: each language's `top` phrases of 2 to `longest` words.

    Texts are lower-cased (A-Z), cut into pieces at `.,;:!?` and line ends, and pieces into words at spaces and tabs.
    a, l, r and n count a phrase, the two parts of its lowest-scoring cut, and all words of the language, repeats and
    overlaps included. A phrase inside a longer one that has at least `share` percent of its occurrences is dropped.
    Equal scores stand by a, then by the phrase's bytes; of equal cuts the one after the fewest words counts.

    A null language is `und` and falls together with one of that name; null and empty texts have no words; repeated
    rows count as often as they occur; an empty table gives an empty one. Other columns are not read. Very long texts
    are cut between words, and windows reach over the cuts.
    """
    f = stored(phrase_counts(docs, text_col, lang_col, longest, min_count, bits))
    parts = f.where(F.size("words") > 0).select("lang", F.array_join("words", " ").alias("part"), F.col("f").alias("of_part"))
    total = f.where(F.size("words") == 0).select("lang", F.col("f").alias("n"))
    found = f.where(F.size("words") > 1).select("lang", F.array_join("words", " ").alias("phrase"), F.col("f").alias("a"), "words")

    def piece(start, size):
        return F.array_join(F.slice("words", start, size), " ")

    cut = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    cuts = found.select("*", cut).select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("head"), piece(F.col("k") + 1, F.size("words") - F.col("k")).alias("tail"))
    cuts = cuts.join(parts.select("lang", F.col("part").alias("head"), F.col("of_part").alias("l")), ["lang", "head"])
    cuts = cuts.join(parts.select("lang", F.col("part").alias("tail"), F.col("of_part").alias("r")), ["lang", "tail"])
    best = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(_score("a", "l", "r").alias("score"), "k", "l", "r")).alias("c"))

    sizes = F.explode(F.sequence(F.lit(2), F.size("words") - 1)).alias("size")
    inner = found.where(F.size("words") > 2).select("lang", "a", "words", sizes)
    inner = inner.select("*", F.explode(F.sequence(F.lit(1), F.size("words") - F.col("size") + 1)).alias("start"))
    inner = inner.groupBy("lang", piece(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = best.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < share * F.col("a")))
    kept = kept.select("lang", "phrase", "a", "c.l", "c.r", "c.score")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a language with most of the phrases is ranked in parts first, of which each keeps `top`
    salted = W.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(salts))).orderBy(*order)
    kept = kept.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    ranked = kept.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
