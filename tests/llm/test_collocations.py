"""Phrase collocations against a version that counts every n-gram in a dictionary, and on awkward rows."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from kgspark.llm import collocations
from kgspark.llm.bits import among, bit_table
from kgspark.llm.queries import op11_collocations

SCHEMA = "doc_id long, text string, lang string, phrase string, n long, w1 string, words string, f int"
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, longest, least, share, top):
    counts, total = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for size in range(1, longest + 1):
                for i in range(len(w) - size + 1):
                    counts[lang, tuple(w[i : i + size])] += 1
    out = {}
    found = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    for (lang, w), a in found.items():
        score, _, left, right = min((1_000_000 * a * a // (counts[lang, w[:k]] * counts[lang, w[k:]]), k, counts[lang, w[:k]], counts[lang, w[k:]]) for k in range(1, len(w)))
        inside = [b for (l2, v), b in found.items() if l2 == lang and len(v) > len(w) and any(v[i : i + len(w)] == w for i in range(len(v)))]
        if not any(100 * b >= share * a for b in inside):
            out.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    rows = []
    for lang, x in out.items():
        for rank, (s, a, p, left, right) in enumerate(sorted(x)[:top], 1):
            rows.append((lang, rank, p.decode(), -a, left, right, total[lang], -s))
    return sorted(rows)


def awkward(seed=5):
    rng = random.Random(seed)
    vocabulary = ["The", "the", "cat", "é😀", "a", "no break", "x-y", "sat", "\x00", "ß"]
    rows = [(None, "en"), ("", None), (" \t .,;\n\x0b\x0c\r!?:", ""), ("the cat", "und")]
    for k in range(120):
        text = "".join(rng.choice(vocabulary) + rng.choice([" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r"]) for _ in range(rng.randrange(40)))
        rows += [(text, ["en", "de", None, ""][k % 4])] * rng.choice([1, 1, 3])
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, lang, "x", 1, "w", None, 2) for i, (t, lang) in enumerate(rows)], SCHEMA)


@pytest.mark.parametrize(("longest", "top", "bits"), [(2, 2000, 26), (3, 2000, 26), (3, 7, 6), (4, 2000, 26)])
def test_counts_scores_and_ranks(spark, longest, top, bits):
    rows = awkward()
    got = collocations.collocations(frame(spark, rows), longest=longest, min_count=4, share=50, top=top, bits=bits, salts=3)
    want = brute([(t, lang) for t, lang in rows], longest, 4, 50, top)
    assert sorted(map(tuple, got.collect())) == want
    assert len(want) > 10


def test_long_texts_are_cut_and_counted_whole(spark, monkeypatch):
    rows = [(" ".join(["one two", "three four. five"] * 60), "en"), ("one two three " * 50, "en")]
    want = brute(rows, 3, 10, 50, 2000)
    monkeypatch.setattr(collocations, "_MOST", 37)
    assert sorted(map(tuple, collocations.collocations(frame(spark, rows)).collect())) == want


def test_an_empty_table_and_a_missing_pair(spark):
    assert collocations.collocations(frame(spark, [])).collect() == []
    assert collocations.collocations(frame(spark, [("a b", "en"), (None, None)])).collect() == []


def test_scores_pass_64_bits(spark):
    row = spark.range(1).selectExpr("10000000000000L as a", "30000000000000L as l", "10000000000000L as r")
    assert row.select(collocations._score("a", "l", "r")).first()[0] == 333_333


def test_bit_table_has_no_false_negatives(spark):
    h = np.random.default_rng(1).integers(0, 1 << 64, 1000, np.uint64)
    table = bit_table(spark.createDataFrame([(int(x),) for x in h[:500].view(np.int64)], "h long"), 12)
    assert among(table, h[:500]).all()
    assert among(table, h[500:]).mean() < 0.3
    assert not among(bit_table(spark.createDataFrame([], "h long"), 12), h).any()


def test_query_is_the_operator_over_the_whole_table(spark):
    assert op11_collocations(spark, "/root/testdata/sf0.001").columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
