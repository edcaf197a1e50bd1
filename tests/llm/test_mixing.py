"""The mix against a plain version, and how near it comes to its targets."""

import hashlib
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from kgspark.llm import mixing

SF = "/root/testdata"


def plain_copies(rows, r, u, largest):
    """Copies by id for one source, rows as (size, hash, id)."""
    rows = sorted(rows)
    top, rest = rows[::-1][:largest], rows[: max(0, len(rows) - largest)]
    out, upto, taken = {}, 0, 0
    for size, _, i in top:
        upto += size
        out[i] = min(max(math.floor((r * upto - taken) / size + u), 0), 3) if size else 0
        taken += out[i] * size
    left = sum(x[0] for x in rows) - upto
    share = min(max((r * sum(x[0] for x in rows) - taken) / left, 0.0), 3.0) if left else 0.0
    for k, (_, _, i) in enumerate(rest, 1):
        out[i] = min(math.floor(k * share + u) - math.floor((k - 1) * share + u), 3)
    return out


@pytest.mark.parametrize("largest", [1, 5, 256])
def test_copies_are_those_of_the_plain_version(spark, largest):
    rng = random.Random(8)
    rows = [(i, " ".join("w" * 1 for _ in range(rng.choice([0, 1, 3, 9, 40, 400]))), rng.choice(["a", "a", "a", "b", "ü", None])) for i in range(700)]
    rows += [(1000 + i, "w " * 5, f"one{i}") for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {x.doc_id: x for x in mixing.mix(df, largest=largest).collect()}
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((len(t.split()), hashlib.md5(str(i).encode()).hexdigest(), i))
    for s, own in by.items():
        total = sum(x[0] for x in own)
        u = int(hashlib.md5(f"{s or ''}#9".encode()).hexdigest()[:8], 16) / 2**32
        r = got[own[0][2]].target / total
        want = plain_copies(own, r, u, largest)
        assert {i: got[i].copies for _, _, i in own} == want
        if largest > len(own):
            least = min(x[0] for x in own if x[0])
            assert abs(sum(got[i].copies * got[i].size for _, _, i in own) - r * total) <= least or r > 2.9


@pytest.mark.parametrize(("sf", "most"), [("sf0.01", 0.01), ("sf0.1", 0.005)])
def test_taken_words_are_near_the_targets(spark, sf, most):
    docs = spark.read.parquet(f"{SF}/{sf}/documents.parquet")
    d = mixing.mix(docs).join(docs.select("doc_id", "source"), "doc_id")
    by = d.groupBy("source").agg(F.max("target").alias("target"), F.sum(F.col("copies") * F.col("size")).alias("taken"), F.max("copies").alias("copies"))
    for r in by.collect():
        assert abs(r.taken - r.target) <= most * r.target and r.copies <= 3


def test_one_huge_document_and_rows_alike(spark):
    rows = [(1, "w " * 100_000, "s"), *[(i, "w w w", "s") for i in range(2, 50)], *[(7, "w w w", "s")] * 3, (99, "w " * 50_000, "t")]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 3 for r in got)
    again = mixing.mix(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string"))
    assert sorted(map(tuple, got)) == sorted(map(tuple, again.collect()))
