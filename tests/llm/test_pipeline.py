"""The stages in their order, each on what the one before kept."""

import random

import corpus_pipeline
from kgspark.llm import simhash_sets
from kgspark.llm.common import checkpointed

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "pii", "mixing"]
    counts = [docs.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = checkpointed(stage(spark, docs, SF))
        counts.append(docs.count())
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert docs.select("doc_id").distinct().count() == counts[-1]
            assert docs.where("n_chars <> length(text)").count() == 0
    assert counts[0] >= counts[1] >= counts[2] >= counts[3] >= counts[4] > 0
    assert docs.groupBy("doc_id").count().where("count > 3").count() == 0
    again = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, docs.collect()))


def changed(words, places):
    return " ".join(f"new{p}" if p in places else w for p, w in enumerate(words))


def jaccard_of(a, b):
    x, y = ({tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in (a, b))
    return len(x & y) / len(x | y)


def test_near_duplicates_at_similarity_0_8(spark):
    rng = random.Random(11)
    rows, pairs, apart = [], 0, []
    for k in range(60):
        n = rng.randrange(40, 300)
        words = [f"w{rng.randrange(3000)}" for _ in range(n)]
        few = [rng.randrange(2, n - 2) for _ in range(max(1, n // 50))]
        copy = changed(words, few)
        rows += [(2 * k, " ".join(words), "en", "a", 1), (2 * k + 1, copy, "en", "a", 1)]
        alike = jaccard_of(" ".join(words), copy)
        pairs += alike >= 0.8
        if alike < 0.8:
            apart.append(2 * k + 1)
    # a chain: neighbours are alike, ends are not
    base = [f"c{i}" for i in range(100)]
    chain = [" ".join(base[j : j + 92]) for j in range(0, 9, 4)]
    rows += [(1000 + j, t, "en", "a", 1) for j, t in enumerate(chain)]
    rows += [(2000, None, "en", "a", 0), (2001, " \n", "en", "a", 2), (2002, "One two", "en", "a", 7), (2003, "one  TWO", "en", "a", 8)]
    assert pairs > 20 and apart
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()}
    assert got == {*range(0, 120, 2), *apart, 1000, 2000, 2002}
    assert corpus_pipeline.near_duplicate_stage(spark, docs.limit(0), SF).count() == 0


def test_near_duplicates_of_a_hub(spark):
    """Copies that are alike to one text only, not to each other; in one task and in parts that meet."""
    rng = random.Random(5)
    base = [f"h{i}" for i in range(200)]
    texts = [" ".join(base)] + [changed([*base], {rng.randrange(4, 196) for _ in range(4)}).replace("new", f"n{k}x") for k in range(40)]
    texts += [" ".join(f"z{k}q{i}" for i in range(60)) for k in range(5)]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if jaccard_of(texts[i], texts[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    assert 2 < len(set(root)) < len(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows in (1000, 8):
        named = docs.select("doc_id", simhash_sets.node_of("text").alias("node")).join(simhash_sets.components(docs, group_rows=rows), "node", "left")
        got = {r.doc_id: r.root if r.root is not None else r.node for r in named.collect()}
        pairs = {(got[i], root[i]) for i in range(len(texts))}
        assert len(pairs) == len(set(root)) == len({a for a, _ in pairs})


def test_near_duplicates_keep_rows_without_or_with_shared_ids(spark):
    text = {k: " ".join(f"{k}{i}" for i in range(50)) for k in "abcdef"}
    rows = [(None, "a"), (None, "b"), (1, "b"), (2, "c"), (2, "d"), (2, "d"), (None, "e"), (None, "e"), (3, "f"), (2, "f")]
    docs = spark.createDataFrame([(i, text[k], "en", k, 1) for i, k in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(((r.doc_id or 0, r.source, r.text) for r in corpus_pipeline.near_duplicate_stage(spark, docs, SF).collect()))
    assert got == sorted((i, k, text[k]) for i, k in [(0, "a"), (1, "b"), (2, "c"), (2, "d"), (0, "e"), (2, "f")])


def test_mixing_takes_rows_without_or_with_shared_ids(spark):
    rows = [(None, "a b"), (None, "c d"), (1, "e f"), (1, "g h"), (2, "i j")]
    docs = spark.createDataFrame([(i, t, "en", "s", 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.mixing_stage(spark, docs, SF).collect()
    assert sorted((r.text, r.copy) for r in got) == [(t, 1) for _, t in rows]


def test_stages_take_awkward_rows(spark):
    text = " ".join(f"plain{i}" for i in range(60))
    rows = [(1, None), (2, ""), (3, text), (3, text), (3, text + " more"), (None, text + " other"), (4, "word " * 200_000)]
    docs = spark.createDataFrame([(i, t, "en", None, None, "x", 1.0, 2) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, node string, score double, copies int")
    empty = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        got = stage(spark, docs, SF)
        assert got.columns == [*corpus_pipeline.COLUMNS, *(["copy"] if k == 4 else [])], name
        assert got.count() <= 3 * len(rows), name
        assert sorted(map(repr, got.collect())) == sorted(map(repr, stage(spark, docs.repartition(5), SF).collect())), name
        assert stage(spark, empty, SF).count() == 0, name
