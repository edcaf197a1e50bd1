"""Operators whose groups may be of any size: blocks, documents, lists and prompts."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kgspark.operators import order as w
from kgspark.operators import vectors as v
from kgspark.plans import reports
from kgspark.plans.triples import TRIPLE
from kgspark.sources import files

SCHEMA = "s string, p string, o string, o_kind string, o_type string, o_lang string"


def graph(spark, rows):
    return spark.createDataFrame([(s, p, o, k, None, None) for s, p, o, k in rows], SCHEMA)


def text_of(path):
    return "".join(p.read_text() for p in sorted(path.iterdir()) if p.name.startswith("part-"))


@pytest.fixture
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_lines_are_the_blocks_with_a_subject_over_many_ranges(spark, tmp_path, many_ranges):
    rng = random.Random(4)
    rows = [("hub", f"p{rng.randrange(9)}", f"o{i}", "iri") for i in range(3000)] + [(f"s{rng.randrange(40)}", "p", f'quote " {i}\n', "literal") for i in range(300)]
    rows += rows[:50] + [("a", "p", "only", "iri"), ("z", "p", "last", "iri")]
    g = graph(spark, rows).repartition(7)
    lines = files.turtle_lines(g).orderBy("place").collect()
    assert [r.place for r in lines] == list(range(1, len(lines) + 1))
    blocks = {r.s: r.block for r in files.turtle_blocks(g).collect()}
    got = {}
    for r in lines:
        got.setdefault(r.s, []).append(r.line.strip())
    assert {s: " ".join(x) for s, x in got.items()} == blocks
    assert list(got) == sorted(got)
    # the hub lies in more than one range, so the table of ranges was needed
    assert files.dealt(g.select("s", files.turtle_part().alias("part")).distinct(), None, ["s", "part"]).where("s = 'hub'").select("part_").distinct().count() > 1
    files.write_turtle_blocks(g, str(tmp_path / "ttl"), [("x", "urn:x#"), ("y", "urn:y#")])
    want = "@prefix x: <urn:x#> .\n@prefix y: <urn:y#> .\n" + "".join(f"{r.line}\n" for r in lines)
    assert text_of(tmp_path / "ttl") == want


def test_lines_of_an_empty_and_a_small_graph(spark, tmp_path):
    assert files.turtle_lines(graph(spark, [])).collect() == []
    assert [r.line for r in files.turtle_lines(graph(spark, [("a", "p", "b", "iri")])).collect()] == ["<a> p <b> ."]
    files.write_turtle_blocks(graph(spark, []), str(tmp_path / "none"), [("x", "urn:x#")])
    assert text_of(tmp_path / "none") == "@prefix x: <urn:x#> .\n"


def test_a_hub_of_a_million_triples(spark):
    d = spark.range(1_000_000).select(F.lit("hub").alias("s"), F.lit("p").alias("p"), F.format_string("o%07d", "id").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_type"), F.lit(None).cast("string").alias("o_lang"))
    lines = files.turtle_lines(d.select(*TRIPLE))
    n = lines.agg(F.count("*").alias("n"), F.max("place").alias("last"), F.sum(F.col("line").endswith(" .").cast("int")).alias("ends"), F.sum(F.col("line").startswith("<hub>").cast("int")).alias("opens"), F.sum((F.col("line").contains("o") & (F.regexp_extract("line", "o([0-9]+)", 1).cast("long") == F.col("place") - 1)).cast("int")).alias("right")).first()
    assert tuple(n) == (1_000_000, 1_000_000, 1, 1, 1_000_000)


def test_a_document_in_shards_reads_back_equal(spark, tmp_path):
    path = str(tmp_path / "doc")
    nodes = spark.range(2500).select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("id"), F.when(F.col("id") % 3 > 0, F.col("id")).alias("size"), F.lit('é "\n,').alias("label")).repartition(5)
    meta, none = nodes.agg(F.count("*").alias("n")), nodes.where("id = 'x'")
    files.write_shards(path, meta, rows_per_shard=300, nodes=nodes, none=none)
    index = {(r.graph, r.shard): (r["first"], r.rows) for r in files.read_index(spark, path).collect()}
    assert index == {("meta", 0): (1, 1)} | {("nodes", k): (300 * k + 1, min(300, 2500 - 300 * k)) for k in range(9)}
    back = files.read_shards(spark, path, "nodes", "id string, size long, label string")
    assert sorted(map(tuple, back.drop("shard").collect()), key=repr) == sorted(map(tuple, nodes.collect()), key=repr)
    assert files.read_shards(spark, path, "none", "id string").count() == files.read_shards(spark, path, "unknown", "id string").count() == 0
    whole = json.loads("".join(files.document_pieces(spark, path)))
    assert whole["meta"] == {"n": 2500} and sorted(whole) == ["meta", "nodes"]
    texts = [json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in whole["nodes"]]
    assert texts == sorted(texts) and len(texts) == 2500
    # written again: the new document is read, and only folders that some kept version names stay
    for n in (10, 20, 30):
        files.write_shards(path, meta, nodes=nodes.limit(n))
    assert files.read_shards(spark, path, "nodes", "id string").count() == 30
    assert len([p for p in (tmp_path / "doc").iterdir() if p.name != "index"]) == 2


def test_a_document_of_a_million_nodes(spark, tmp_path):
    path = str(tmp_path / "big")
    nodes = spark.range(1_000_000).select("id", (F.col("id") % 7).alias("kind"))
    files.write_shards(path, nodes.agg(F.count("*").alias("n")), rows_per_shard=250_000, nodes=nodes)
    back = files.read_shards(spark, path, "nodes", "id long, kind long")
    assert back.select("id", "kind").exceptAll(nodes).count() == 0 and back.count() == 1_000_000
    assert {r["count"] for r in back.groupBy("shard").count().collect()} == {250_000}


def test_lists_are_null_beyond_their_bound(spark):
    rows = [(f"c{i}", "rdfs:subClassOf", "top", "iri") for i in range(30)] * 2 + [("c1", "rdfs:subClassOf", "other", "iri")]
    rows += [(f"i{i}", "rdf:type", "top", "iri") for i in range(5)] + [("q", "rdfs:domain", "top", "iri"), ("q", "rdfs:range", "c1", "iri")]
    got = {r["class"]: r for r in reports.class_report(graph(spark, rows), most=4, longest=10).collect()}
    top = got["top"]
    assert (top.n_children, top.children, top.individuals, top.members, top.domain_of, top.n_parents, top.parents) == (30, None, 5, None, ["q"], 0, None)
    assert got["other"].children == ["c1"] and got["c1"].parents == ["other", "top"] and got["c1"].range_of == ["q"]
    wide = graph(spark, [("q", "rdfs:domain", f"c{i}", "iri") for i in range(11)] + [("r", "rdfs:range", "x", "iri")])
    got = {r.property: (r.n_domains, r.domains, r.n_ranges, r.ranges) for r in reports.property_report(wide, longest=10).collect()}
    assert got == {"q": (11, None, 0, []), "r": (0, [], 1, ["x"])}


def test_a_class_of_a_million_children(spark):
    d = spark.range(1_000_000).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("s"), F.lit("rdfs:subClassOf").alias("p"), F.lit("top").alias("o"), F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_type"), F.lit(None).cast("string").alias("o_lang"))
    top = reports.class_report(d).where("class = 'top'").first()
    assert (top.n_children, top.children) == (1_000_000, None)


def test_prompts_in_blocks(spark):
    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(60)] + [(60, [0.0] * 4)]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    prompts = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(4)]) for i in range(40)] + [(40, [0.0] * 4)], "prompt long, prompt_vector array<double>")
    want = sorted(map(tuple, v.similarities(vectors, prompts).collect()))
    assert len(want) == 61 * 41
    for block in (7, 1):
        assert sorted(map(tuple, v.similarities(vectors, prompts, block=block).collect())) == want
    best = {}
    for i, p, c in want:
        if i not in best or c > best[i][1]:
            best[i] = (p, c)
    for block in (100, 7):
        assert {r.vec_id: (r.prompt, r.cosine) for r in v.nearest_prompt(vectors, prompts, block=block).collect()} == best
    assert v.nearest_prompt(vectors, prompts.limit(0)).collect() == []


def test_nearest_of_many_blocks_makes_no_large_table(spark):
    gen = np.random.default_rng(3)
    x = gen.normal(size=(3000, 64))
    y = np.concatenate([-x[:2000], -x[:1000]])  # a third of the prompts are copies: of equals the lowest
    vectors = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    prompts = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(y)], "prompt long, prompt_vector array<double>")
    spark.conf.set("spark.sql.maxBroadcastTableSize", 16 << 20)  # both tables have 1.5 MB
    try:
        got = {r.vec_id: (r.prompt, r.cosine) for r in v.nearest_prompt(vectors, prompts, block=64, tile=500).collect()}
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
    unit = lambda m: m / np.linalg.norm(m, axis=1)[:, None]
    cosines = unit(x) @ unit(y[:2000]).T
    assert {k: p for k, (p, _) in got.items()} == dict(enumerate(cosines.argmax(axis=1).tolist()))
    assert all(c == pytest.approx(cosines[k].max(), abs=1e-12) for k, (_, c) in got.items())


def test_nearest_prompt_of_awkward_vectors(spark):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [nan, 1.0]), (5, [1.0, 2.0, 3.0]), (6, []), (7, [0.0, 0.0]), (8, [3.0, 4.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    prompts = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [1.0, 0.0]), ("z", [0.0, 5.0]), (None, [3.0, 4.0]), ("c", None)], "prompt string, prompt_vector array<float>")
    got = {r.vec_id: (r.prompt, None if r.cosine is None else str(r.cosine)) for r in v.nearest_prompt(vectors, prompts).collect()}
    assert got == {1: ("a", "1.0"), 2: ("a", None), 3: ("a", None), 4: ("a", "nan"), 5: ("a", None), 6: ("a", None), 7: ("a", "0.0"), 8: (None, "1.0")}


def test_fifty_thousand_prompts(spark):
    vectors = spark.createDataFrame([(i, [1.0, i / 10]) for i in range(10)], "vec_id long, embedding array<double>")
    prompts = spark.range(50_000).select(F.col("id").alias("prompt"), F.array(F.lit(1.0), F.col("id") / 10).alias("prompt_vector"))
    got = {r.vec_id: (r.prompt, r.cosine) for r in v.nearest_prompt(vectors, prompts).collect()}
    assert {k: p for k, (p, _) in got.items()} == {k: k for k in range(10)}
    assert all(c == pytest.approx(1.0) for _, c in got.values())


def test_only_files_of_enough_bytes_are_opened(spark, tmp_path):
    for name, content in (("a.gif", b"GIF89a"), ("b.gif", b"GI"), ("c.gif", b""), ("d.png", b"GIF")):
        (tmp_path / name).write_bytes(content)
    d = files.read_contents(spark, str(tmp_path), "*.gif", least=3)
    assert [(r.path.rsplit("/", 1)[1], bytes(r.content)) for r in d.collect()] == [("a.gif", b"GIF89a")]
    assert "length" in d._jdf.queryExecution().executedPlan().toString().partition("PushedFilters")[2]


def test_running_sums_and_grids_of_groups_over_many_ranges(spark, many_ranges):
    rng = random.Random(12)
    rows = [(rng.choice(["big"] * 6 + ["a", "z", None]), rng.choice([None, 1, 2, 7]), i) for i in range(1500)]
    df = spark.createDataFrame(rows, "g string, v long, i long").repartition(5)
    got = w.running(df, "g", ["i"], F.col("v"), "sum").collect()
    total = {}
    for g, x, i in sorted(rows, key=lambda r: r[2]):
        total[g] = total.get(g, 0) + (x or 0)
        assert next(r["sum"] for r in got if r.i == i) == total[g]
    assert w.dealt(df, "g", ["i"]).where("g = 'big'").select("part_").distinct().count() > 1
    cells = {r.i: (r.grid_col, r.grid_row) for r in w.grid(df, "g", ["i"], 4).collect()}
    base = 0
    for g in (None, "a", "big", "z"):
        own = sorted(r[2] for r in rows if r[0] == g)
        assert all(cells[i] == (base + k // 4, k % 4) for k, i in enumerate(own))
        base += -(-len(own) // 4)


def test_folders_by_value_keep_null_and_odd_values(spark, tmp_path):
    rows = [(1, "a"), (2, "a b/c=d"), (3, None), (4, "é"), (5, "a")]
    d = spark.createDataFrame(rows, "id long, kind string")
    files.write_folders(d, str(tmp_path / "f"), "kind")
    assert sorted(map(tuple, files.read_folders(spark, str(tmp_path / "f"), "id long", "kind").collect())) == rows
    assert len([p for p in (tmp_path / "f").iterdir() if p.is_dir()]) == 4
