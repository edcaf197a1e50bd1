"""Edge cases of the operators on small invented rows."""

import random

import pytest
from pyspark.sql import functions as F

from kgspark import queries as registered
from kgspark import storage
from kgspark.functions import extract as x
from kgspark.functions import scalars as c
from kgspark.operators import aggregates as a
from kgspark.operators import filters as d
from kgspark.operators import joins as j
from kgspark.operators import order as w
from kgspark.operators import vectors as v
from kgspark.plans import match as m
from kgspark.plans import reports as r
from kgspark.plans import subset as sub
from kgspark.plans import triples as t
from kgspark.sources import files
from kgspark.streaming import jobs


def col(spark, values, kind="string"):
    return spark.createDataFrame([(i, x) for i, x in enumerate(values)], f"i int, x {kind}")


def ev(df, expression):
    return [row[0] for row in df.select(expression.alias("y"), "i").orderBy("i").select("y").collect()]


def graph(spark, *rows):
    return spark.createDataFrame([tuple(q) + (None,) * (6 - len(q)) for q in rows], t.SCHEMA)


def test_scalars(spark):
    text = col(spark, [None, "", "  ", "Red ", "box", "x", "max"])
    assert ev(text, c.split_origin(F.col("x"), {"red": "R", "x": "X"}, "contains")["platform"]) == ["Unknown", "Unknown", "Unknown", "R", "X", "X", "X"]
    assert ev(text, c.split_origin(F.col("x"), {"red": "R", "x": "X"})["work"]) == [None, None, None, None, "box", None, "max"]
    years = col(spark, ["199x", " 2010 ", "1994", "2009", "2015", "2016", "2021", None])
    assert ev(years, c.year_bucket(F.col("x"))["period"]) == ["Unknown", "Period2010to2015", "Pre2010", "Pre2010", "Period2010to2015", "Period2016to2020", "Period2021toPresent", "Unknown"]
    assert ev(years, c.year_bucket(F.col("x"))["year"])[:2] == [None, 2010]
    names = col(spark, ["9 lives", "__", "Ünï-cöde!", None, "a  b"])
    assert ev(names, c.local_name_for(F.col("x"))) == ["_9_lives", "Unknown", "Ünï-cöde", "Unknown", "a_b"]
    assert ev(col(spark, ["It's  A (Test)!", "--Ä b--"]), c.slug_from_title(F.col("x"))) == ["its-a-test", "ä-b"]
    assert ev(col(spark, ["it's 4u now", "a-b"]), c.title_from_slug(F.col("x"))) == ["It's 4u Now", "A B"]
    urls = col(spark, ["http://a/b.GIF?x=1.png", "http://a.com", "b/c.jpeg#z", "http://a/.hidden", "http://a/b/"])
    assert ev(urls, c.url_extension(F.col("x"))) == [".gif", "", ".jpeg", "", ""]
    assert ev(urls, c.extension_for(F.col("x"), F.lit("image/webp"))) == [".gif", ".webp", ".jpeg", ".webp", ".webp"]
    assert ev(col(spark, ["0001_cat.v2.jpg", "/x/y/12_dog.png", "plain"]), c.slug_from_file(F.col("x"))) == ["cat.v2", "12_dog", "plain"]
    assert ev(col(spark, [None, "", '["a","b"]', "solo"]), c.as_array(F.col("x"))) == [[], [], ["a", "b"], ["solo"]]
    assert ev(col(spark, [" 12 ", "1.5", None, "x"]), c.safe_long(F.col("x"), -1)) == [12, -1, -1, -1]
    odd = ['a"b\\n\n\t', "\\", "\\\\n", "é"]
    assert ev(col(spark, odd), c.unescape_literal(c.escape_literal(F.col("x")))) == odd
    assert ev(col(spark, [None, [], ["Image Macro", " odd "]], "array<string>"), c.map_list(F.col("x"), {"image macro": "ImageMacro"})) == [["Unknown"], ["Unknown"], ["ImageMacro", "odd"]]
    rgb = spark.createDataFrame([(0, 255.0, 0.0, 0.0), (1, 10.0, 10.0, 10.0), (2, None, 1.0, 1.0), (3, 0.0, 0.0, 255.0)], "i int, r double, g double, b double")
    assert [tuple(q) for q in ev(rgb, c.rgb_to_hsl(F.col("r"), F.col("g"), F.col("b")))] == [(0.0, 100.0, 50.0), (0.0, 0.0, 3.9), (0.0, 0.0, 0.0), (240.0, 100.0, 50.0)]


def test_hsl_rounds_as_sql_does_and_can_leave_nulls(spark):
    rows = [(0, 451 / 2, 258 / 2, 51 / 2), (1, 458 / 3, 267 / 3, 58 / 3), (2, 524 / 5, 477 / 5, 124 / 5), (3, None, 1.0, 3.0), (4, 7.0, None, 7.0), (5, None, None, None)]
    rgb = spark.createDataFrame(rows, "i int, r double, g double, b double")
    got = [tuple(q) for q in ev(rgb, c.rgb_to_hsl(F.col("r"), F.col("g"), F.col("b"), zeros=False))]
    assert [h for h, _, _ in got[:3]] == [31.1, 31.4, 53.0]  # 31.049999999999997 * 10 is 310.5
    assert got[3:] == [(None, 50.0, 0.8), (0.0, 0.0, 2.7), (None, None, None)]


def test_extraction(spark):
    assert ev(col(spark, ["1,234 views", "1.5", "no digits", None]), x.parse_count(F.col("x"))) == [1234, 15, None, None]
    html = '<script>var a="<p>no</p>"</script><h2>About</h2><!-- <p>no</p> --><p class="z">Yes <b>this</b>\n one</p><p>two</p>'
    assert ev(col(spark, [html, "<p>x</p>", None]), x.first_paragraph_after(F.col("x"), "<h2[^>]*>\\s*About")) == ["Yes this one", None, None]
    assert ev(col(spark, ["a?page=2&page=10", "nothing", None]), x.max_page(F.col("x"))) == [10, 1, 1]
    counted = ["<b>1,002 Photos</b>", "page 1 of 30", "<i>x</i><i>y</i>", "", None]
    assert ev(col(spark, counted), x.count_with_fallback(F.col("x"), "<i>")) == [1002, 30, 2, None, None]


def test_filters(spark):
    df = spark.createDataFrame([(1, "a", "Worldwide thing"), (2, "b", None), (3, None, "a thinging")], "id int, k string, text string")
    assert [q.id for q in d.without_keywords(df, "text", ["THING"]).orderBy("id").collect()] == [2, 3]
    assert d.without_keywords(df, "text", []).count() == 3
    assert [q.id for q in d.drop_impossible(df, df.where("id = 1"), ["k"]).orderBy("id").collect()] == [2, 3]
    assert ev(col(spark, [None, " ", "None", "Unknown", "x"]), d.is_known(F.col("x"))) == [False, False, False, False, True]
    assert ev(col(spark, [1994, 1995, 2026, 2027, None], "int"), d.in_range(F.col("x"), 1995, 2026)) == [False, True, True, False, False]


def test_joins(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "y"), (3, None, None)], "k int, p string, q string")
    new = spark.createDataFrame([(1, "", "n"), (2, "b", None), (9, "z", "z")], "k int, p string, q string")
    got = [tuple(q) for q in j.sync(old, new, "k", ["p", "q"]).orderBy("k").collect()]
    assert got == [(1, "a", "n", 1), (2, "b", "y", 0), (3, None, None, 0)]
    emptied = [tuple(q) for q in j.sync(old, new, "k", ["p", "q"], keep_if_empty=False).orderBy("k").collect()]
    assert emptied == [(1, "", "n", 2), (2, "b", None, 1), (3, None, None, 0)]
    left = col(spark, ["abc", "abcdef", "zz", "qrs", None])
    right = spark.createDataFrame([("abcd",), ("abc",), ("q",), ("qrstu",), ("_zz",), ("z",), (None,)], "r string")
    assert {tuple(q) for q in j.prefix_match(left, right, "x", "r").collect()} == {("abc", "abc"), ("abcdef", "abc"), ("qrs", "q"), ("zz", "_zz")}


def test_aggregates(spark):
    dup = spark.createDataFrame([("s", 1, "v1", "keep"), ("s", 2, "v2", " "), ("t", 3, None, None)], "k string, n int, v string, carry string")
    assert {tuple(q) for q in a.merge_duplicates(dup, "k", "n", ["carry"]).collect()} == {("s", 2, "v2", "keep"), ("t", 3, None, None)}
    vals = spark.createDataFrame([("a", -1), ("a", None), ("b", 4), ("b", 0)], "k string, v int")
    assert [tuple(q) for q in a.mean_of_valued(vals, "k", "v").collect()] == [("b", 2.0, 2, 2), ("a", 0.0, 2, 0)]
    ties = col(spark, ["z", "z", "y", "y", "x"])
    assert [q.x for q in a.top(ties, "x", 2).collect()] == ["y", "z"]
    folded = a.top_or_other(ties.withColumn("g", F.lit(1)), "g", "x", 1)
    assert folded.agg(F.sum("n"), F.sum("ratio")).first() == (5, 1.0)
    assert ev(col(spark, ["R", None, "q"]), w.ordinal(F.col("x"), ["Q", "R"])) == [2, 0, 0]
    big = spark.range(1000).select((F.col("id") % 7).alias("v"), "id").repartition(5)
    got = [(q.v, q.id, q["rank"]) for q in w.ranked(big, "v", "id").collect()]
    assert sorted(q[2] for q in got) == list(range(1, 1001)) and [q[:2] for q in sorted(got, key=lambda q: q[2])] == sorted((q[:2] for q in got), key=lambda q: (-q[0], q[1]))
    assert w.sample(big, "id", 10, 1).collect() == w.sample(big.repartition(2), "id", 10, 1).collect()


def test_triples(spark):
    g = graph(spark, ("a", "rdf:type", "C", "iri"), ("a", "p", "b", "iri"), ("a", "p", "b", "iri"), ("b", "label", "x", "literal", "s", "en"), ("b", "label", "x", "literal", "s", "de"), ("c", "p", "b", "literal"))
    assert t.as_set(g).count() == 5
    once = t.add_inverses(g, [("p", "q")])
    assert once.count() == 6 and t.remove(t.add_inverses(once, [("p", "q")]), once).count() == 0
    assert once.where("p = 'q'").count() == 1
    assert t.remove_node(g, "b").count() == 2
    df = spark.createDataFrame([("s", None, ["x", "", None, "x"]), (None, "v", ["y"]), ("u", " ", None)], "s string, v string, many array<string>")
    made = t.to_triples(df, F.col("s"), [t.Fact("v", F.col("v")), t.Fact("m", F.col("many"), "iri", many=True)])
    assert [(q.s, q.p, q.o) for q in made.collect()] == [("s", "m", "x"), ("s", "m", "x")]
    assert m.ask(g, [("?x", "p", "?y"), ("?y", "label", "?z")]).first().answer and not m.ask(g, [("?x", "p", "?x")]).first().answer
    opt = m.match(g, [("?x", "p", "?y")], optional=[[("?x", "rdf:type", "?t")]])
    assert sorted((q.x, q.y, q.t) for q in opt.collect() if q.t) == [("a", "b", "C")] * 2 and opt.where("t IS NULL").count() == 1
    subset = sub.extract_subset(g, sub.seeds(g, "C", ["p"]), ["p"], [], ["C"], [])
    assert t.remove(subset, g).count() == 0 and {q.s for q in subset.collect()} == {"a", "b"}
    assert r.leftovers(g, ["p"]).first().asDict() == {"p": "p", "left_over": 2, "n": 3}


def test_lines(spark, tmp_path):
    rows = [("s", "p", 'q"u\\o\nte', "literal", None, "en"), ("s", "p", '5"@en .', "literal", "xsd:int", None), ("s", "p", "n", "iri"), ("s", "p", "b1", "bnode"), ("s", "p", "é", "literal"), ("s", "p", "ends \\", "literal")]
    g = graph(spark, *rows)
    files.write_ntriples(g, str(tmp_path / "nt"))
    back = files.read_ntriples(spark, str(tmp_path / "nt"))
    assert sorted(map(repr, back.collect())) == sorted(map(repr, g.collect()))
    files.write_triples(g, str(tmp_path / "t"))
    assert files.read_triples(spark, str(tmp_path / "t")).count() == 6
    files.write_turtle_blocks(g, str(tmp_path / "ttl"), [("x", "urn:x#")])
    assert spark.read.text(str(tmp_path / "ttl")).where("value LIKE '@prefix%'").count() == 1


def test_sources(spark, tmp_path):
    (tmp_path / "r.json").write_bytes(b"\xef\xbb\xbf" + b'[{"id": 1, "tags": ["a"]}, {"id": 2}]')
    assert files.read_records(spark, str(tmp_path / "r.json"), "id long, tags array<string>").orderBy("id").collect() == [(1, ["a"]), (2, None)]
    (tmp_path / "k.json").write_text('{"1": {"h": 2.5}, "0002": {"h": 1}}')
    assert sorted(map(tuple, files.read_keyed(spark, str(tmp_path / "k.json"), "h: double").collect())) == [("0001", 2.5), ("0002", 1.0)]
    assert files.read_first(spark, [str(tmp_path / "none.json"), str(tmp_path / "r.json")], "id long").count() == 2
    assert files.read_first(spark, [str(tmp_path / "none.json")], "id long").count() == 0
    for k, folder in enumerate(("one", "two words")):
        (tmp_path / "f" / folder).mkdir(parents=True)
        (tmp_path / "f" / folder / "metadata.json").write_text(f'{{"id": {k}}}\n')
        (tmp_path / "f" / folder / f"pic_{k}7.gif").write_bytes(b"GIF89a")
    got = files.read_partitioned_folders(spark, str(tmp_path / "f"), "id long", "metadata.json")
    assert sorted(map(tuple, got.collect())) == [(0, "one"), (1, "two words")]
    assert files.read_partitioned_folders(spark, str(tmp_path / "f"), "id long", "metadata.json", only=["one"]).count() == 1
    assert sorted(q.file_id for q in files.list_files(spark, str(tmp_path / "f"), "*.gif").collect()) == [7, 17]
    content = spark.read.format("binaryFile").option("pathGlobFilter", "*.gif").option("recursiveFileLookup", True).load(str(tmp_path / "f"))
    assert content.where(d.starts_with_bytes(F.col("content"))).count() == 2
    files.write_document(str(tmp_path / "doc"), got.agg(F.count("*").alias("n")), rows=got)
    assert files.read_current(spark, str(tmp_path / "doc" / "rows"), "id long, folder string").count() == 2


def test_overwrite_shows_old_or_new(spark, tmp_path):
    root = str(tmp_path / "t")
    files.write_records(spark.range(3), root)
    first = storage.newest(spark, root)
    (tmp_path / "t" / "v0000000001").mkdir()  # a write that was broken off: no _SUCCESS
    (tmp_path / "t" / "v0000000001" / "part-0.parquet").write_bytes(b"half")
    assert storage.newest(spark, root) == first and files.read_current(spark, root, "id long").count() == 3
    files.write_records(spark.range(5), root)
    assert files.read_current(spark, root, "id long").count() == 5 and spark.read.parquet(first).count() == 3
    files.write_records(spark.range(7), root)
    assert len(storage.versions(spark, root)) == 2 and files.read_current(spark, root, "id long").count() == 7


def test_backfill_survives_a_replayed_batch(spark, tmp_path):
    table, fresh, check = (str(tmp_path / n) for n in ("table", "fresh", "check"))
    jobs.start_table(spark.createDataFrame([(1, None), (2, "b"), (3, None)], "k long, v string"), table)
    start = lambda: jobs.backfill(jobs.stream(spark, fresh, "k long, v string", files_per_batch=1), table, "k", ["v"], check)
    rows = lambda: sorted(map(tuple, spark.read.parquet(jobs.current(spark, table)).collect()))
    spark.createDataFrame([(1, "x"), (2, "no"), (9, "no")], "k long, v string").coalesce(1).write.parquet(fresh)
    start().awaitTermination()
    want = [(1, "x"), (2, "b"), (3, None)]
    assert rows() == want
    # the version was published, but the batch's own commit was lost
    done = storage.versions(spark, table)
    (tmp_path / "check" / "commits" / "0").unlink()
    (tmp_path / "check" / "commits" / ".0.crc").unlink(missing_ok=True)
    start().awaitTermination()
    assert rows() == want and storage.versions(spark, table) == done
    # and one that broke off while the version was written
    (tmp_path / "check" / "commits" / "0").unlink()
    (tmp_path / "check" / "commits" / ".0.crc").unlink(missing_ok=True)
    (tmp_path / "table" / done[-1] / "_SUCCESS").unlink()
    start().awaitTermination()
    assert rows() == want
    spark.createDataFrame([(3, "y")], "k long, v string").coalesce(1).write.mode("append").parquet(fresh)
    start().awaitTermination()
    assert rows() == [(1, "x"), (2, "b"), (3, "y")]


def test_groups_over_many_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["big"] * 8 + ["small", None]), rng.randrange(50), i) for i in range(2000)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(6)
    got = {r.i: (r.stack_start, r.stack_end) for r in w.running_stack(df, "g", "v", "i").collect()}
    total = {}
    for g, v, i in sorted(rows, key=lambda r: (-r[1], r[2])):
        start = total.get(g, 0)
        total[g] = start + v
        assert got[i] == (start, start + v)
    cells = {r.i: (r.grid_col, r.grid_row) for r in w.grid(df.where("g IS NOT NULL"), "g", ["v", "i"], 7).collect()}
    base = 0
    for g in ("big", "small"):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1], r[2]))
        assert all(cells[r[2]] == (base + k // 7, k % 7) for k, r in enumerate(own))
        base += -(-len(own) // 7)
    first = {r.g: r.i for r in w.keep_first(df, [F.col("g")], ["v", "i"]).collect()}
    assert first == {g: min((r[1], r[2]) for r in rows if r[0] == g)[1] for g in ("big", "small", None)}
    odd = {r.g: r.n_different for r in a.differs_from_reference(df.withColumn("v", F.nullif(F.col("v") % 3, F.lit(0))), "g", "i", "v").collect()}
    for g in ("big", "small", None):
        own = sorted((r for r in rows if r[0] == g), key=lambda r: r[2])
        assert odd[g] == sum((r[1] % 3) != (own[0][1] % 3) for r in own)


def test_the_first_row_is_one_with_an_order_and_ties_are_settled(spark):
    rows = [("nulls", None, 1, "x"), ("nulls", 1, None, "x"), ("nulls", 1, 2, "y"), ("nulls", 2, 0, "x"), ("only", None, None, "x"), ("only", None, 3, "y")]
    rows += [("tie", 1, 1, "b"), ("tie", 1, 1, None), ("tie", 1, 1, "b"), ("two", 1, 1, "b"), ("two", 1, 1, "a"), ("two", 1, 1, "b"), ("two", 2, 0, None)]
    for some in (rows, rows[::-1]):
        df = spark.createDataFrame(some, "g string, i int, j int, v string").repartition(3)
        assert {r.g: r.n_different for r in a.differs_from_reference(df, "g", ["i", "j"], "v").collect()} == {"nulls": 3, "only": 1, "tie": 2, "two": 3}


def test_storage_is_shared_and_can_be_dropped(spark):
    path = storage.scratch(spark, "x")
    assert path.startswith(spark.sparkContext.getCheckpointDir())
    spark.range(3).write.parquet(path)
    before = storage.state_of(spark, path)
    spark.range(3).write.mode("append").parquet(path)
    assert before and storage.state_of(spark, path) != before


def test_vectors(spark):
    df = spark.createDataFrame([(1, [3.0, 4.0], 0), (2, [0.0, 0.0], 1), (3, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert ev(df.withColumnRenamed("vec_id", "i"), v.normalise(F.col("embedding"))) == [[pytest.approx(0.6), pytest.approx(0.8)], [0.0, 0.0], [1.0, 0.0]]
    s = v.softmax(v.similarities(df, v.first_prompts(df)))
    assert all(abs(q.t - 1) < 1e-9 for q in s.groupBy("vec_id").agg(F.sum("p").alias("t")).collect())
    assert {q.vec_id: q.label for q in v.best_label(s).collect()} == {1: 0, 2: 0, 3: 0}
    one = sorted(map(tuple, v.similarities(df, v.first_prompts(df)).collect()))
    assert len(one) == 6 and sorted(map(tuple, v.similarities(df, v.first_prompts(df), block=1).collect())) == one
    scores = [{"TextOnly": 0.7, "Human": 0.1}, {"TextOnly": 0.7, "Human": 0.23}, {"TextOnly": 0.5, "Cat": 0.45}, {"Cat": 0.39}, {}, {"Figure": 0.6}]
    got = ev(col(spark, scores, "map<string,double>"), v.subject_cascade(F.col("x")))
    assert [q.subject for q in got] == ["TextOnly", "Unknown", "Cat", "Unknown", "Unknown", "Figure"] and got[0].force_text


def test_stream_stops_when_quiet(spark, tmp_path):
    spark.range(50).write.parquet(str(tmp_path / "in"))
    start = lambda: jobs.append_to(jobs.stream(spark, str(tmp_path / "in"), "id long"), str(tmp_path / "out"), str(tmp_path / "check"))
    assert jobs.run_until_quiet(start, quiet=2) == 50
    assert spark.read.parquet(str(tmp_path / "out")).count() == 50
    late = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:10:00")], "k int, ts string").select("k", F.to_timestamp("ts").alias("ts"))
    late.write.parquet(str(tmp_path / "ev"))
    q = jobs.append_to(jobs.unseen(jobs.stream(spark, str(tmp_path / "ev"), "k int, ts timestamp"), "k", "ts", "1 hour"), str(tmp_path / "ev-out"), str(tmp_path / "ev-check"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "ev-out")).count() == 1


def test_upsert_takes_every_item(spark):
    sf = "/root/testdata/sf0.001"
    items = {(r.l_orderkey, r.l_linenumber) for r in spark.read.parquet(f"{sf}/lineitem.parquet").collect()}
    orders = {r.o_orderkey for r in spark.read.parquet(f"{sf}/orders.parquet").collect()}
    known = {(f"urn:item#{k}-{n}", f"urn:order#{k}") for k, n in items if n != 7 and k in orders}
    assert any(k >= 500 for k, _ in items)
    got = registered.queries()["k15_upsert_children"](spark, sf).collect()
    assert sorted((r.s, r.o) for r in got if r.p == "isPartOf") == sorted(known)
    assert sorted((r.o, r.s) for r in got if r.p == "hasPart") == sorted(known)
    n = registered.queries()["k15_upsert_report"](spark, sf).first()
    assert (n.n, n.matched, n.unmatched) == (len(items), len(known), len(items) - len(known))
