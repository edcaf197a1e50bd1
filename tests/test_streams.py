"""Streams and stored tables: what changes, what stays, and what state is kept."""

import os
import random

import pytest
from pyspark.sql import functions as F

from kgspark import adapters, buckets, storage
from kgspark import queries as registered
from kgspark.operators import order
from kgspark.streaming import jobs, sampling

SF = "/root/testdata/sf0.001"


def files_of(root):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def undo_commit(check, batch):
    for name in (f"{batch}", f".{batch}.crc"):
        (check / "commits" / name).unlink(missing_ok=True)


def test_a_batch_rewrites_only_its_buckets(spark, tmp_path):
    root, fresh, check, schema = str(tmp_path / "t"), str(tmp_path / "fresh"), tmp_path / "check", "k long, v string, w long, other string"
    rows = [(k, None if k % 2 else f"v{k}", None, "o") for k in range(200)] + [(None, None, None, "no key")]
    buckets.create(spark.createDataFrame(rows, schema), root, "k", buckets=8)
    read = lambda: {r.k: (r.v, r.w) for r in buckets.opened(spark, root).rows(schema).collect()}
    start = lambda: jobs.backfill_buckets(jobs.stream(spark, fresh, "k long, v string, w long", files_per_batch=1), root, schema, "k", ["v", "w"], str(check))
    want = {k: (v, w) for k, v, w, _ in rows}
    assert read() == want
    first, table = files_of(f"{root}/rows"), buckets.opened(spark, root)
    assert len(table.folder) == 8

    spark.createDataFrame([(1, "x", 7), (1, "y", None), (2, "no", 3), (999, "no", 1), (None, "no", 1)], "k long, v string, w long").coalesce(1).write.parquet(fresh)
    start().awaitTermination()
    want |= {1: ("y", 7), 2: ("v2", 3)}
    assert read() == want
    after = buckets.opened(spark, root)
    touched = {r[0] for r in spark.createDataFrame([(1,), (2,), (999,)], "k long").select(buckets.bucket_of("k", 8)).collect()}
    assert {b for b in range(8) if after.folder[b] != table.folder[b]} == touched and len(touched) < 8
    second = files_of(f"{root}/rows")
    kept = {p: t for p, t in first.items() if int(p.split("bucket_=")[1].split("/")[0]) not in touched}
    assert kept and all(second[p] == t for p, t in kept.items())

    # the version was published, but the batch's own commit was lost: nothing is written again
    undo_commit(check, 0)
    start().awaitTermination()
    assert read() == want and files_of(f"{root}/rows") == second
    # it broke off between the buckets and the list of them
    undo_commit(check, 0)
    (tmp_path / "t" / "index" / after.version.rsplit("/", 1)[1] / "_SUCCESS").unlink()
    start().awaitTermination()
    assert read() == want

    spark.createDataFrame([(3, "z", None)], "k long, v string, w long").coalesce(1).write.mode("append").parquet(fresh)
    start().awaitTermination()
    assert read() == want | {3: ("z", None)}
    assert len(storage.versions(spark, f"{root}/index")) == 2


def test_buckets_of_an_empty_table_and_of_chosen_keys(spark, tmp_path):
    root, schema = str(tmp_path / "none"), "k long, v string"
    buckets.create(spark.createDataFrame([], schema), root, "k", buckets=4)
    table = buckets.opened(spark, root)
    assert table.buckets == 4 and table.rows(schema).count() == 0
    assert buckets.change(spark, root, "k", schema, spark.createDataFrame([], schema), lambda known, new: new, "m1") == 0
    assert buckets.change(spark, root, "k", schema, spark.createDataFrame([(5, "a")], schema), lambda known, new: known.unionByName(new), "m2") == 1
    assert buckets.change(spark, root, "k", schema, spark.createDataFrame([(5, "b")], schema), lambda known, new: known.unionByName(new), "m2") == 0
    table = buckets.opened(spark, root)
    assert [tuple(r) for r in table.rows(schema).collect()] == [(5, "a")]
    assert table.rows(schema, only=[b for b in range(4) if b not in table.folder]).count() == 0


def test_a_change_from_an_old_version_is_refused(spark, tmp_path):
    root, schema = str(tmp_path / "t"), "k long, v string"
    buckets.create(spark.createDataFrame([(1, "a")], schema), root, "k", buckets=2)
    old = buckets.opened(spark, root)
    buckets.replaced(old, spark.createDataFrame([(1, "b")], schema), "k", [0, 1], "one")
    with pytest.raises(storage.ConcurrentWrite):
        buckets.replaced(old, spark.createDataFrame([(1, "c")], schema), "k", [0, 1], "two")
    assert [r.v for r in buckets.opened(spark, root).rows(schema).collect()] == ["b"]


def test_two_writers_never_share_a_folder(spark, tmp_path):
    root = str(tmp_path / "t")
    first = storage.publish(spark.range(1), root)
    assert storage._number(spark, root, 1, "") == 1  # another writer has claimed it and is still writing
    second = storage.publish(spark.range(2), root)
    assert second.endswith("v0000000002") and first != second
    assert storage.read_newest(spark, root, "id long").count() == 2
    assert storage._number(spark, root, 3, "batch-7") == 3 and storage._number(spark, root, 3, "batch-7") == 3  # taken up again
    assert storage._number(spark, root, 3, "batch-8") == 4


def test_graph_queries_run_after_forget(spark):
    ask = registered.queries()["k7_describe"]
    before = sorted(map(tuple, ask(spark, SF).collect()), key=repr)
    path = storage.scratch(spark, "gone")
    spark.range(1).write.parquet(path)
    assert before and storage.forget(spark) >= 2
    assert not storage.exists(spark, path) and storage.forget(spark) == 0
    assert sorted(map(tuple, ask(spark, SF).collect()), key=repr) == before
    assert len(adapters._STORED) >= 1


def keys(seed, n, most):
    rng = random.Random(seed)
    return [(rng.choice(["big"] * 8 + ["small", None, ""]), rng.choice([*range(most), None]), i) for i in range(n)]


def test_a_sample_of_a_stream_is_that_of_the_union_of_its_batches(spark, tmp_path):
    schema, src = "g string, k long, i long", str(tmp_path / "in")
    rows = []
    for part in range(3):
        new = keys(part, 300, 120)
        rows += new
        spark.createDataFrame(new, schema).coalesce(1).write.mode("append").parquet(src)
        for group, n in ((None, 9), ("g", 4)):
            columns = ["g", "k"] if group else ["k"]
            out, check = str(tmp_path / f"out-{group}"), str(tmp_path / f"check-{group}")
            d = sampling.admitted(jobs.stream(spark, src, schema).select(*columns), "k", n, group, seed=3, salts=2)
            q = jobs.append_to(d, out, check)
            q.awaitTermination()
            log = spark.read.parquet(out)
            every = spark.createDataFrame(rows, schema).select(*columns)
            want = order.sample_per_group(every, group, "k", n, 3) if group else order.sample(every, "k", n, 3)
            got = sampling.sampled(log, "k", n, group, 3)
            assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(map(tuple, want.select(*columns).collect()), key=repr)
            # one list for each group and salt, each of at most n lots
            assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * (4 if group else 1)
            assert log.count() < every.count() / 2


def test_all_columns_of_a_sampled_row_come_through(spark, tmp_path):
    src = str(tmp_path / "in")
    d = spark.sql("SELECT 9007199254740993L AS k, CAST(NULL AS long) AS none, timestamp'2024-01-02 03:04:05.678901' AS t, 0.1D AS x, 'é\\n\"' AS s, array(1, null) AS a, date'2024-05-06' AS d, 1.20BD AS m")
    d.write.parquet(src)
    q = jobs.append_to(sampling.admitted(jobs.stream(spark, src, d.schema), "k", 1), str(tmp_path / "out"), str(tmp_path / "check"))
    q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).collect() == d.collect()


def test_late_rows_are_refused_and_the_state_stays_bounded(spark, tmp_path):
    src, out, check = (str(tmp_path / n) for n in ("in", "out", "check"))
    sizes = []
    for day in [*range(1, 9), 1]:
        d = spark.range(100).select((F.col("id") + 1000 * day).alias("k"), F.expr(f"timestamp'2024-01-0{day} 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(id AS int), 0)").alias("ts"))
        d.coalesce(1).write.mode("append").parquet(src)
        q = jobs.append_to(jobs.unseen(jobs.stream(spark, src, "k long, ts timestamp", files_per_batch=1), "k", "ts", "1 day"), out, check)
        q.awaitTermination()
        sizes.append(q.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert spark.read.parquet(out).groupBy("k").count().where("count > 1").count() == 0
    assert spark.read.parquet(out).count() == 800
    assert max(sizes) <= 300


def test_stop_rules():
    r = jobs.StopRule(quiet=3, full=2, target=10, most=1.3)
    assert [r.ended_by(n) for n in (5, 0, 0, 4, 0, 0)] == [None] * 6 and r.ended_by(0) == "quiet"
    r = jobs.StopRule(quiet=3, full=2, target=10, most=1.3)
    assert [r.ended_by(n) for n in (6, 5, 0)] == [None] * 3 and r.ended_by(0) == "full"
    r = jobs.StopRule(quiet=3, full=2, target=10, most=1.3)
    assert r.ended_by(12) is None and r.ended_by(1) == "target"
    r = jobs.StopRule(quiet=1)
    assert r.ended_by(0) == "quiet"


def test_a_failing_query_raises_and_the_listener_goes(spark, tmp_path):
    spark.range(5).write.parquet(str(tmp_path / "in"))
    bad = jobs.stream(spark, str(tmp_path / "in"), "id long").select(F.raise_error(F.lit("no")).cast("string").alias("x"))
    with pytest.raises(Exception, match="no"):
        jobs.run_until(spark, lambda: jobs.follow(bad, str(tmp_path / "out"), str(tmp_path / "check")), jobs.StopRule(), idle_ms=50)
    assert spark.conf.get("spark.sql.streaming.noDataProgressEventInterval", None) in (None, "10000", "10000ms", "10s")
