"""Queries of the streaming jobs (S): each runs to the end of what is there and returns what it wrote, to be held against its batch twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import buckets
from ..adapters import frame
from ..storage import publish, read_newest, scratch
from ..streaming import jobs, sampling

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _halves(spark, sf, name: str):
    """The events in a folder that grows: its path, and what adds the second half."""
    path = scratch(spark, name)
    e = frame(spark, sf, "events")
    e.where("ts < '2024-01-16'").repartition(4).write.parquet(path)
    return path, e.schema, lambda: e.repartition(4).write.mode("append").parquet(path)


@query("SELECT DISTINCT user_id FROM events")
def s1_unseen(spark, sf):
    path, schema, grow = _halves(spark, sf, "s1")
    out, check = scratch(spark, "s1-out"), scratch(spark, "s1-check")
    for step in (None, grow):
        if step:
            step()
        jobs.append_to(jobs.unseen(jobs.stream(spark, path, schema).select("user_id"), "user_id"), out, check).awaitTermination()
    return spark.read.schema("user_id long").parquet(out)


@query("SELECT event_id, event_type FROM events UNION ALL SELECT event_id, event_type FROM events WHERE ts < '2024-01-16'")
def s2_resume(spark, sf):
    path, schema, grow = _halves(spark, sf, "s2")
    out, check = scratch(spark, "s2-out"), scratch(spark, "s2-check")
    for step in (None, None, grow):
        if step:
            step()
        jobs.append_to(jobs.stream(spark, path, schema).select("event_id", "event_type"), out, check).awaitTermination()
    return spark.read.schema("event_id long, event_type string").parquet(out)


@query("SELECT event_type, count(*) + count(*) FILTER (ts < '2024-01-16') AS n FROM events GROUP BY event_type")
def s3_refresh(spark, sf):
    path, schema, grow = _halves(spark, sf, "s3")
    out, check = scratch(spark, "s3-out"), scratch(spark, "s3-check")
    for step in (None, grow):
        if step:
            step()
        jobs.refresh(jobs.stream(spark, path, schema), ["event_type"], lambda d, _: publish(d, out), check).awaitTermination()
    return read_newest(spark, out, "event_type string, n long")


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_totalprice > 150000 THEN o_orderpriority WHEN o_orderstatus = 'F' THEN 'new' END AS o_orderpriority FROM orders")
def s4_backfill(spark, sf):
    table, fresh, check = scratch(spark, "s4"), scratch(spark, "s4-fresh"), scratch(spark, "s4-check")
    o = frame(spark, sf, "orders")
    jobs.start_table(o.select("o_orderkey", "o_orderstatus", F.when(F.col("o_totalprice") > 150000, F.col("o_orderpriority")).alias("o_orderpriority")), table)
    o.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("new").alias("o_orderpriority")).repartition(2).write.parquet(fresh)
    jobs.backfill(jobs.stream(spark, fresh, "o_orderkey long, o_orderpriority string", files_per_batch=1), table, "o_orderkey", ["o_orderpriority"], check).awaitTermination()
    return spark.read.schema("o_orderkey long, o_orderstatus string, o_orderpriority string").parquet(jobs.current(spark, table))


@query("SELECT o_orderkey, o_orderstatus, CASE WHEN o_totalprice > 150000 THEN o_orderpriority WHEN o_orderstatus = 'F' THEN 'new' END AS o_orderpriority FROM orders")
def s4_backfill_buckets(spark, sf):
    """The same over a table in buckets, of which each batch rewrites those that its keys fall in."""
    table, fresh, check = scratch(spark, "s4-buckets"), scratch(spark, "s4-fresh"), scratch(spark, "s4-check")
    o, schema = frame(spark, sf, "orders"), "o_orderkey long, o_orderstatus string, o_orderpriority string"
    buckets.create(o.select("o_orderkey", "o_orderstatus", F.when(F.col("o_totalprice") > 150000, F.col("o_orderpriority")).alias("o_orderpriority")), table, "o_orderkey", buckets=16)
    o.where("o_orderstatus = 'F'").select("o_orderkey", F.lit("new").alias("o_orderpriority")).repartitionByRange(2, "o_orderkey").write.parquet(fresh)
    jobs.backfill_buckets(jobs.stream(spark, fresh, "o_orderkey long, o_orderpriority string", files_per_batch=1), table, schema, "o_orderkey", ["o_orderpriority"], check).awaitTermination()
    return buckets.opened(spark, table).rows(schema)


def _drawn(spark, sf, name: str, key: str, n: int, group: str | None = None):
    """The sample of the events' keys after the first half of them and again after all."""
    path, schema, grow = _halves(spark, sf, name)
    out, check = scratch(spark, f"{name}-out"), scratch(spark, f"{name}-check")
    columns = ([group] if group else []) + [key]
    for step in (None, grow):
        if step:
            step()
        jobs.append_to(sampling.admitted(jobs.stream(spark, path, schema).select(*columns), key, n, group), out, check).awaitTermination()
    return sampling.sampled(spark.read.schema(spark.createDataFrame([], schema).select(*columns).schema).parquet(out), key, n, group)


@query("SELECT user_id FROM (SELECT DISTINCT user_id FROM events) ORDER BY md5(concat('0:', CAST(user_id AS VARCHAR))), user_id LIMIT 20")
def h5_sample_stream(spark, sf):
    return _drawn(spark, sf, "h5", "user_id", 20)


@query("""SELECT event_type, user_id FROM (SELECT DISTINCT event_type, user_id FROM events)
          QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY md5(concat('0:', CAST(user_id AS VARCHAR))), user_id) <= 5""")
def h6_sample_per_group_stream(spark, sf):
    return _drawn(spark, sf, "h6", "user_id", 5, "event_type")


@query("SELECT event_id, user_id FROM events")
def s1_bounded(spark, sf):
    """Unseen events with a state that is bounded by event time: days come in order, then the first days come once more."""
    path, out, check = scratch(spark, "s1-days"), scratch(spark, "s1-days-out"), scratch(spark, "s1-days-check")
    e, days = frame(spark, sf, "events").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts")), [f"2024-01-{d:02d}" for d in (1, 7, 13, 19, 25)] + ["2025-01-01"]
    for first, last in [*zip(days, days[1:], strict=False), (days[0], days[1])]:
        e.where((F.col("ts") >= first) & (F.col("ts") < last)).coalesce(1).write.mode("append").parquet(path)
        jobs.append_to(jobs.unseen(jobs.stream(spark, path, e.schema, files_per_batch=1), "event_id", "ts", "2 days"), out, check).awaitTermination()
    return spark.read.schema("event_id long, user_id long").parquet(out)


def _followed(spark, sf, name: str, rule):
    """The events, followed until a rule ends the query, with the rule's name."""
    path, out, check = scratch(spark, name), scratch(spark, f"{name}-out"), scratch(spark, f"{name}-check")
    e = frame(spark, sf, "events")
    e.repartition(3).write.parquet(path)
    start = lambda: jobs.follow(jobs.stream(spark, path, e.schema, files_per_batch=1).select("event_id", "event_type"), out, check)
    ended_by = jobs.run_until(spark, start, rule(e.count()), idle_ms=100)
    return spark.read.schema("event_id long, event_type string").parquet(out).withColumn("ended_by", F.lit(ended_by))


@query("SELECT event_id, event_type, 'quiet' AS ended_by FROM events")
def s5_quiet(spark, sf):
    return _followed(spark, sf, "s5-quiet", lambda n: jobs.StopRule())


@query("SELECT event_id, event_type, 'full' AS ended_by FROM events")
def s5_full(spark, sf):
    """The target is reached with the last files, and 1.3 times the target is not."""
    return _followed(spark, sf, "s5-full", lambda n: jobs.StopRule(quiet=10, target=n * 9 // 10))


@query("SELECT event_id, event_type, 'target' AS ended_by FROM events")
def s5_target(spark, sf):
    """All events are 1.3 times the target."""
    return _followed(spark, sf, "s5-target", lambda n: jobs.StopRule(quiet=1000, full=1000, target=int(n / 1.3)))


@query("SELECT event_id, event_type FROM events")
def s5_until_quiet(spark, sf):
    path, out, check = scratch(spark, "s5"), scratch(spark, "s5-out"), scratch(spark, "s5-check")
    e = frame(spark, sf, "events")
    e.repartition(3).write.parquet(path)
    jobs.run_until_quiet(lambda: jobs.append_to(jobs.stream(spark, path, e.schema, files_per_batch=2).select("event_id", "event_type"), out, check), quiet=2)
    return spark.read.schema("event_id long, event_type string").parquet(out)
