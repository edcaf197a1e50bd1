"""Incremental jobs on Structured Streaming. State lives in the query's checkpoint folder, so a restart goes on where the last run ended."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener
from pyspark.sql.types import StructType

from .. import buckets
from ..operators.joins import sync
from ..storage import newest, publish


def stream(spark: SparkSession, path: str, schema: StructType | str, files_per_batch: int | None = None, form: str = "parquet") -> DataFrame:
    """A folder of files as a stream."""
    r = spark.readStream.schema(schema).format(form)
    return (r.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else r).load(path)


def unseen(events: DataFrame, key: str, time: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first row of each key. With an event time, keys older than `delay` behind the latest time are forgotten, which bounds the state."""
    if time is None:
        return events.dropDuplicates([key])
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def append_to(df: DataFrame, path: str, checkpoint: str, form: str = "parquet") -> StreamingQuery:
    """All that is there now is appended to `path`; then the query ends."""
    return df.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def follow(df: DataFrame, path: str, checkpoint: str, form: str = "parquet", every: str = "0 seconds") -> StreamingQuery:
    """Appends to `path` as rows come, until it is stopped."""
    return df.writeStream.format(form).option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(processingTime=every).start()


def refresh(df: DataFrame, keys: Sequence[str], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """S3: counts by key after each batch, as a whole, given to `sink(frame, batch)`."""
    counts = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).foreachBatch(sink).trigger(availableNow=True).start()


def backfill(fresh: DataFrame, table: str, key: str, fields: Sequence[str], checkpoint: str) -> StreamingQuery:
    """Missing fields of known rows are filled from a stream of fresh rows; present values stay, unknown keys are ignored.

    Each batch publishes a new version of the table that bears the query's and the batch's number. A batch that is
    run again, because the stream ended between the version and its own commit, finds its version and does nothing;
    one that was broken off while writing starts again from the last complete version. The stream caps a batch's size.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        known = spark.read.parquet(current(spark, table))
        publish(_filled(known, batch, key, fields), table, mark=_mark(spark, number))

    return fresh.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def backfill_buckets(fresh: DataFrame, table: str, schema: StructType | str, key: str, fields: Sequence[str], checkpoint: str) -> StreamingQuery:
    """S4 for a table in buckets of its key (`buckets.create`): a batch reads and writes only the buckets that its keys fall in.

    What it fills, and that a batch run again changes nothing, is as in `backfill`. Null keys match nothing.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        some = batch.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.max(c).alias(c) for c in fields]).persist()
        try:
            buckets.change(spark, table, key, schema, some, lambda known, new: _filled(known, new, key, fields), _mark(spark, number))
        finally:
            some.unpersist()

    return fresh.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _mark(spark: SparkSession, batch: int) -> str:
    return f"{spark.sparkContext.getLocalProperty('sql.streaming.queryId') or 'query'}-{batch}"


def _filled(known: DataFrame, fresh: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """The known rows with missing fields taken from the fresh ones; of several fresh values the largest."""
    new = fresh.groupBy(key).agg(*[F.max(c).alias(c) for c in fields])
    held = known.select(key, *[F.col(c).alias(f"{c}_old_") for c in fields])
    wanted = new.join(held, key).select(key, *[F.when(F.col(f"{c}_old_").isNull(), F.col(c)).alias(c) for c in fields])
    return sync(known, wanted, key, fields).drop("changed")


def start_table(df: DataFrame, table: str) -> None:
    """First version of a table for `backfill`."""
    publish(df, table)


def current(spark: SparkSession, table: str) -> str:
    """Folder of the current version."""
    return newest(spark, table)


def run_until_quiet(start: Callable[[], StreamingQuery], quiet: int = 5, full: int = 3, target: int | None = None, most: float = 1.3) -> int:
    """Run a query again and again until `quiet` runs in a row bring nothing new (`full` once the target is reached), or `most` times the target was read. Gives the number of rows read."""
    seen = idle = 0
    while True:
        q = start()
        q.awaitTermination()
        new = sum(int(p["numInputRows"]) for p in q.recentProgress)
        seen, idle = seen + new, 0 if new else idle + 1
        if target is not None and seen >= most * target or idle >= (full if target is not None and seen >= target else quiet):
            return seen


@dataclass
class StopRule:
    """When to end a query that follows its source.

    `quiet` steps in a row without new rows, or `full` of them once `target` rows were read, or `most` times the target.
    """

    quiet: int = 5
    full: int = 3
    target: int | None = None
    most: float = 1.3
    seen: int = 0
    idle: int = 0

    def ended_by(self, new: int) -> str | None:
        """Takes the number of rows of one more step; gives the rule that ends the query, if any."""
        self.seen += new
        self.idle = 0 if new else self.idle + 1
        if self.target is not None and self.seen >= self.target:
            if self.seen >= self.most * self.target:
                return "target"
            if self.idle >= self.full:
                return "full"
        return "quiet" if self.idle >= self.quiet else None


class Steps(StreamingQueryListener):
    """The rows of each step of all queries of the session, as Spark reports them: `(run, rows)` in order."""

    def __init__(self):
        self.steps: list[tuple[str, int]] = []

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.steps.append((str(event.progress.runId), event.progress.numInputRows))

    def onQueryIdle(self, event) -> None:
        self.steps.append((str(event.runId), 0))

    def onQueryTerminated(self, event) -> None:
        pass


def run_until(spark: SparkSession, start: Callable[[], StreamingQuery], rule: StopRule, idle_ms: int = 10_000) -> str:
    """Start a query that follows its source and stop it as `rule` says; gives the rule that ended it.

    A listener counts the rows of each step. Where nothing comes, Spark reports a step every `idle_ms`. A query that
    fails raises its error. The state for a later start stays in the query's checkpoint folder.
    """
    name, steps = "spark.sql.streaming.noDataProgressEventInterval", Steps()
    before = spark.conf.get(name, None)
    spark.streams.addListener(steps)
    try:
        spark.conf.set(name, str(idle_ms))  # read when a query starts
        q = start()
        at = 0
        while True:
            if not q.isActive and q.exception() is not None:
                raise q.exception()
            while at < len(steps.steps):
                run, rows = steps.steps[at]
                at += 1
                if run == str(q.runId) and (reason := rule.ended_by(rows)):
                    q.stop()
                    return reason
            if not q.isActive:
                return "ended"
            time.sleep(0.02)
    finally:
        spark.streams.removeListener(steps)
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)
