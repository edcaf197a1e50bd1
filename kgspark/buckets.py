"""Tables in buckets of a key, for changes that touch few keys: only the buckets they fall in are written anew.

Under `<root>/rows` every write has a folder of its own with one folder for each bucket it wrote. Under `<root>/index`
stands the list of buckets, as a table of whole versions (`storage.publish`): one row for each bucket, with the folder
that holds its rows now. A change writes the changed buckets and then publishes the list; readers see the old rows or the
new ones, and the files of all other buckets stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .storage import folders, newest, publish, remove, versions

_INDEX = "bucket int, folder string, buckets int"


@dataclass
class Table:
    """One version of a table: how many buckets it has, and the folder of each that holds rows."""

    spark: SparkSession
    root: str
    version: str
    buckets: int
    folder: dict[int, str]

    def bucket(self, key: str) -> Column:
        return bucket_of(key, self.buckets)

    def rows(self, schema: StructType | str, only: Iterable[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        wanted = [self.folder[b] for b in sorted(self.folder if only is None else set(only) & set(self.folder))]
        if not wanted:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.root}/rows/{f}" for f in wanted])


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _written(df: DataFrame, key: str, root: str, name: str, buckets: int) -> dict[int, str]:
    """Writes the rows by bucket and gives the folder of each bucket; a bucket is written by one task."""
    d = df.withColumn("bucket_", bucket_of(key, buckets))
    d.repartition("bucket_").write.mode("overwrite").partitionBy("bucket_").parquet(f"{root}/rows/{name}")
    return {int(f.partition("=")[2]): f"{name}/{f}" for f in folders(df.sparkSession, f"{root}/rows/{name}") if f.startswith("bucket_=")}


def create(df: DataFrame, root: str, key: str, buckets: int = 256) -> None:
    """First version of a table. `buckets` decides how much a change of one row rewrites; it stays for good."""
    spark = df.sparkSession
    folder = _written(df, key, root, "first", buckets)
    publish(spark.createDataFrame([(b, f, buckets) for b, f in folder.items()] or [(-1, "", buckets)], _INDEX).coalesce(1), f"{root}/index")


def opened(spark: SparkSession, root: str) -> Table:
    """The newest complete version. Its list has at most one row for each bucket, so the driver reads it."""
    version = newest(spark, f"{root}/index")
    rows = spark.read.schema(_INDEX).parquet(version).collect()
    return Table(spark, root, version, rows[0]["buckets"], {r["bucket"]: r["folder"] for r in rows if r["bucket"] >= 0})


def replaced(table: Table, df: DataFrame, key: str, touched: Iterable[int], mark: str, keep: int = 2) -> None:
    """Publish a version in which `df` holds all rows of the buckets `touched`; all other buckets keep their files.

    Done once for a `mark`. If another version was completed since `table` was opened, `storage.ConcurrentWrite` is raised.
    Folders that no kept version names are deleted.
    """
    spark, index = table.spark, f"{table.root}/index"
    gone = set(touched)
    folder = {b: f for b, f in table.folder.items() if b not in gone} | _written(df, key, table.root, mark, table.buckets)
    rows = [(b, f, table.buckets) for b, f in sorted(folder.items())] or [(-1, "", table.buckets)]
    publish(spark.createDataFrame(rows, _INDEX).coalesce(1), index, mark=mark, keep=keep, base=table.version)
    kept = [f"{index}/{v}" for v in versions(spark, index)]
    used = {r["folder"].partition("/")[0] for r in spark.read.schema(_INDEX).parquet(*kept).select("folder").distinct().collect()}
    for name in folders(spark, f"{table.root}/rows"):
        if name not in used:
            remove(spark, f"{table.root}/rows/{name}")


def done(spark: SparkSession, root: str, mark: str) -> bool:
    """Whether a complete version bears the mark."""
    return any(v.partition("-")[2] == mark for v in versions(spark, f"{root}/index"))


def change(spark: SparkSession, root: str, key: str, schema: StructType | str, fresh: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], mark: str) -> int:
    """Merge `fresh` rows into a table, bucket by bucket: `merge(known rows, fresh rows)` gives the rows that replace the known ones.

    Only buckets with a fresh key are read and written. Gives their number; 0 if a version with this mark is there or `fresh` is empty.
    """
    if done(spark, root, mark):
        return 0
    table = opened(spark, root)
    touched = [r[0] for r in fresh.select(table.bucket(key)).distinct().collect()]
    if touched:
        replaced(table, merge(table.rows(schema, touched), fresh), key, touched, mark)
    return len(touched)
