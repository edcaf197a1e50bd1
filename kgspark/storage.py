"""Tables between steps in the folder that driver and executors share, and tables that change by whole versions."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

_WRITTEN: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: the session's checkpoint folder.

    It is the one set on the context, else `spark.checkpoint.dir`. Where neither is set a folder of our own is made if
    everything runs on this machine, as in tests; on a cluster that is an error, since executors would not see it.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(base or tempfile.mkdtemp(prefix="kgspark-"))
    return sc.getCheckpointDir()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder; it stays until `forget` is called."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage of `df` by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as a compressed table into the shared folder and read it again: lineage is cut, and disk is spared.

    Results read such tables lazily, so they stay until `forget` is called.
    """
    path = scratch(df.sparkSession, "table")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession) -> int:
    """Delete what this application has written to paths of `scratch`; for use once the results are read or written. Gives the number of paths."""
    paths = _WRITTEN.pop(spark.sparkContext.applicationId, [])
    for p in paths:
        remove(spark, p)
    return len(paths)


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = _at(spark, path)
    return fs.exists(at)


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly under a path, sorted; none if the path is not there."""
    fs, at = _at(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory()) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, at = _at(spark, path)
    fs.delete(at, True)


def state_of(spark: SparkSession, path: str) -> tuple:
    """Name, size and time of each file under a path, as a value that changes when the table does."""
    fs, at = _at(spark, path)
    found, files = [], fs.listFiles(at, True)
    while files.hasNext():
        f = files.next()
        found.append((f.getPath().toString(), f.getLen(), f.getModificationTime()))
    return tuple(sorted(found))


class ConcurrentWrite(RuntimeError):
    """Another writer has completed a version since the one that a change was made from."""


def versions(spark: SparkSession, root: str) -> list[str]:
    """Names of the complete versions of a table, the oldest first. A version is complete once `_SUCCESS` stands in it."""
    return [n for n in folders(spark, root) if n.startswith("v") and exists(spark, f"{root}/{n}/_SUCCESS")]


def _number(spark: SparkSession, root: str, first: int, mark: str) -> int:
    """The lowest number from `first` on that no other writer has claimed.

    A claim is an empty file, which only one of two writers can create (on stores that create files atomically). A
    broken-off write that bears the same mark is taken up again under its number.
    """
    number = first
    while True:
        fs, claim = _at(spark, f"{root}/_claims/{number:010d}")
        fs.mkdirs(claim.getParent())
        own = _at(spark, f"{root}/_claims/{number:010d}-{mark}")[1] if mark else None
        if fs.createNewFile(claim) or (own is not None and fs.exists(own)):
            if own is not None:
                fs.createNewFile(own)
            return number
        number += 1


def publish(df: DataFrame, root: str, form: str = "parquet", by: Sequence[str] = (), mark: str = "", keep: int = 2, base: str | None = None) -> str:
    """Write `df` as the next version of the table at `root`; readers take the newest complete one, so they see the old rows or the new ones.

    With a `mark` the work is done once: if a complete version bears it, nothing is written. `keep` versions stay, so
    that a reader of the one before can finish. Two writers get numbers of their own and never write to one folder; a
    change that was made from the version `base` fails with `ConcurrentWrite` if another one has been completed since.
    Where the site keeps Spark from leaving `_SUCCESS`, it is added. Gives the path of the version.
    """
    spark = df.sparkSession
    there = versions(spark, root)
    done = [n for n in there if mark and n.partition("-")[2] == mark]
    if done:
        return f"{root}/{done[-1]}"
    number = _number(spark, root, int(there[-1][1:11]) + 1 if there else 0, mark)
    name = f"v{number:010d}" + (f"-{mark}" if mark else "")
    w = df.write.mode("overwrite").format(form).option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false" if base else "true")
    (w.partitionBy(*by) if by else w).save(f"{root}/{name}")
    if base and newest(spark, root) != base:
        remove(spark, f"{root}/{name}")
        raise ConcurrentWrite(f"{newest(spark, root)} was completed after {base} was read")
    fs, success = _at(spark, f"{root}/{name}/_SUCCESS")
    fs.createNewFile(success)
    for old in [*there, name][:-keep]:
        remove(spark, f"{root}/{old}")
    return f"{root}/{name}"


def newest(spark: SparkSession, root: str) -> str:
    """Path of the newest complete version."""
    there = versions(spark, root)
    if not there:
        raise FileNotFoundError(f"no complete version under {root}")
    return f"{root}/{there[-1]}"


def read_newest(spark: SparkSession, root: str, schema: StructType | str, form: str = "parquet") -> DataFrame:
    return spark.read.schema(schema).format(form).load(newest(spark, root))
