"""Set operations on frames with the same columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    """J1."""
    return a.unionByName(b).distinct()


def union_tagged(**parts: DataFrame) -> DataFrame:
    """All rows with the name of their part in `kind`."""
    out = None
    for kind, d in parts.items():
        d = d.withColumn("kind", F.lit(kind))
        out = d if out is None else out.unionByName(d)
    return out


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of a that are not in b."""
    return a.subtract(b)


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct rows of both."""
    return a.intersect(b)
