"""Aggregations of the corpus analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .filters import is_known
from .order import numbered


def count_by(df: DataFrame, *keys: str, out: str = "n") -> DataFrame:
    """rows by one or more keys."""
    return df.groupBy(*keys).agg(F.count("*").alias(out))


def items_of(df: DataFrame, array: str, item: str, *keep: str) -> DataFrame:
    """one row for each item of an array that is known; repeats inside a row stay."""
    d = df.select(*keep, F.explode(array).alias(item))
    return d.where(is_known(F.col(item)))


def mean_of_valued(df: DataFrame, key: str, value: str) -> DataFrame:
    """by key the mean of values that are not null and not below zero (0 if none), the number of rows and of valued rows; by mean from the top."""
    ok = F.when(F.col(value) >= 0, F.col(value))
    d = df.groupBy(key).agg(F.coalesce(F.avg(ok), F.lit(0.0)).alias("mean_value"), F.count("*").alias("entries"), F.count(ok).alias("valued"))
    return d.orderBy(F.desc("mean_value"), key)


def inverted_index(df: DataFrame, item: str, *nodes: Column, sep: str = "||") -> DataFrame:
    """long index `(node, item)`: the items under each node; several columns make a joined node."""
    node = F.concat_ws(sep, *nodes) if len(nodes) > 1 else nodes[0]
    return df.select(node.alias("node"), item).where("node IS NOT NULL").distinct()


def index_lists(index: DataFrame, item: str) -> DataFrame:
    """sorted list of items for each node of a long index; for nodes of few items. An index with nodes of very many stays long."""
    return index.groupBy("node").agg(F.array_sort(F.collect_set(item)).alias("items"))


def top(df: DataFrame, key: str, k: int, out: str = "n") -> DataFrame:
    """H3: the k most frequent keys, ties by key."""
    return count_by(df, key, out=out).orderBy(F.desc(out), key).limit(k)


def top_or_other(df: DataFrame, group: str, key: str, k: int, other: str = "Other") -> DataFrame:
    """Counts by group of the k overall most frequent keys, the rest as `other`, with the group's total and the ratio to it."""
    counts = count_by(df, group, key)
    best = counts.groupBy(key).agg(F.sum("n").alias("all_")).orderBy(F.desc("all_"), key).limit(k).select(F.col(key).alias("key_"))
    named = counts.join(best, counts[key] == best["key_"], "left").select(group, F.coalesce("key_", F.lit(other)).alias(key), "n")
    d = named.groupBy(group, key).agg(F.sum("n").alias("n"))
    total = F.sum("n").over(W.partitionBy(group))
    return d.withColumn("total", total).withColumn("ratio", F.col("n") / F.col("total"))


def edges_of_top(df: DataFrame, source: str, target: str, k: int, least: int = 2) -> DataFrame:
    """F8: counts of (source, target) for the k most frequent targets, at least `least`."""
    d = count_by(df, source, target)
    return d.join(top(df, target, k).select(target), target, "left_semi").where(F.col("n") >= least).select(source, target, "n")


def nodes(df: DataFrame, source: str, target: str, k: int, names: Sequence[str] = ("source", "target")) -> DataFrame:
    """nodes of both kinds with their counts and group; targets are the k most frequent."""
    a = count_by(df.where(F.col(source).isNotNull()), source).select(F.col(source).cast("string").alias("id"), "n", F.lit(names[0]).alias("grp"))
    return a.unionByName(top(df, target, k).select(F.col(target).cast("string").alias("id"), "n", F.lit(names[1]).alias("grp")))


def heat_cells(df: DataFrame, row: str, rows: Sequence[str], column: str, k: int) -> DataFrame:
    """counts of a fixed set of rows by the k most frequent columns among them; zero cells are absent."""
    d = df.where(F.col(row).isin(*rows))
    return count_by(d, row, column).join(top(d, column, k).select(column), column, "left_semi").select(row, column, "n")


def merge_duplicates(df: DataFrame, key: str, order: str, carry: Sequence[str]) -> DataFrame:
    """One row per key, the last by `order`; `carry` columns take the last value that is not empty.

    Both are aggregates with map-side combine, so a key of very many rows is no burden.
    """
    rest = [c for c in df.columns if c != key and c not in carry]
    filled = lambda c: F.when(F.length(F.trim(F.col(c).cast("string"))) > 0, F.col(order))
    last = F.max_by(F.struct(*rest), order)
    d = df.groupBy(key).agg(last.alias("last_"), *[F.max_by(c, filled(c)).alias(c) for c in carry])
    return d.select(key, *[F.col(f"last_.{c}").alias(c) for c in rest], *carry)


def span_of(df: DataFrame, value: str, distinct: str) -> DataFrame:
    """least, greatest, number of distinct and of rows, as one row."""
    return df.agg(F.min(value).alias("least"), F.max(value).alias("greatest"), F.countDistinct(distinct).alias("n_distinct"), F.count("*").alias("n"))


def facet_values(df: DataFrame, array: str) -> DataFrame:
    """sorted distinct known items of an array column."""
    return items_of(df, array, "item").distinct().orderBy("item")


def first_seen(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """distinct keys in the order in which they first occur, with the place from 1."""
    d = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("first_"))
    return numbered(d, ["first_", key]).select(key, "place")


def differs_from_reference(df: DataFrame, group: str, order: str | Sequence[str], column: str) -> DataFrame:
    """per group how many rows differ (null-safely) from the group's first row by `order`, nulls last.

    Rows are counted by group and value first, with the least order of each; the value that comes first is the
    reference, of values that come first together null or else the lowest, so runs agree. Both steps combine before the
    shuffle, so a group of very many rows is no burden.
    """
    least = F.struct(*[x for c in ([order] if isinstance(order, str) else order) for x in (F.col(c).isNull(), F.col(c))])
    counts = df.groupBy(group, F.col(column).alias("v_")).agg(F.count("*").alias("n_"), F.min(least).alias("o_"))
    return counts.groupBy(group).agg((F.sum("n_") - F.min_by("n_", F.struct("o_", "v_"))).alias("n_different"))


def nest(df: DataFrame, group: str, order: str, *columns: str, out: str = "children") -> DataFrame:
    """F16: children as a sorted array of structs under their parent."""
    return df.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, *columns))).alias(out))


def color_mode(pixels: DataFrame, image: str = "image_id", cut: float = 10.0) -> DataFrame:
    """mean channels by image, and Color if the mean spread of channels is over `cut`, else Monochrome."""
    spread = F.avg(F.greatest("r", "g", "b") - F.least("r", "g", "b"))
    d = pixels.groupBy(image).agg(F.avg("r").alias("r"), F.avg("g").alias("g"), F.avg("b").alias("b"), spread.alias("spread"))
    return d.withColumn("mode", F.when(F.col("spread") > cut, "Color").otherwise("Monochrome"))


def merge_indexes(*ranked: DataFrame) -> DataFrame:
    """indexes `(node, items)` from the least to the most preferred; a later one replaces a node's whole list."""
    every = None
    for rank, d in enumerate(ranked):
        d = d.select("node", "items", F.lit(rank).alias("rank_"))
        every = d if every is None else every.unionByName(d)
    return every.groupBy("node").agg(F.max_by("items", "rank_").alias("items"))


def match_summary(df: DataFrame, matched: Column, changed: Column) -> DataFrame:
    """rows, matched, unmatched and changed, as one row."""
    m = F.coalesce(matched, F.lit(False)).cast("int")
    return df.agg(F.count("*").alias("n"), F.sum(m).alias("matched"), F.sum(1 - m).alias("unmatched"), F.sum(F.coalesce(changed, F.lit(False)).cast("int")).alias("changed"))


def check_report(checks: Sequence[tuple[str, DataFrame, bool]]) -> DataFrame:
    """`(check, rows, status)`; a check passes if it has rows where rows are wanted, or none where none are."""
    out = None
    for name, df, wanted in checks:
        n = F.count("*")
        d = df.agg(n.alias("rows")).select(F.lit(name).alias("check"), "rows", F.when((F.col("rows") > 0) == F.lit(wanted), "pass").otherwise("fail").alias("status"))
        out = d if out is None else out.unionByName(d)
    return out
