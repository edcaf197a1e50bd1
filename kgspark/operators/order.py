"""In-group order, top-k, pages and samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..storage import stored


def reindex(df: DataFrame, group: str, order: Sequence[str], out: str = "new_idx") -> DataFrame:
    """Rows of a group numbered from 1 in order. One task sorts a group, by spilling to disk if it must."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(group).orderBy(*order)))


def reindex_wide(df: DataFrame, group: str, order: Sequence[str], out: str = "new_idx") -> DataFrame:
    """W1 where one group may hold a great part of all rows: its ranges are numbered by many tasks, at the price of a stored sort."""
    return running(df, group, order, F.lit(1).cast("long"), out)


def ordinal(c: Column, values: Sequence[str]) -> Column:
    """Place in a list from 1; what is not listed (null too) is 0 and so sorts first."""
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in values]), c), F.lit(0)).cast("int")


def keep_first(df: DataFrame, keys: Sequence[Column], order: Sequence[str]) -> DataFrame:
    """The first row of each key, which is the first of `keys` that is not blank; rows without a key are one group.

    An aggregate with map-side combine, so a key of very many rows is no burden. Rows alike in `order` are told apart
    by their other columns.
    """
    key = F.coalesce(*[F.nullif(F.trim(k.cast("string")), F.lit("")) for k in keys])
    row = F.struct(*[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.struct(*df.columns).alias("row"))
    return df.groupBy(key.alias("key_")).agg(F.min(row).alias("first_")).select("first_.row.*")


def dealt(df: DataFrame, group: str | None, order: Sequence) -> DataFrame:
    """The rows sorted by range over many tasks and stored: `part_` is a row's range, `in_` its place in the range.

    What is counted over the ranges and what is read again are the same stored rows, so that places agree.
    """
    d = df.sort(*([group] if group else []), *order).withColumn("mid_", F.monotonically_increasing_id())
    return stored(d.withColumn("part_", F.shiftright("mid_", 33)).withColumn("in_", F.col("mid_").bitwiseAND(F.lit((1 << 33) - 1))).drop("mid_"))


def _earlier(sums: DataFrame, value: str, out: str) -> DataFrame:
    """For each range the sum over the ranges before it; the table has one row for each."""
    w = W.partitionBy(F.lit(0)).orderBy("part_").rowsBetween(W.unboundedPreceding, -1)
    return sums.select("part_", F.coalesce(F.sum(value).over(w), F.lit(0)).alias(out))


def numbered(df: DataFrame, order: Sequence, out: str = "place") -> DataFrame:
    """All rows numbered from 1 in order.

    Rows are sorted by range over many tasks; each range's rows are numbered after those of the ranges before
    it, whose counts are a table with one row per range. No task sees all rows.
    """
    d = dealt(df, None, order)
    before = _earlier(d.groupBy("part_").agg(F.count("*").alias("n_")), "n_", "base_")
    return d.join(F.broadcast(before), "part_").withColumn(out, (F.col("base_") + F.col("in_") + 1).cast("long")).drop("part_", "in_", "base_")


def running(df: DataFrame, group: str, order: Sequence, value: Column, out: str) -> DataFrame:
    """Sum of `value` over a group's rows up to each row, in order. A group of very many rows lies in many ranges.

    A window runs inside each range of a group only; the sums of the ranges before it are added. Null values add nothing.
    """
    d = dealt(df.withColumn("v_", value), group, order)
    sums = d.groupBy(F.col(group).alias("g_"), F.col("part_").alias("p_")).agg(F.sum("v_").alias("n_"))
    w = W.partitionBy("g_").orderBy("p_").rowsBetween(W.unboundedPreceding, -1)
    # the ranges are sorted by group, so at most one group of a range goes on from the one before: one row for each range
    before = F.broadcast(sums.select("g_", "p_", F.sum("n_").over(w).alias("base_")).where("base_ IS NOT NULL"))
    inside = W.partitionBy(group, "part_").orderBy("in_").rowsBetween(W.unboundedPreceding, 0)
    d = d.withColumn("sum_", F.sum("v_").over(inside))
    j = d.join(before, d[group].eqNullSafe(before["g_"]) & (d["part_"] == before["p_"]), "left")
    return j.withColumn(out, F.coalesce("base_", F.lit(0)) + F.coalesce("sum_", F.lit(0))).drop("v_", "sum_", "p_", "part_", "in_", "base_", "g_")


def running_stack(df: DataFrame, group: str, value: str, *ties: str) -> DataFrame:
    """Within a group by value from the top, where each segment starts and ends."""
    d = running(df, group, [F.desc(value), *ties], F.col(value), "stack_end")
    return d.withColumn("stack_start", F.col("stack_end") - F.col(value))


def ranked(df: DataFrame, value: str, key: str, out: str = "rank") -> DataFrame:
    """Rank of all rows by value from the top (nulls last), then key."""
    return numbered(df, [F.desc_nulls_last(value), key], out)


def tiers(df: DataFrame, value: str, key: str, first: int = 200, second: int = 500) -> DataFrame:
    """Tier 1 for the first `first` rows by value, 2 for the next `second`, 3 for the rest, 4 without a value.

    Only the rows of the upper tiers are ranked: they are found by a limit, which needs no total order.
    """
    best = df.where(F.col(value).isNotNull()).orderBy(F.desc(value), key).limit(first + second)
    best = best.select(F.col(key).alias("key_"), F.row_number().over(W.orderBy(F.desc(value), key)).alias("r_"))
    tier = F.when(F.col(value).isNull(), 4).when(F.col("r_") <= first, 1).when(F.col("r_").isNotNull(), 2).otherwise(3)
    return df.join(best, df[key] == best["key_"], "left").withColumn("tier", tier).drop("key_", "r_")


def grid(df: DataFrame, group: str, order: Sequence[str], rows: int) -> DataFrame:
    """Place in a grid: inside a group column by column, `rows` high; groups stand side by side in order.

    A group's offset is the width of the groups before it, from a table with one row per group, summed over its ranges.
    """
    widths = df.groupBy(group).agg(F.ceil(F.count("*") / rows).cast("long").alias("w_"))
    base = running(widths.withColumn("one_", F.lit(0)), "one_", [group], F.col("w_"), "until_").select(F.col(group).alias("grid_g_"), (F.col("until_") - F.col("w_")).alias("grid_base_"))
    d = running(df, group, order, F.lit(1).cast("long"), "i_").withColumn("i_", F.col("i_") - 1)
    d = d.join(base, d[group].eqNullSafe(base["grid_g_"]))
    return d.withColumn("grid_col", (F.col("grid_base_") + F.floor(F.col("i_") / rows)).cast("long")).withColumn("grid_row", (F.col("i_") % rows).cast("int")).drop("i_", "grid_g_", "grid_base_")


def page(df: DataFrame, order: Sequence, number: int, size: int = 60) -> DataFrame:
    """H4: one page of rows, from page 1."""
    return df.orderBy(*order).offset((number - 1) * size).limit(size)


def page_count(df: DataFrame, size: int = 60) -> DataFrame:
    """H4: rows and pages, as one row."""
    return df.agg(F.count("*").alias("n")).withColumn("pages", F.ceil(F.col("n") / size).cast("long"))


def lot(key: str, seed: int) -> Column:
    """The lot that a key draws: md5 of the seed and the key as text."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit(""))))


def sample(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """H5, H7: n rows of the distinct keys, each as likely as another; the same ones in every run."""
    one = df.dropDuplicates([key])
    return one.orderBy(lot(key, seed), key).limit(n)


def sample_per_group(df: DataFrame, group: str, key: str, n: int, seed: int = 0) -> DataFrame:
    """H6: n rows of each group's distinct keys."""
    one = df.dropDuplicates([group, key])
    w = W.partitionBy(group).orderBy(lot(key, seed), key)
    return one.withColumn("k_", F.row_number().over(w)).where(F.col("k_") <= n).drop("k_")


def first_n(df: DataFrame, order: Sequence, n: int) -> DataFrame:
    """H1, H2, H8: the first n rows in order."""
    return df.orderBy(*order).limit(n)
