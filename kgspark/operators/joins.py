"""Joins. Sides are broadcast only where Spark's own size estimate allows it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def lookup_with_fallback(df: DataFrame, keys: Sequence[str], table: DataFrame, table_key: str, value: str, default=None, out: str = "value") -> DataFrame:
    """Value of the first of several keys that the table holds, else a default. `table` has one row per key."""
    found = []
    for i, k in enumerate(keys):
        t = table.select(F.col(table_key).alias(f"k{i}_"), F.col(value).alias(f"v{i}_"))
        df = df.join(t, df[k] == t[f"k{i}_"], "left").drop(f"k{i}_")
        found.append(f"v{i}_")
    return df.withColumn(out, F.coalesce(*found, F.lit(default))).drop(*found)


def overlay(df: DataFrame, more: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns replaced where `more` has a non-null value for the key; one row per key in `more`."""
    m = more.select(F.col(key).alias("key_"), *[F.col(c).alias(f"{c}_new_") for c in columns])
    j = df.join(m, df[key] == m["key_"], "left").drop("key_")
    for c in columns:
        j = j.withColumn(c, F.coalesce(f"{c}_new_", c) if c in df.columns else F.col(f"{c}_new_"))
    return j.drop(*[f"{c}_new_" for c in columns])


def patch(df: DataFrame, patches: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns replaced, by nulls too, where a patch row exists; adds `patched`."""
    m = patches.select(F.col(key).alias("key_"), *[F.col(c).alias(f"{c}_new_") for c in columns])
    j = df.join(m, df[key] == m["key_"], "left")
    for c in columns:
        j = j.withColumn(c, F.when(F.col("key_").isNotNull(), F.col(f"{c}_new_")).otherwise(F.col(c)))
    return j.withColumn("patched", F.col("key_").isNotNull()).drop("key_", *[f"{c}_new_" for c in columns])


def sync(df: DataFrame, fresh: DataFrame, key: str, columns: Sequence[str], keep_if_empty: bool = True) -> DataFrame:
    """Columns from `fresh`, and `changed`, how many cells of the row differ afterwards. Empty fresh cells leave the old value if `keep_if_empty`."""
    m = fresh.select(F.col(key).alias("key_"), *[F.col(c).alias(f"{c}_new_") for c in columns])
    j = df.join(m, df[key] == m["key_"], "left")
    there = F.col("key_").isNotNull()
    changed = F.lit(0)
    for c in columns:
        new = F.col(f"{c}_new_")
        empty = new.isNull() | (F.trim(new.cast("string")) == "")
        j = j.withColumn(f"{c}_new_", F.when(there & ~(empty if keep_if_empty else F.lit(False)), new).otherwise(F.col(c)))
        changed = changed + (~F.col(c).eqNullSafe(F.col(f"{c}_new_"))).cast("int")
    j = j.withColumn("changed", changed)
    for c in columns:
        j = j.withColumn(c, F.col(f"{c}_new_"))
    return j.drop("key_", *[f"{c}_new_" for c in columns])


def link_parents(children: DataFrame, parents: DataFrame, child_key: Column, parent_keys: Sequence[Column], parent_id: str) -> DataFrame:
    """E5: `parent_id` of each child by the first of several forms of the parent's key that fits; of equal keys the least id wins."""
    c = children.withColumn("ck_", child_key)
    found = []
    for i, k in enumerate(parent_keys):
        p = parents.groupBy(k.alias(f"pk{i}_")).agg(F.min(parent_id).alias(f"pid{i}_"))
        c = c.join(p, F.col("ck_") == F.col(f"pk{i}_"), "left").drop(f"pk{i}_")
        found.append(f"pid{i}_")
    return c.withColumn("parent_id", F.coalesce(*found)).drop("ck_", *found)


def prefix_match(left: DataFrame, right: DataFrame, left_key: str, right_key: str) -> DataFrame:
    """For each distinct left key its right key: the same one, else the one with `_` before it, else the first (by code points) of which one is a prefix of the other.

    Instead of comparing all pairs, each right key is dealt by every prefix of it and by itself, and each left key
    likewise, so a pair meets by one equality. Empty keys are the same as each other and a prefix of no other.
    """
    lk, rk = left.select(F.col(left_key).alias("l")).where("l IS NOT NULL").distinct(), right.select(F.col(right_key).alias("r")).where("r IS NOT NULL").distinct()
    cuts = lambda c: F.when(F.length(c) > 0, F.transform(F.sequence(F.lit(1), F.length(c)), lambda n: F.left(F.col(c), n))).otherwise(F.array(F.lit("")))
    down = lk.select("l", F.explode(cuts("l")).alias("cut")).join(rk, F.col("cut") == F.col("r")).select("l", "r")
    # of all right keys with a beginning only the first by code points can win, so each beginning keeps one
    begun = rk.select("r", F.explode(cuts("r")).alias("cut")).groupBy("cut").agg(F.min("r").alias("r"))
    up = lk.join(begun, F.col("l") == F.col("cut")).select("l", "r")
    marked = lk.join(rk, F.concat(F.lit("_"), F.col("l")) == F.col("r")).select("l", "r")
    rank = F.when(F.col("l") == F.col("r"), 0).when(F.concat(F.lit("_"), F.col("l")) == F.col("r"), 1).otherwise(2)
    every = down.unionByName(up).unionByName(marked).groupBy("l").agg(F.min(F.struct(rank.alias("k"), "r")).alias("best"))
    return every.select(F.col("l").alias(left_key), F.col("best.r").alias(right_key))


def densify(counts: DataFrame, domains: Mapping[str, DataFrame], value: str) -> DataFrame:
    """Every combination of the dimension values, missing ones with zero. The domains are tables of axis values, as small as axes are."""
    grid = None
    for name, d in domains.items():
        d = d.select(name).distinct()
        grid = d if grid is None else grid.crossJoin(d)
    return grid.join(counts, list(domains), "left").withColumn(value, F.coalesce(value, F.lit(0)))


def intersect_or_first(index: DataFrame, first: str, second: str, key: str = "node", item: str = "slug") -> DataFrame:
    """Items of both index entries; those of the first where there are none. `index` is a long table (key, item)."""
    a = index.where(F.col(key) == first).select(item).distinct()
    b = index.where(F.col(key) == second).select(item).distinct()
    both = a.join(b, item, "left_semi")
    some = both.limit(1).agg((F.count("*") > 0).alias("some_"))
    own = both.withColumn("own_", F.lit(True))
    # one row tells whether any item is in both
    return a.join(own, item, "left").crossJoin(F.broadcast(some)).where(~F.col("some_") | F.col("own_")).select(item)


def external_ids(df: DataFrame, ids: DataFrame, label: str, out: str, local: Column) -> DataFrame:
    """External id of a label, else a local name. `ids` has `(label, external_id)`."""
    i = ids.select(F.col("label").alias("label_"), F.col("external_id").alias("ext_"))
    return df.join(i, df[label] == i["label_"], "left").withColumn(out, F.coalesce("ext_", local)).drop("label_", "ext_")


def coverage(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys missing on the other side, `(key, side)` where side tells who lacks it: `b` or `a`."""
    x, y = a.select(key).distinct(), b.select(key).distinct()
    return x.join(y, key, "left_anti").withColumn("missing_in", F.lit("b")).unionByName(y.join(x, key, "left_anti").withColumn("missing_in", F.lit("a")))
