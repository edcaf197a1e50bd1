"""Filters and predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import UNKNOWN, blank_to_null, url_extension

SENTINELS = (UNKNOWN, "None")


def is_known(c: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """Neither null, blank nor a sentinel."""
    return blank_to_null(c).isNotNull() & ~F.coalesce(F.trim(c).isin(*sentinels), F.lit(False))


def known_items(values: Column, sentinels: Sequence[str] = SENTINELS) -> Column:
    """The known items of an array."""
    return F.filter(values, lambda x: is_known(x, sentinels))


def in_range(c: Column, low, high) -> Column:
    """Between two bounds, both included; null is out."""
    return F.coalesce(c.between(low, high), F.lit(False))


def drop_impossible(df: DataFrame, rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """D3: rows whose combination of keys is in the rule table go. Nulls match no rule."""
    return df.join(rules.select(*keys).distinct(), list(keys), "left_anti")


def without_keywords(df: DataFrame, text: str, words: Sequence[str]) -> DataFrame:
    """Rows whose text holds any of the words as a whole word, in either case, go; null texts stay."""
    if not words:
        return df
    pattern = r"(?i)\b(?:" + "|".join(rf"\Q{w}\E" for w in words) + r")\b"
    return df.where(~F.coalesce(F.col(text).rlike(pattern), F.lit(False)))


def without_key_keywords(df: DataFrame, rules: DataFrame, key: str, text: str) -> DataFrame:
    """Rows go whose text holds a word of their own key's list. `rules` has `(key, word)`; the join is on the key."""
    r = rules.groupBy(key).agg(F.collect_set(F.lower("word")).alias("words_"))
    j = df.join(r, key, "left")
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    hit = F.exists(F.coalesce("words_", F.array().cast("array<string>")), lambda w: F.array_contains(F.split(low, r"[^\p{L}\p{N}_]+"), w))
    return j.where(~hit).drop("words_")


def without_ids(df: DataFrame, blocked: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose keys are in a list go."""
    return df.join(blocked.select(*keys).distinct(), list(keys), "left_anti")


def only_ids(df: DataFrame, wanted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Only rows whose keys are in a list."""
    return df.join(wanted.select(*keys).distinct(), list(keys), "left_semi")


def faceted(df: DataFrame, text: str | None = None, in_text: Sequence[str] = ("slug", "title"), item: Mapping[str, str] | None = None, equal: Mapping[str, object] | None = None) -> DataFrame:
    """Substring of any text column, and items of array columns, and equal columns; each may be left out."""
    out = df
    if text:
        hit = F.lit(False)
        for c in in_text:
            hit = hit | F.coalesce(F.lower(c).contains(text.lower()), F.lit(False))
        out = out.where(hit)
    for c, v in (item or {}).items():
        out = out.where(F.array_contains(c, v))
    for c, v in (equal or {}).items():
        out = out.where(F.col(c) == v)
    return out


def needs_backfill(fields: Sequence[str], numbers: Sequence[str] = ()) -> Column:
    """A field is null or blank, or a number unreadable."""
    out = F.lit(False)
    for c in fields:
        out = out | blank_to_null(F.col(c).cast("string")).isNull()
    for c in numbers:
        out = out | F.trim(F.col(c).cast("string")).try_cast("bigint").isNull()
    return out


def complete(df: DataFrame, required: Sequence[str]) -> DataFrame:
    """Rows that have all required fields."""
    return df.where(~needs_backfill(required))


def label_contains(df: DataFrame, text: str, label: str = "label") -> DataFrame:
    """Rows whose label holds the text, in either case."""
    return df.where(F.lower(label).contains(text.lower()))


def unchecked_stills(df: DataFrame, checked: DataFrame, url: str, keys: Sequence[str]) -> DataFrame:
    """Rows whose url is not a GIF and that are not in the table of checked rows."""
    return df.where(url_extension(F.col(url)) != ".gif").join(checked.select(*keys).distinct(), list(keys), "left_anti")


def starts_with_bytes(content: Column, magic: bytes = b"GIF") -> Column:
    """Binary content starts with the given bytes."""
    return F.substring(content, 1, len(magic)) == F.lit(bytearray(magic))
