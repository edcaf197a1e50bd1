"""Extraction from pages by pattern. Scripts, styles and comments are dropped first, since they may hold tags."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scalars import blank_to_null


def clean(html: Column) -> Column:
    return F.regexp_replace(F.coalesce(html, F.lit("")), r"(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>", "")


def strip_tags(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<[^>]*>", " "), r"\s+", " "))


def extract_links(pages: DataFrame, prefix: str, base: str, id_col: str = "page_id", html_col: str = "html", min_parts: int = 3) -> DataFrame:
    """B1: `(id_col, pos, url)`: hrefs that start with `prefix` and have at least `min_parts` parts between slashes, after `base`."""
    hrefs = F.regexp_extract_all(clean(F.col(html_col)), F.lit(r"""href=["']([^"']+)["']"""), F.lit(1))
    links = pages.select(id_col, F.posexplode(hrefs).alias("pos", "href"))
    return links.where(F.col("href").startswith(prefix) & (F.size(F.split("href", "/")) >= min_parts)).select(id_col, "pos", F.concat(F.lit(base), "href").alias("url"))


def max_page(text: Column) -> Column:
    """B2: the highest number after `?page=` or `&page=`, at least 1."""
    found = F.transform(F.regexp_extract_all(text, F.lit(r"[?&]page=(\d+)"), F.lit(1)), lambda x: x.try_cast("int"))
    return F.greatest(F.coalesce(F.array_max(found), F.lit(1)), F.lit(1))


def attribute(tag: Column, name: str) -> Column:
    return blank_to_null(F.regexp_extract(tag, rf"""(?is)\b{name}\s*=\s*["']([^"']*)["']""", 1))


def extract_items(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", item: str = r"""(?is)<a\b[^>]*class=["'][^"']*\bitem\b[^"']*["'][^>]*>.*?</a>""") -> DataFrame:
    """Gallery items with an image, `(id_col, pos, photo_id, photo_url, image_url, alt)`; a url seen before on the page is dropped.

    The image is `data-image`, else a `src` under photos/images with its full-size form.
    """
    blocks = F.regexp_extract_all(clean(F.col(html_col)), F.lit(item), F.lit(0))
    d = pages.select(id_col, F.posexplode(blocks).alias("pos", "block")).where(F.col("block").rlike(r"(?is)<img\b"))
    img = F.regexp_extract("block", r"(?is)<img\b[^>]*>", 0)
    src = attribute(img, "src")
    image = F.coalesce(attribute(img, "data-image"), attribute(F.col("block"), "data-image"), F.when(src.contains("photos/images"), F.replace(src, F.lit("masonry"), F.lit("original"))))
    href = attribute(F.col("block"), "href")
    d = d.select(id_col, "pos", blank_to_null(F.regexp_extract(href, r"/photos/(\d+)", 1)).alias("photo_id"), href.alias("photo_url"), image.alias("image_url"), attribute(img, "alt").alias("alt")).where("image_url IS NOT NULL")
    w = W.partitionBy(id_col, "image_url").orderBy("pos")
    return d.withColumn("k_", F.row_number().over(w)).where("k_ = 1").drop("k_")


def list_items(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Navigation entries `(id_col, pos, href, label)`, the first of each href on a page."""
    blocks = F.regexp_extract_all(clean(F.col(html_col)), F.lit(r"(?is)<li>\s*<a\b[^>]*>.*?</a>"), F.lit(0))
    d = pages.select(id_col, F.posexplode(blocks).alias("pos", "block"))
    d = d.select(id_col, "pos", attribute(F.col("block"), "href").alias("href"), strip_tags(F.col("block")).alias("label"))
    return d.withColumn("k_", F.row_number().over(W.partitionBy(id_col, "href").orderBy("pos"))).where("k_ = 1").drop("k_")


def extract_fields(pages: DataFrame, fields: Sequence[str], lists: Sequence[str] = ("type", "tags"), id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """Key and value pairs of `<dt>`/`<dd>` sidebars; the first label that holds a field's name wins, list fields are split at commas."""
    pairs = F.regexp_extract_all(clean(F.col(html_col)), F.lit(r"(?is)<dt\b[^>]*>.*?</dt>\s*<dd\b[^>]*>.*?</dd>"), F.lit(0))
    d = pages.select(id_col, F.posexplode_outer(pairs).alias("pos", "pair"))
    label = F.lower(strip_tags(F.regexp_extract("pair", r"(?is)<dt\b[^>]*>(.*?)</dt>", 1)))
    value = blank_to_null(strip_tags(F.regexp_extract("pair", r"(?is)<dd\b[^>]*>(.*)</dd>", 1)))
    d = d.select(id_col, "pos", label.alias("label"), value.alias("value"))
    firsts = d.groupBy(id_col).agg(*[F.min_by("value", F.when(F.col("label").contains(f) & F.col("value").isNotNull(), F.col("pos"))).alias(f) for f in fields])
    split = lambda f: F.filter(F.transform(F.split(F.coalesce(f, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    return firsts.select(id_col, *[split(f).alias(f) if f in lists else F.col(f) for f in fields])


def parse_count(text: Column) -> Column:
    """The first number, its commas and points removed; null without one."""
    return F.regexp_replace(F.regexp_extract(text, r"(\d[\d,.]*)", 1), "[,.]", "").try_cast("bigint")


def first_paragraph_after(html: Column, heading: str) -> Column:
    """Text of the first paragraph after the heading (a pattern of its tag and text); null if none."""
    return blank_to_null(strip_tags(F.regexp_extract(clean(html), rf"(?is){heading}.*?<p\b[^>]*>(.*?)(?=</p>|<p\b|</article>|$)", 1)))


# Words that mark an image of the interface.
UI_WORDS = ("newsletter", "facebook", "instagram", "tiktok", "twitter", "youtube", "discord", "snapchat", "avatar", "icon", "profile", "logo", "stamp", "user", "svg", "button", "badge", "submit", "favorite", "kym", "deadpool")


def is_ui_image(alt: Column, src: Column, cls: Column, width: Column, height: Column, words: Sequence[str] = UI_WORDS, side: int = 64) -> Column:
    """A word of the interface in alt, src or class, or both sides at most `side` pixels."""
    every = F.lower(F.concat_ws(" ", alt, src, cls))
    return every.rlike("|".join(words)) | F.coalesce((width <= side) & (height <= side), F.lit(False))


def choose_image(html: Column, banned: Sequence[str] = ("default", "blank.")) -> Column:
    """The entry icon if it is a GIF, else og:image, else twitter:image, else the first section image that is no interface image; banned names give null."""
    h = clean(html)
    icon = blank_to_null(F.regexp_extract(h, r"""(?is)<img\b[^>]*class=["'][^"']*entry-icon[^"']*["'][^>]*src=["']([^"']+\.gif[^"']*)["']""", 1))
    meta = lambda name: blank_to_null(F.regexp_extract(h, rf"""(?is)<meta\b[^>]*(?:property|name)=["']{name}["'][^>]*content=["']([^"']+)["']""", 1))
    section = F.filter(F.regexp_extract_all(F.regexp_extract(h, r"(?is)<section\b.*?</section>", 0), F.lit(r"(?is)<img\b[^>]*>"), F.lit(0)), lambda t: ~is_ui_image(attribute(t, "alt"), attribute(t, "src"), attribute(t, "class"), attribute(t, "width").try_cast("int"), attribute(t, "height").try_cast("int")))
    found = F.coalesce(icon, meta("og:image"), meta("twitter:image"), attribute(F.try_element_at(section, F.lit(1)), "src"))
    bad = F.lit(False)
    for b in banned:
        bad = bad | F.lower(found).contains(b)
    return F.when(~bad, found)


def count_with_fallback(html: Column, item: str) -> Column:
    """N of "N Photos", else of "of N", else the number of items; null if nothing is found."""
    text = strip_tags(clean(html))
    one = F.regexp_replace(F.regexp_extract(text, r"(?i)(\d[\d,]*)\s+photos?\b", 1), ",", "").try_cast("bigint")
    two = F.regexp_replace(F.regexp_extract(text, r"(?i)\bof\s+(\d[\d,]*)", 1), ",", "").try_cast("bigint")
    return F.coalesce(one, two, F.nullif(F.regexp_count(clean(html), F.lit(item)), F.lit(0)).cast("bigint"))
