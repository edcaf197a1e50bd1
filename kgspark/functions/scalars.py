"""Normalising column expressions. All are built-in expressions, so they stay in the JVM and in codegen where Spark allows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of image files and the periods of years.
FILE_FORMATS = {".jpg": "JPEG", ".jpeg": "JPEG", ".png": "PNG", ".gif": "GIF", ".webp": "WebP", ".bmp": "BMP"}
PERIODS = ((2010, "Pre2010"), (2016, "Period2010to2015"), (2021, "Period2016to2020"), (None, "Period2021toPresent"))
CONTENT_TYPES = {"image/jpeg": ".jpg", "image/png": ".png", "image/gif": ".gif", "image/webp": ".webp"}

UNKNOWN = "Unknown"


def literal_map(mapping: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]) if mapping else F.create_map().cast("map<string,string>")


def blank_to_null(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def map_list(values: Column, mapping: Mapping[str, str], default: str = UNKNOWN) -> Column:
    """Each item by its trimmed lower-case key, unmapped items trimmed; null and empty give `[default]`."""
    m = literal_map(mapping)
    out = F.transform(values, lambda x: F.coalesce(F.try_element_at(m, F.lower(F.trim(x))), F.trim(x)))
    return F.when(F.coalesce(F.size(values), F.lit(0)) > 0, out).otherwise(F.array(F.lit(default)))


def split_origin(text: Column, mapping: Mapping[str, str], mode: str = "word") -> Column:
    """struct(platform, work). Blank: (Unknown, null). Exact key, else the first key found in the text, else the text as work.

    mode "contains" finds keys anywhere (so a one-letter key fits any text that has the letter), "word" at word bounds.
    """
    key = F.lower(F.trim(text))
    found = F.try_element_at(literal_map(mapping), key)
    for k, v in mapping.items():
        fits = key.contains(k) if mode == "contains" else key.rlike(rf"(^|[^\p{{L}}\p{{N}}])\Q{k}\E($|[^\p{{L}}\p{{N}}])")
        found = F.coalesce(found, F.when(fits, F.lit(v)))
    empty = blank_to_null(text).isNull()
    return F.struct(F.when(empty, F.lit(UNKNOWN)).otherwise(found).alias("platform"), F.when(~empty & found.isNull(), F.trim(text)).alias("work"))


def categorise(text: Column, rules: Sequence[tuple[str, Sequence[str]]], never: str = r"^/[\w-]+/$") -> Column:
    """Category of the first rule of which a keyword occurs; null for blank texts and those that match `never`."""
    low = F.lower(F.trim(text))
    out = F.when(blank_to_null(text).isNull() | F.trim(text).rlike(never), F.lit(None).cast("string"))
    for category, words in rules:
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = out.when(hit, F.lit(category))
    return out


def map_region(text: Column, mapping: Mapping[str, str]) -> Column:
    """C4: mapped region, the trimmed text if unmapped, Unknown if blank."""
    known = F.try_element_at(literal_map(mapping), F.lower(F.trim(text)))
    return F.when(blank_to_null(text).isNull(), F.lit(UNKNOWN)).otherwise(F.coalesce(known, F.trim(text)))


def map_regions(text: Column, mapping: Mapping[str, str]) -> Column:
    """C4: the regions of a comma-separated list, without Unknown."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: map_region(x, mapping)), lambda x: x != UNKNOWN)


def year_bucket(year: Column, periods=PERIODS) -> Column:
    """struct(year int, period); unreadable years give (null, Unknown). Each period ends below its number."""
    y = F.trim(year.cast("string")).try_cast("int")
    out = F.when(y.isNull(), F.lit(UNKNOWN))
    for below, label in periods:
        out = out.otherwise(F.lit(label)) if below is None else out.when(y < below, F.lit(label))
    return F.struct(y.alias("year"), out.alias("period"))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1)


def url_extension(url: Column) -> Column:
    """Lower-case extension of the path, with its dot; empty if none."""
    return F.lower(F.regexp_extract(url_path(url), r"[^/](\.[^./]+)$", 1))


def file_format(extension: Column) -> Column:
    """Format of an extension, else Unknown."""
    return F.coalesce(F.try_element_at(literal_map(FILE_FORMATS), extension), F.lit(UNKNOWN))


def animation_status(extension: Column) -> Column:
    """Animated for .gif, else Static."""
    return F.when(extension == ".gif", "Animated").otherwise("Static")


def extension_for(url: Column, content_type: Column, default: str = ".jpg") -> Column:
    """Extension by url if it is an image's, else by content type, else the default."""
    ext = url_extension(url)
    known = F.when(ext.isin(*FILE_FORMATS), ext)
    kind = F.try_element_at(literal_map(CONTENT_TYPES), F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1)))))
    return F.coalesce(known, kind, F.lit(default))


def slug_from_file(name: Column) -> Column:
    """File name without folder, extension and leading four digits with underscore."""
    stem = F.regexp_replace(F.regexp_extract(name, r"([^/\\]*)$", 1), r"(.)\.[^.]*$", "$1")
    return F.regexp_replace(stem, r"^\d{4}_", "")


def local_name_for(label: Column, lower: bool = False) -> Column:
    """Label as a safe local name: other signs to `_`, runs of it shrunk, ends trimmed, `_` before a digit, Unknown if nothing is left."""
    s = F.regexp_replace(F.trim(F.coalesce(label, F.lit(""))), r"[^\p{L}\p{N}_-]", "_")
    s = F.regexp_replace(F.regexp_replace(s, "_+", "_"), "^_+|_+$", "")
    s = F.when(s == "", F.lit(UNKNOWN)).when(s.rlike(r"^\p{Nd}"), F.concat(F.lit("_"), s)).otherwise(s)
    return F.lower(s) if lower else s


def slug_from_title(title: Column, ascii_only: bool = False) -> Column:
    """C11: lower case, punctuation dropped, blanks and runs of `-` to one `-`, ends trimmed."""
    keep = r"[^a-z0-9\s-]" if ascii_only else r"[^\p{L}\p{N}_\s-]"
    s = F.regexp_replace(F.lower(title), keep, "")
    return F.regexp_replace(F.regexp_replace(s, r"[\s-]+", "-"), "^-+|-+$", "")


def slug_from_url(url: Column) -> Column:
    """Last segment of a url, its final slashes removed."""
    return F.element_at(F.split(F.regexp_replace(url, "/+$", ""), "/"), -1)


def title_from_slug(slug: Column, first_letter_only: bool = False) -> Column:
    """`-` to blanks, each word with an upper-case first letter; the rest lower case, or as it stands."""
    words = F.split(F.translate(slug, "-", " "), " ")
    rest = (lambda w: F.substr(w, F.lit(2))) if first_letter_only else (lambda w: F.lower(F.substr(w, F.lit(2))))
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), rest(w))), " ")


def safe_file_name(text: Column, cap: int = 80) -> Column:
    """C14: other signs than letters, digits, `_`, `-` and `.` to `_`, at most `cap` signs."""
    return F.left(F.regexp_replace(text, r"[^\p{L}\p{N}_.-]", "_"), F.lit(cap))


def numbered_file_name(number: Column, base: Column, extension: Column, digits: int = 4) -> Column:
    """C14: number with leading zeros, `_`, base and extension."""
    return F.concat(F.format_string(f"%0{digits}d_", number), base, extension)


def as_array(text: Column) -> Column:
    """A JSON array of strings as an array, another text as its only item, null and blank as empty."""
    t = F.trim(text)
    return F.when(blank_to_null(text).isNull(), F.array().cast("array<string>")).when(t.startswith("["), F.from_json(t, "array<string>")).otherwise(F.array(t))


def iri(namespace: str, name: Column) -> Column:
    """Namespace and local name."""
    return F.concat(F.lit(namespace), name)


def local_name(c: Column) -> Column:
    """What follows the last `#` or `/`; the whole text if there is none."""
    return F.regexp_extract(c, r"([^#/]*)$", 1)


def shorten(c: Column, prefixes: Sequence[tuple[str, str]]) -> Column:
    """Prefix and rest by the first namespace that fits; others as they stand."""
    out = None
    for prefix, namespace in prefixes:
        short = F.concat(F.lit(f"{prefix}:"), F.substr(c, F.lit(len(namespace) + 1)))
        out = F.when(c.startswith(namespace), short) if out is None else out.when(c.startswith(namespace), short)
    return c if out is None else out.otherwise(c)


def escape_literal(c: Column) -> Column:
    """C17: for N-Triples and Turtle; the backslash first."""
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape_literal(c: Column) -> Column:
    """Inverse of `escape_literal`; a sign that occurs in no escaped text keeps double backslashes apart meanwhile."""
    c = F.replace(c, F.lit("\\\\"), F.lit("\x00"))
    for a, b in (('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\x00", "\\")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_markup(c: Column) -> Column:
    """C17: for XML and HTML; the ampersand first."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def relabel(c: Column, mapping: Mapping[str, str]) -> Column:
    """Mapped label; unknown labels pass. Give the reversed mapping for the way back."""
    return F.coalesce(F.try_element_at(literal_map(mapping), c), c)


def safe_long(c: Column, default: int | None = None) -> Column:
    """Whole number of a trimmed text, else the default."""
    return F.coalesce(F.trim(c.cast("string")).try_cast("bigint"), F.lit(default).cast("bigint"))


def ellipsis(c: Column, n: int, mark: str = "…") -> Column:
    """The first n signs, with a mark if there were more."""
    return F.when(F.length(c) > n, F.concat(F.left(c, F.lit(n)), F.lit(mark))).otherwise(c)


def text_key(c: Column) -> Column:
    """Lower case, runs of blanks as one, ends trimmed."""
    return F.trim(F.regexp_replace(F.lower(c), r"\s+", " "))


def title_or(title: Column, alt: Column, name: Column, index: Column, n: int = 100) -> Column:
    """Title, else the first n signs of alt, else `<name> variant <index>`."""
    return F.coalesce(blank_to_null(title), blank_to_null(F.left(alt, F.lit(n))), F.concat(name, F.lit(" variant "), index.cast("string")))


def thousands(c: Column, decimals: int = 0) -> Column:
    """Number with thousands separated by commas."""
    return F.format_number(c, decimals)


def rewrite_namespace(c: Column, pairs: Sequence[tuple[str, str]]) -> Column:
    """Each old text replaced by its new one, in the order given."""
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def rgb_to_hsl(r: Column, g: Column, b: Column, zeros: bool = True) -> Column:
    """struct(h degrees, s %, l %) of mean channels 0 to 255, to one decimal; null channels give zeros.

    Without `zeros` a null channel leaves s and l to the others, and h is null unless they are equal. Numbers are rounded
    after they were multiplied by ten, as SQL engines do it: 31.049999999999997 gives 310.5 and so 31.1.
    """
    x, y, z = r / 255, g / 255, b / 255
    hi, lo = F.greatest(x, y, z), F.least(x, y, z)
    d, light = hi - lo, (hi + lo) / 2
    s = F.when(d == 0, 0.0).otherwise(d / F.when(light <= 0.5, hi + lo).otherwise(2 - hi - lo))
    sixth = F.when(x == hi, (y - z) / d).when(y == hi, 2 + (z - x) / d).otherwise(4 + (x - y) / d)
    h = F.when(d == 0, 0.0).otherwise(F.pmod(sixth / 6, F.lit(1.0)))
    off = (r.isNull() | g.isNull() | b.isNull()) & F.lit(zeros)
    part = lambda v, k: F.when(off, 0.0).otherwise(F.round(v * k * 10) / 10)
    return F.struct(part(h, 360).alias("h"), part(s, 100).alias("s"), part(light, 100).alias("l"))


def iso_utc(ts: Column) -> Column:
    """Timestamp as ISO text with seconds and Z; the session's zone is UTC."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")
