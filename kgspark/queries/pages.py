"""Queries of extraction from pages (B), and of sources and sinks that go through files (A)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import frame, with_
from ..functions import extract as x
from ..functions.scalars import slug_from_url
from ..operators.filters import starts_with_bytes
from ..sources import files
from ..storage import scratch

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


CLEAN = r"regexp_replace(coalesce(html, ''), '(?is)<!--.*?-->|<script\b.*?</script>|<style\b.*?</style>', '', 'g')"
STRIP = r"trim(regexp_replace(regexp_replace({}, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))"


@query(f"SELECT page_id, i - 1 AS pos, 'https://example.org' || l[i] AS url FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all({CLEAN}, 'href=[\"'']([^\"'']+)[\"'']', 1) AS l FROM pages)) WHERE starts_with(l[i], '/t') AND len(string_split(l[i], '/')) >= 2")
def b1_links(spark, sf):
    d = x.extract_links(frame(spark, sf, "pages"), "/t", "https://example.org", min_parts=2)
    return d.select("page_id", F.col("pos").cast("long").alias("pos"), "url")


@query("SELECT page_id, greatest(coalesce(list_max(list_transform(regexp_extract_all(url || '&page=' || page_id % 7, '[?&]page=([0-9]+)', 1), lambda v: CAST(v AS INT))), 1), 1) AS last FROM pages")
def b2_max_page(spark, sf):
    return frame(spark, sf, "pages").select("page_id", x.max_page(F.concat("url", F.lit("&page="), (F.col("page_id") % 7).cast("string"))).alias("last"))


@query(f"SELECT page_id, CAST(min(i) - 1 AS BIGINT) AS pos, href FROM (SELECT page_id, i, regexp_extract(l[i], 'href=\"([^\"]*)\"', 1) AS href FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT page_id, regexp_extract_all({CLEAN}, '(?is)<li>\\s*<a\\b[^>]*>.*?</a>') AS l FROM pages))) GROUP BY page_id, href")
def b3_list_items(spark, sf):
    return x.list_items(frame(spark, sf, "pages")).select("page_id", F.col("pos").cast("long").alias("pos"), "href")


#: The pages have no galleries, sidebars or images of their own; these are written behind their text, with the page's title.
TITLE = "coalesce(regexp_extract(html, '<title>([^<]*)</title>', 1), '')"


def _titled(spark, sf, *parts):
    """Pages with more text behind their own; `{t}` stands for the title."""
    title = F.coalesce(F.regexp_extract("html", "<title>([^<]*)</title>", 1), F.lit(""))
    more = F.concat(F.lit(""), *[F.replace(F.lit(p), F.lit("{t}"), title) for p in parts])
    return frame(spark, sf, "pages").withColumns({"title": title, "html": F.concat(F.coalesce("html", F.lit("")), more)})


@query(f"SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY k) - 1 AS pos, CAST(NULL AS VARCHAR) AS photo_id, {TITLE} || k || '/photos/images/original/x' AS image_url FROM pages, (SELECT unnest(range(1, 3)) AS k)")
def b3_gallery(spark, sf):
    one = '<a class="item" href="/photos/x"><img src="{t}{k}/photos/images/masonry/x" alt="a"></a>'
    d = x.extract_items(_titled(spark, sf, *[one.replace("{k}", str(k)) for k in (1, 2, 1)]))
    return d.select("page_id", F.col("pos").cast("long").alias("pos"), "photo_id", "image_url")


@query(f"SELECT page_id, array_to_string(list_filter(list_transform(string_split({STRIP.format(TITLE)}, ','), lambda v: trim(v)), lambda v: v <> ''), ', ') AS type, nullif({STRIP.format(TITLE)}, '') AS year, 'web' AS origin FROM pages")
def b4_fields(spark, sf):
    d = x.extract_fields(_titled(spark, sf, "<dl><dt>Type:</dt><dd>{t}</dd><dt>Year</dt><dd><b>{t}</b></dd><dt>Origin</dt><dd><a>web</a></dd><dt>year again</dt><dd>1</dd></dl>"), ["type", "year", "origin", "tags"])
    return d.select("page_id", F.array_join("type", ", ").alias("type"), "year", "origin")


@query(r"SELECT page_id, TRY_CAST(regexp_replace(regexp_extract(url, '([0-9][0-9,.]*)', 1), '[,.]', '', 'g') AS BIGINT) AS n, CAST(15 AS BIGINT) AS fixed FROM pages")
def b5_counts(spark, sf):
    return frame(spark, sf, "pages").select("page_id", x.parse_count(F.col("url")).alias("n"), x.parse_count(F.lit("about 1.5 million")).alias("fixed"))


@query(f"SELECT page_id, nullif(md5({STRIP.format(chr(123) + '0' + chr(125))}), md5('')) AS p FROM pages".replace("{0}", rf"regexp_extract(regexp_replace({CLEAN}, '(?s)^.*?<h1', '<h1'), '(?is)<h1\b.*?<p\b[^>]*>(.*?)(</p>|<p\b|</article>)', 1)"))
def b6_first_paragraph(spark, sf):
    return frame(spark, sf, "pages").select("page_id", F.md5(x.first_paragraph_after(F.col("html"), r"<h1\b")).alias("p"))


@query(f"SELECT page_id, CASE WHEN length({TITLE}) % 2 = 0 THEN {TITLE} || '.jpg' ELSE 's-' || {TITLE} || '.jpg' END AS image FROM pages")
def b7_choose_image(spark, sf):
    section = "<section><img src='logo.png'><img src='t.jpg' width='20' height='20'><img src='s-{t}.jpg'></section>"
    d = _titled(spark, sf, section)
    og = F.when(F.length("title") % 2 == 0, F.concat(F.lit("<meta property='og:image' content='"), "title", F.lit(".jpg'>"))).otherwise("")
    return d.select("page_id", x.choose_image(F.concat("html", og)).alias("image"))


@query(f"SELECT page_id, regexp_matches(lower(concat_ws(' ', {TITLE}, url)), 'newsletter|facebook|instagram|tiktok|twitter|youtube|discord|snapchat|avatar|icon|profile|logo|stamp|user|svg|button|badge|submit|favorite|kym|deadpool') OR (length({TITLE}) <= 64 AND length(url) <= 64) AS ui FROM pages")
def b8_ui_image(spark, sf):
    d = _titled(spark, sf)
    return d.select("page_id", x.is_ui_image(F.col("title"), F.col("url"), F.lit(None).cast("string"), F.length("title"), F.length("url")).alias("ui"))


@query(f"SELECT page_id, CASE page_id % 3 WHEN 0 THEN 1000 * page_id + 7 WHEN 1 THEN length(url) ELSE nullif(len(regexp_extract_all({CLEAN}, '<li>')), 0) END AS n FROM pages")
def b9_count_with_fallback(spark, sf):
    """Each page says a number of photos of its own, or is one of as many as its url has characters, or only has its items."""
    k = F.col("page_id") % 3
    photos = F.concat(F.lit("<p>"), F.format_number(1000 * F.col("page_id") + 7, 0), F.lit(" Photos</p>"))
    of = F.concat(F.lit("<b>page 2 of "), F.length("url").cast("string"), F.lit("</b>"))
    body = F.regexp_replace(x.clean(F.col("html")), r"(?i)\bof\b|photos?\b", "o")
    return frame(spark, sf, "pages").select("page_id", x.count_with_fallback(F.concat(F.when(k == 0, photos).when(k == 1, of).otherwise(""), body), "<li>").alias("n"))


@query(with_("E") + "SELECT id, slug, array_to_string(formats, ',') AS formats, views FROM E")
def a1_records_round_trip(spark, sf):
    path = scratch(spark, "records")
    e = frame(spark, sf, "E").select("id", "slug", "formats", "views")
    written = files.write_records(e, path, "json")
    return files.read_records(spark, written, e.schema, multi_line=False).select("id", "slug", F.array_join("formats", ",").alias("formats"), "views")


@query(with_("E") + "SELECT lpad(CAST(id AS VARCHAR), CAST(greatest(4, length(CAST(id AS VARCHAR))) AS INT), '0') AS key, slug, views FROM E")
def a2_keyed_round_trip(spark, sf):
    path = scratch(spark, "keyed")
    # one object for each pair of platform and kind, each in a file of its own
    entry = F.struct(F.col("id").cast("string"), F.struct("slug", "views"))
    e = frame(spark, sf, "E").groupBy("platform", "image_type").agg(F.to_json(F.map_from_entries(F.collect_list(entry))).alias("value"))
    e.write.partitionBy("platform", "image_type").text(path)
    return files.read_keyed(spark, path, "slug: string, views: double").select("key", "slug", "views")


@query(with_("E") + "SELECT id, slug, array_to_string(formats, ',') AS formats FROM E")
def a3_byte_order_mark(spark, sf):
    path = scratch(spark, "bom")
    e = frame(spark, sf, "E").groupBy("platform", "image_type").agg(F.concat(F.lit("\ufeff"), F.to_json(F.collect_list(F.struct("id", "slug", "formats")))).alias("value"))
    e.write.partitionBy("platform", "image_type").text(path)
    d = files.read_records(spark, path, "id long, slug string, formats array<string>")
    return d.select("id", "slug", F.array_join("formats", ",").alias("formats"))


@query("SELECT DISTINCT CAST(year(o_orderdate) * 100 + month(o_orderdate) AS BIGINT) AS file_id, true AS filled FROM orders")
def a5_list_files(spark, sf):
    path = scratch(spark, "listed")
    month = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("long")
    frame(spark, sf, "orders").select("o_orderkey", month.alias("month")).repartition("month").write.partitionBy("month").json(path)
    return files.list_files(spark, path, "*.json", r"month=(\d+)/[^/]*$").select("file_id", (F.col("length") > 0).alias("filled"))


@query("SELECT source, lang, lang = 'en' AS is_gif, CAST(count(*) AS BIGINT) AS rows FROM documents GROUP BY source, lang")
def d12_files(spark, sf):
    """One file for each source and language, of which those in English begin like a GIF."""
    path = scratch(spark, "magic")
    d = frame(spark, sf, "documents").groupBy("source", "lang").agg(F.count("*").cast("string").alias("n"))
    d.select(F.concat(F.when(F.col("lang") == "en", "GIF89a ").otherwise("PNG "), "n").alias("value"), "source", "lang").repartition("source", "lang").write.partitionBy("source", "lang").text(path)
    got = files.read_contents(spark, path, "*.txt", least=3)
    part = lambda c: F.url_decode(F.regexp_extract("path", f"{c}=([^/]+)/", 1))
    return got.select(part("source").alias("source"), part("lang").alias("lang"), starts_with_bytes(F.col("content")).alias("is_gif"), F.regexp_extract(F.decode("content", "UTF-8"), " ([0-9]+)", 1).cast("long").alias("rows"))


@query(with_("O") + "SELECT id, yr, platform FROM O")
def a6_first_that_exists(spark, sf):
    path = scratch(spark, "first")
    frame(spark, sf, "O").select("id", "yr", "platform").write.json(f"{path}/second")
    return files.read_first(spark, [f"{path}/none", f"{path}/second"], "id long, yr int, platform string", multi_line=False)


@query(with_("V") + "SELECT parent, idx, part, dimension AS folder FROM V")
def a4_folders_round_trip(spark, sf):
    path = scratch(spark, "folders")
    files.write_folders(frame(spark, sf, "V").select("parent", "idx", "part", "dimension"), path, "dimension")
    named = files.read_partitioned_folders(spark, path, "parent long, idx int, part long")
    return named.select("parent", "idx", "part", F.regexp_extract("folder", "=(.*)$", 1).alias("folder"))


@query(with_("O") + "SELECT id, yr, platform FROM O")
def a7_overwrite(spark, sf):
    path = scratch(spark, "overwrite")
    o = frame(spark, sf, "O").select("id", "yr", "platform")
    files.write_records(o.where("id < 0"), path, by=["yr"])
    files.write_records(o, path, by=["yr"])
    return files.read_current(spark, path, "id long, platform string, yr int").select("id", "yr", "platform")


@query(with_("O") + "SELECT 'meta' AS graph, 'n' AS node, count(*) AS n FROM O UNION ALL SELECT 'years', CAST(yr AS VARCHAR), count(*) FROM O GROUP BY yr UNION ALL SELECT 'platforms', platform, count(*) FROM O GROUP BY platform")
def a8_document(spark, sf):
    o = frame(spark, sf, "O")
    doc = files.analytics_document(o.agg(F.count("*").alias("n")), years=o.groupBy("yr").count(), platforms=o.groupBy("platform").count())
    read = F.from_json("document", "meta struct<n: long>, years array<struct<yr: int, count: long>>, platforms array<struct<platform: string, count: long>>")
    row = lambda graph, node, n: F.struct(F.lit(graph).alias("graph"), node.cast("string").alias("node"), n.alias("n"))
    d = doc.select(read.alias("d"))
    rows = F.concat(F.array(row("meta", F.lit("n"), F.col("d.meta.n"))), F.transform("d.years", lambda v: row("years", v["yr"], v["count"])), F.transform("d.platforms", lambda v: row("platforms", v["platform"], v["count"])))
    return d.select(F.explode(rows).alias("r")).select("r.*")


@query(with_("O") + "SELECT 'meta' AS graph, CAST(NULL AS BIGINT) AS id, count(*) AS n FROM O UNION ALL SELECT 'orders', id, yr FROM O")
def a8_shards(spark, sf):
    """All orders as one graph of the document, in shards, and read again."""
    path = scratch(spark, "shards")
    o = frame(spark, sf, "O")
    files.write_shards(path, o.agg(F.count("*").alias("n")), rows_per_shard=1000, orders=o.select("id", "yr"))
    meta = files.read_shards(spark, path, "meta", "n long").select(F.lit("meta").alias("graph"), F.lit(None).cast("long").alias("id"), "n")
    return meta.unionByName(files.read_shards(spark, path, "orders", "id long, yr int").select(F.lit("orders").alias("graph"), "id", F.col("yr").cast("long").alias("n")))


@query("SELECT page_id, list_extract(string_split(regexp_replace(url, '/+$', ''), '/'), -1) AS slug, length(html) AS chars FROM pages")
def a12_pages(spark, sf):
    return files.read_pages(spark, f"{sf}/pages.parquet").select("page_id", slug_from_url(F.col("url")).alias("slug"), F.length("html").cast("long").alias("chars"))
