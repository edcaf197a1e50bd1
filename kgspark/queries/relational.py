"""Queries of joins (E), aggregates (F), in-group order (W), sorts and samples (H) and sets (J)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import frame, with_
from ..functions.scalars import slug_from_title
from ..operators import aggregates as a
from ..operators import joins as j
from ..operators import order as w
from ..operators import sets

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


@query(with_("O", "C") + "SELECT O.id, coalesce(x.n_name, y.n_name, 'none') AS nation FROM O LEFT JOIN C ON O.parent = C.id LEFT JOIN nation x ON x.n_nationkey = C.region_id * 2 LEFT JOIN nation y ON y.n_nationkey = C.region_id - 5")
def e1_lookup_with_fallback(spark, sf):
    o, c = frame(spark, sf, "O"), frame(spark, sf, "C").select(F.col("id").alias("cid"), "region_id")
    d = o.join(c, o["parent"] == c["cid"], "left").withColumns({"k1": F.col("region_id") * 2, "k2": F.col("region_id") - 5})
    return j.lookup_with_fallback(d, ["k1", "k2"], frame(spark, sf, "nation"), "n_nationkey", "n_name", "none", "nation").select("id", "nation")


@query("SELECT d.doc_id, coalesce(l.quality, -1) AS quality, coalesce(CAST(l.toxic AS BIGINT), n_chars) AS n_chars FROM documents d LEFT JOIN labels l USING (doc_id)")
def e2_overlay(spark, sf):
    more = frame(spark, sf, "labels").select("doc_id", "quality", F.col("toxic").cast("long").alias("n_chars"))
    return j.overlay(frame(spark, sf, "documents"), more, "doc_id", ["quality", "n_chars"]).select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), "n_chars")


@query("SELECT o.o_orderkey, CASE WHEN c.c_custkey IS NOT NULL THEN nullif(c.c_mktsegment, 'BUILDING') ELSE o.o_orderstatus END AS o_orderstatus, c.c_custkey IS NOT NULL AS patched FROM orders o LEFT JOIN customer c ON c.c_custkey = o.o_orderkey")
def e3_patch(spark, sf):
    p = frame(spark, sf, "customer").select(F.col("c_custkey").alias("o_orderkey"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("o_orderstatus"))
    return j.patch(frame(spark, sf, "orders"), p, "o_orderkey", ["o_orderstatus"]).select("o_orderkey", "o_orderstatus", "patched")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' AND o_totalprice > 100000 THEN 'X' ELSE o_orderstatus END AS o_orderstatus, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE o_orderpriority END AS o_orderpriority, CAST(o_orderstatus = 'F' AS INT) + CAST(o_orderstatus = 'F' AND o_totalprice > 100000 AS INT) AS changed FROM orders")
def e4_sync(spark, sf):
    o = frame(spark, sf, "orders")
    fresh = o.where("o_orderstatus = 'F'").select("o_orderkey", F.when(F.col("o_totalprice") > 100000, "X").otherwise(" ").alias("o_orderstatus"), F.lit("new").alias("o_orderpriority"))
    return j.sync(o, fresh, "o_orderkey", ["o_orderstatus", "o_orderpriority"]).select("o_orderkey", "o_orderstatus", "o_orderpriority", "changed")


@query(with_("E") + ", k AS (SELECT lower(replace(title, ' ', '-')) AS a, min(id) AS pid FROM E WHERE id % 2 = 0 GROUP BY 1), r AS (SELECT lower(replace(title, ' ', '')) AS b, min(id) AS pid FROM E GROUP BY 1) SELECT E.id, coalesce(k.pid, r.pid) AS parent_id FROM E LEFT JOIN k ON k.a = CASE WHEN E.id % 3 = 0 THEN replace(E.slug, '-', '') ELSE E.slug END LEFT JOIN r ON r.b = CASE WHEN E.id % 3 = 0 THEN replace(E.slug, '-', '') ELSE E.slug END")
def e5_link_parents(spark, sf):
    e = frame(spark, sf, "E")
    parents = e.select(F.col("id").alias("pid"), "title")
    child = F.when(F.col("id") % 3 == 0, F.replace("slug", F.lit("-"), F.lit(""))).otherwise(F.col("slug"))
    slug = F.when(F.col("pid") % 2 == 0, slug_from_title(F.col("title")))
    return j.link_parents(e, parents, child, [slug, F.replace(slug_from_title(F.col("title")), F.lit("-"), F.lit(""))], "pid").select("id", "parent_id")


@query(with_("E") + ", l AS (SELECT DISTINCT slug AS l FROM E), r AS (SELECT left(slug, 1) AS r FROM E UNION SELECT left(slug, 2) FROM E UNION SELECT slug || '-x' FROM E UNION SELECT slug FROM E WHERE slug < 'f' UNION SELECT '_' || slug FROM E WHERE slug > 'p') SELECT l AS slug, r AS other FROM (SELECT l, r, row_number() OVER (PARTITION BY l ORDER BY CASE WHEN l = r THEN 0 WHEN '_' || l = r THEN 1 ELSE 2 END, r) AS k FROM l JOIN r ON '_' || l = r OR starts_with(l, r) OR starts_with(r, l)) WHERE k = 1")
def e6_prefix_match(spark, sf):
    slug = F.col("slug")
    keys = [F.left(slug, F.lit(1)), F.left(slug, F.lit(2)), F.concat(slug, F.lit("-x")), F.when(slug < "f", slug), F.when(slug > "p", F.concat(F.lit("_"), slug))]
    e = frame(spark, sf, "E")
    return j.prefix_match(e, e.select(F.explode(F.array(*keys)).alias("other")), "slug", "other")


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def e7_semi(spark, sf):
    o = frame(spark, sf, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return frame(spark, sf, "customer").join(o, "c_custkey", "left_semi").select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def e8_anti(spark, sf):
    o = frame(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    return frame(spark, sf, "customer").join(o, "c_custkey", "left_anti").select("c_custkey")


@query(with_("O") + "SELECT DISTINCT id AS slug FROM O WHERE yr = 1996 AND id IN (SELECT id FROM O WHERE platform = '1-URGENT')")
def e11_intersect(spark, sf):
    o = frame(spark, sf, "O")
    index = a.inverted_index(o, "id", F.col("yr").cast("string")).unionByName(a.inverted_index(o, "id", F.col("platform"))).withColumnRenamed("id", "slug")
    return j.intersect_or_first(index, "1996", "1-URGENT")


@query(with_("O") + "SELECT id AS slug FROM O WHERE yr = 1996")
def e11_intersect_empty(spark, sf):
    index = a.inverted_index(frame(spark, sf, "O"), "id", F.col("yr").cast("string")).withColumnRenamed("id", "slug")
    return j.intersect_or_first(index, "1996", "1997")


@query(with_("O") + "SELECT p.period, q.platform, coalesce(n, 0) AS n FROM (SELECT DISTINCT period FROM O) p CROSS JOIN (SELECT DISTINCT platform FROM O UNION SELECT 'none') q LEFT JOIN (SELECT period, platform, count(*) AS n FROM O WHERE yr % 2 = 0 GROUP BY ALL) c ON c.period = p.period AND c.platform = q.platform")
def e12_densify(spark, sf):
    o = frame(spark, sf, "O")
    axis = o.select("platform").distinct().unionByName(spark.createDataFrame([("none",)], "platform string"))
    return j.densify(a.count_by(o.where("yr % 2 = 0"), "period", "platform"), {"period": o.select("period").distinct(), "platform": axis}, "n").select("period", "platform", "n")


@query(with_("C") + "SELECT C.id, coalesce('Q' || n.n_nationkey, 'urn:' || C.region_id) AS ext FROM C LEFT JOIN nation n ON n.n_nationkey = C.region_id AND n.n_name < 'NATION_2'")
def e13_external_ids(spark, sf):
    ids = frame(spark, sf, "nation").where("n_name < 'NATION_2'").select(F.col("n_nationkey").alias("label"), F.concat(F.lit("Q"), F.col("n_nationkey").cast("string")).alias("external_id"))
    return j.external_ids(frame(spark, sf, "C"), ids, "region_id", "ext", F.concat(F.lit("urn:"), F.col("region_id").cast("string"))).select("id", "ext")


@query("WITH b AS (SELECT s_nationkey AS k FROM supplier WHERE s_acctbal > 9000 UNION SELECT 99) SELECT c_nationkey AS nation, 'b' AS missing_in FROM customer WHERE c_nationkey NOT IN (SELECT k FROM b) GROUP BY 1 UNION ALL SELECT k, 'a' FROM b WHERE k NOT IN (SELECT c_nationkey FROM customer)")
def e14_coverage(spark, sf):
    b = frame(spark, sf, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("nation")).unionByName(spark.createDataFrame([(99,)], "nation int"))
    return j.coverage(frame(spark, sf, "customer").select(F.col("c_nationkey").alias("nation")), b, "nation")


@query("SELECT o_orderkey, o_orderstatus, c_name, l_linenumber, l_quantity FROM orders LEFT JOIN customer ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderkey = (SELECT max(l_orderkey) FROM lineitem)")
def e15_detail(spark, sf):
    key = frame(spark, sf, "lineitem").agg(F.max("l_orderkey").alias("o_orderkey"))
    one = frame(spark, sf, "orders").join(key, "o_orderkey")
    d = one.join(frame(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left").join(frame(spark, sf, "lineitem"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return d.select("o_orderkey", "o_orderstatus", "c_name", "l_linenumber", "l_quantity")


@query(with_("E") + "SELECT platform, count(*) AS n FROM E GROUP BY platform")
def f1_count_by(spark, sf):
    return a.count_by(frame(spark, sf, "E"), "platform")


@query(with_("E") + "SELECT format, count(*) AS n FROM (SELECT unnest(formats) AS format FROM E) GROUP BY format")
def f3_item_counts(spark, sf):
    return a.count_by(a.items_of(frame(spark, sf, "E"), "formats", "format"), "format")


@query(with_("O") + "SELECT yr, platform, count(*) AS n FROM O GROUP BY yr, platform")
def f4_matrix(spark, sf):
    return a.count_by(frame(spark, sf, "O"), "yr", "platform")


@query(with_("E") + "SELECT format, coalesce(round(avg(CASE WHEN views >= 1200 THEN views END), 4), 0) AS mean_value, count(*) AS entries, count(CASE WHEN views >= 1200 THEN views END) AS valued FROM (SELECT unnest(formats) AS format, views FROM E) GROUP BY format")
def f5_mean_of_valued(spark, sf):
    e = a.items_of(frame(spark, sf, "E").withColumn("views", F.when(F.col("views") >= 1200, F.col("views")).otherwise(-1.0)), "formats", "format", "views")
    return a.mean_of_valued(e, "format", "views").withColumn("mean_value", F.round("mean_value", 4))


@query(with_("E") + "SELECT node, string_agg(slug, ',' ORDER BY slug) AS items FROM (SELECT DISTINCT platform || '||' || image_type AS node, slug FROM E) GROUP BY node")
def f6_inverted_index(spark, sf):
    lists = a.index_lists(a.inverted_index(frame(spark, sf, "E"), "slug", F.col("platform"), F.col("image_type")), "slug")
    return lists.select("node", F.array_join("items", ",").alias("items"))


@query(with_("O") + "SELECT DISTINCT period || '||' || platform AS node, id FROM O")
def f6_inverted_index_long(spark, sf):
    return a.inverted_index(frame(spark, sf, "O"), "id", F.col("period"), F.col("platform"))


@query(with_("O") + ", t AS (SELECT platform, count(*) AS n FROM O GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3), c AS (SELECT period, coalesce(t.platform, 'Other') AS platform, count(*) AS n FROM O LEFT JOIN t USING (platform) GROUP BY ALL) SELECT *, CAST(sum(n) OVER (PARTITION BY period) AS BIGINT) AS total, round(n / sum(n) OVER (PARTITION BY period), 6) AS ratio FROM c")
def f7_top_or_other(spark, sf):
    return a.top_or_other(frame(spark, sf, "O"), "period", "platform", 3).withColumn("ratio", F.round("ratio", 6))


@query(with_("O") + ", t AS (SELECT platform FROM O GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2) SELECT yr, platform, count(*) AS n FROM O JOIN t USING (platform) GROUP BY ALL HAVING count(*) >= 2")
def f8_edges_of_top(spark, sf):
    return a.edges_of_top(frame(spark, sf, "O"), "yr", "platform", 2)


@query(with_("O") + "SELECT CAST(yr AS VARCHAR) AS id, count(*) AS n, 'year' AS grp FROM O GROUP BY yr UNION ALL (SELECT platform, count(*), 'platform' FROM O GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)")
def f9_nodes(spark, sf):
    return a.nodes(frame(spark, sf, "O"), "yr", "platform", 3, ("year", "platform"))


@query(with_("E") + ", x AS (SELECT image_type, unnest(formats) AS format FROM E WHERE image_type IN ('ECONOMY', 'STANDARD', 'SMALL')), t AS (SELECT format FROM x GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 8) SELECT image_type, format, count(*) AS n FROM x JOIN t USING (format) GROUP BY ALL")
def f10_heat_cells(spark, sf):
    x = a.items_of(frame(spark, sf, "E"), "formats", "format", "image_type")
    return a.heat_cells(x, "image_type", ["ECONOMY", "STANDARD", "SMALL"], "format", 8)


@query(with_("E") + "SELECT slug, max(id) AS id, max_by(platform, id) AS platform, max_by(image_type, id) FILTER (id % 2 = 0) AS image_type FROM E GROUP BY slug")
def f11_merge_duplicates(spark, sf):
    e = frame(spark, sf, "E").select("slug", "id", "platform", F.when(F.col("id") % 2 == 0, F.col("image_type")).otherwise(" ").alias("image_type"))
    return a.merge_duplicates(e, "slug", "id", ["image_type"])


@query(with_("O") + "SELECT min(yr) AS least, max(yr) AS greatest, count(DISTINCT platform) AS n_distinct, count(*) AS n FROM O")
def f12_span(spark, sf):
    return a.span_of(frame(spark, sf, "O"), "yr", "platform")


@query(with_("E") + "SELECT DISTINCT unnest(formats) AS item FROM E ORDER BY 1")
def f13_facets(spark, sf):
    return a.facet_values(frame(spark, sf, "E"), "formats")


@query("SELECT role, row_number() OVER (ORDER BY c, t, role) AS place FROM (SELECT role, min(conv_id) AS c, min_by(turn, conv_id * 100000 + turn) AS t FROM conversations WHERE role IS NOT NULL GROUP BY role)")
def f14_first_seen(spark, sf):
    return a.first_seen(frame(spark, sf, "conversations"), "role", ["conv_id", "turn"])


@query(with_("V") + "SELECT parent, CAST(sum(CASE WHEN dimension IS DISTINCT FROM f THEN 1 ELSE 0 END) AS BIGINT) AS n_different FROM (SELECT parent, nullif(dimension, 'A') AS dimension, first_value(nullif(dimension, 'A')) OVER (PARTITION BY parent ORDER BY idx, part) AS f FROM V) GROUP BY parent")
def f15_differs(spark, sf):
    v = frame(spark, sf, "V").withColumn("dimension", F.nullif("dimension", F.lit("A")))
    return a.differs_from_reference(v, "parent", ["idx", "part"], "dimension")


@query("SELECT conv_id, string_agg(turn || ':' || role, ',' ORDER BY turn, role) AS turns FROM conversations GROUP BY conv_id")
def f16_nest(spark, sf):
    n = a.nest(frame(spark, sf, "conversations"), "conv_id", "turn", "role", out="turns")
    return n.select("conv_id", F.array_join(F.transform("turns", lambda x: F.concat(x["turn"].cast("string"), F.lit(":"), x["role"])), ",").alias("turns"))


@query(with_("PIXELS") + "SELECT image_id, round(avg(greatest(r, g, b) - least(r, g, b)), 4) AS spread, CASE WHEN avg(greatest(r, g, b) - least(r, g, b)) > 100 THEN 'Color' ELSE 'Monochrome' END AS mode FROM PIXELS GROUP BY image_id")
def f17_color_mode(spark, sf):
    return a.color_mode(frame(spark, sf, "PIXELS"), cut=100).select("image_id", F.round("spread", 4).alias("spread"), "mode")


@query(with_("E", "O") + ", x AS (SELECT slug AS node, string_agg(DISTINCT platform, ',' ORDER BY platform) AS items FROM E GROUP BY 1), y AS (SELECT slug AS node, string_agg(DISTINCT image_type, ',' ORDER BY image_type) AS items FROM E WHERE platform = 'Brand#11' GROUP BY 1) SELECT coalesce(x.node, y.node) AS node, coalesce(y.items, x.items) AS items FROM x FULL JOIN y ON x.node = y.node")
def f20_merge_indexes(spark, sf):
    e = frame(spark, sf, "E")
    x = a.index_lists(a.inverted_index(e, "platform", F.col("slug")), "platform")
    y = a.index_lists(a.inverted_index(e.where("platform = 'Brand#11'"), "image_type", F.col("slug")), "image_type")
    return a.merge_indexes(x, y).select("node", F.array_join("items", ",").alias("items"))


@query("SELECT count(*) AS n, CAST(count(o.c) AS BIGINT) AS matched, count(*) - count(o.c) AS unmatched, CAST(sum(CASE WHEN o.n > 10 THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM customer LEFT JOIN (SELECT o_custkey AS c, count(*) AS n FROM orders GROUP BY 1) o ON o.c = c_custkey")
def f21_match_summary(spark, sf):
    n = frame(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    return a.match_summary(frame(spark, sf, "customer").join(n, "c_custkey", "left"), F.col("n").isNotNull(), F.col("n") > 10)


@query("SELECT 'open orders' AS \"check\", count(*) AS rows, CASE WHEN count(*) > 0 THEN 'pass' ELSE 'fail' END AS status FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT 'no price', count(*), CASE WHEN count(*) > 0 THEN 'fail' ELSE 'pass' END FROM orders WHERE o_totalprice IS NULL")
def f22_check_report(spark, sf):
    o = frame(spark, sf, "orders")
    return a.check_report([("open orders", o.where("o_orderstatus = 'O'"), True), ("no price", o.where("o_totalprice IS NULL"), False)])


@query(with_("V") + "SELECT parent, idx, part, row_number() OVER (PARTITION BY parent ORDER BY idx, part, price) AS new_idx FROM V WHERE dimension <> 'A'")
def w1_reindex(spark, sf):
    return w.reindex(frame(spark, sf, "V").where("dimension <> 'A'"), "parent", ["idx", "part", "price"]).select("parent", "idx", "part", F.col("new_idx").cast("long").alias("new_idx"))


@query(with_("V") + "SELECT parent, idx, part, row_number() OVER (PARTITION BY parent ORDER BY idx, part, price) AS new_idx FROM V WHERE dimension <> 'A'")
def w1_reindex_wide(spark, sf):
    return w.reindex_wide(frame(spark, sf, "V").where("dimension <> 'A'"), "parent", ["idx", "part", "price"]).select("parent", "idx", "part", F.col("new_idx").cast("long").alias("new_idx"))


@query(with_("V") + "SELECT parent, idx, part, row_number() OVER (PARTITION BY parent ORDER BY CASE dimension WHEN 'R' THEN 1 WHEN 'N' THEN 2 ELSE 0 END, idx, part, price) AS place FROM V")
def w2_ordinal(spark, sf):
    return w.reindex(frame(spark, sf, "V"), "parent", [w.ordinal(F.col("dimension"), ["R", "N"]), "idx", "part", "price"], "place").select("parent", "idx", "part", F.col("place").cast("long").alias("place"))


@query("SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(nullif(trim(text), ''), CAST(doc_id AS VARCHAR)) ORDER BY doc_id) AS k FROM documents) WHERE k = 1")
def w3_keep_first(spark, sf):
    return w.keep_first(frame(spark, sf, "documents"), [F.col("text"), F.col("doc_id")], ["doc_id"]).select("doc_id", "source")


@query(with_("O") + "SELECT period, platform, n, CAST(sum(n) OVER q AS BIGINT) AS stack_end, CAST(sum(n) OVER q - n AS BIGINT) AS stack_start FROM (SELECT period, platform, count(*) AS n FROM O GROUP BY ALL) WINDOW q AS (PARTITION BY period ORDER BY n DESC, platform ROWS UNBOUNDED PRECEDING)")
def w4_running_stack(spark, sf):
    return w.running_stack(a.count_by(frame(spark, sf, "O"), "period", "platform"), "period", "n", "platform")


@query(with_("E") + "SELECT id, CASE WHEN views IS NULL THEN 4 WHEN r <= 200 THEN 1 WHEN r <= 700 THEN 2 ELSE 3 END AS tier FROM (SELECT id, views, row_number() OVER (ORDER BY views DESC NULLS LAST, id) AS r FROM (SELECT id, CASE WHEN id % 11 <> 0 THEN views END AS views FROM E))")
def w5_tiers(spark, sf):
    return w.tiers(frame(spark, sf, "E").withColumn("views", F.when(F.col("id") % 11 != 0, F.col("views"))), "views", "id").select("id", "tier")


@query(with_("O") + "SELECT id, row_number() OVER (ORDER BY views DESC, id) AS rank FROM O")
def w5_ranked(spark, sf):
    return w.ranked(frame(spark, sf, "O"), "views", "id").select("id", "rank")


@query(with_("O") + ", b AS (SELECT yr, CAST(coalesce(sum(wd) OVER (ORDER BY yr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS base FROM (SELECT yr, ceil(count(*) / 25.0) AS wd FROM O GROUP BY yr)) SELECT id, CAST(base + floor(i / 25) AS BIGINT) AS grid_col, CAST(i % 25 AS INT) AS grid_row FROM (SELECT id, yr, row_number() OVER (PARTITION BY yr ORDER BY views, id) - 1 AS i FROM O) JOIN b USING (yr)")
def w6_grid(spark, sf):
    return w.grid(frame(spark, sf, "O"), "yr", ["views", "id"], 25).select("id", "grid_col", "grid_row")


@query(with_("O") + "SELECT period, platform, round(count(*) / sum(count(*)) OVER (PARTITION BY period), 6) AS ratio FROM O GROUP BY period, platform")
def w7_ratio(spark, sf):
    return a.top_or_other(frame(spark, sf, "O"), "period", "platform", 100).select("period", "platform", F.round("ratio", 6).alias("ratio"))


@query(with_("O") + "SELECT id, yr, views FROM O ORDER BY yr DESC, views, id LIMIT 100")
def h1_h2_first_n(spark, sf):
    return w.first_n(frame(spark, sf, "O"), [F.desc("yr"), "views", "id"], 100).select("id", "yr", "views")


@query(with_("E") + "SELECT slug, count(*) AS n FROM E GROUP BY slug ORDER BY n DESC, slug LIMIT 14")
def h3_top(spark, sf):
    return a.top(frame(spark, sf, "E"), "slug", 14)


@query(with_("E") + "SELECT id, slug FROM E ORDER BY slug, id LIMIT 60 OFFSET 120")
def h4_page(spark, sf):
    return w.page(frame(spark, sf, "E"), ["slug", "id"], 3).select("id", "slug")


@query(with_("E") + "SELECT count(*) AS n, CAST(ceil(count(*) / 60.0) AS BIGINT) AS pages FROM E")
def h4_page_count(spark, sf):
    return w.page_count(frame(spark, sf, "E"))


@query(with_("E") + "SELECT slug FROM (SELECT DISTINCT slug FROM E) ORDER BY md5('5:' || slug), slug LIMIT 30")
def h5_sample(spark, sf):
    return w.sample(frame(spark, sf, "E"), "slug", 30, 5).select("slug")


@query(with_("V") + "SELECT dimension, part FROM (SELECT DISTINCT dimension, part FROM V) QUALIFY row_number() OVER (PARTITION BY dimension ORDER BY md5('5:' || part), part) <= 20")
def h6_sample_per_group(spark, sf):
    return w.sample_per_group(frame(spark, sf, "V"), "dimension", "part", 20, 5).select("dimension", "part")


@query(with_("O") + "SELECT id FROM (SELECT DISTINCT id FROM O) ORDER BY md5('7:' || id), id LIMIT 200")
def h7_shuffled(spark, sf):
    return w.sample(frame(spark, sf, "O"), "id", 200, 7).select("id")


@query(with_("V") + "SELECT parent, idx, part FROM V ORDER BY parent, idx, part LIMIT 50")
def h8_first_n(spark, sf):
    return w.first_n(frame(spark, sf, "V"), ["parent", "idx", "part"], 50).select("parent", "idx", "part")


@query("SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders")
def j1_union_distinct(spark, sf):
    return sets.union_distinct(frame(spark, sf, "customer").select(F.col("c_custkey").alias("k")), frame(spark, sf, "orders").select(F.col("o_custkey").alias("k")))


@query(with_("E", "V") + "SELECT id AS k, slug AS name, 'entity' AS kind FROM E UNION ALL SELECT parent, dimension, 'variant' FROM V")
def j2_union_tagged(spark, sf):
    e = frame(spark, sf, "E").selectExpr("id AS k", "slug AS name")
    v = frame(spark, sf, "V").selectExpr("parent AS k", "dimension AS name")
    return sets.union_tagged(entity=e, variant=v)


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT'")
def j3_difference(spark, sf):
    return sets.difference(frame(spark, sf, "customer").select(F.col("c_custkey").alias("k")), frame(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("k")))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def j4_intersection(spark, sf):
    return sets.intersection(frame(spark, sf, "customer").select(F.col("c_nationkey").alias("k")), frame(spark, sf, "supplier").select(F.col("s_nationkey").alias("k")))
