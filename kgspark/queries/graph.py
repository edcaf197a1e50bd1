"""Queries of the graph operators (K), their named patterns, and the triple sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..adapters import catalogued, frame, triples, with_
from ..functions.scalars import local_name_for
from ..plans import match as m
from ..plans import reports as r
from ..plans import subset as sub
from ..plans import triples as t
from ..plans.triples import Fact
from ..sources import files

QUERIES: dict = {}
SQL: dict[str, str] = {}
CONCEPT, REGION, VARIANT = "urn:class#Concept", "urn:class#Region", "urn:class#Variant"
LN = "regexp_extract({}, '([^#/]*)$', 1)"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def one(p: str, o: str | None = None) -> str:
    """SQL of one pattern's solutions."""
    return f"(SELECT s, o FROM T WHERE p = '{p}'" + (f" AND o = '{o}')" if o else ")")


# ---- named patterns


@query(with_("T") + f"SELECT {LN.format('f.o')} AS format, count(DISTINCT t.s) AS n FROM {one('rdf:type', CONCEPT)} t JOIN {one('hasFormat')} f ON f.s = t.s GROUP BY 1 ORDER BY n DESC, 1")
def k4_count_format(spark, sf):
    d = m.match(triples(spark, sf), [("?c", "rdf:type", CONCEPT), ("?c", "hasFormat", "?f")], bind={"?format": "?f"})
    return m.count_distinct(d, ["format"], "c").orderBy(F.desc("n"), "format")


@query(with_("T") + f"SELECT {LN.format('f.o')} AS period, count(DISTINCT t.s) AS n FROM {one('rdf:type', VARIANT)} t JOIN {one('hasDimension')} f ON f.s = t.s GROUP BY 1 ORDER BY 1")
def k4_count_period(spark, sf):
    d = m.match(triples(spark, sf), [("?v", "rdf:type", VARIANT), ("?v", "hasDimension", "?d")], bind={"?period": "?d"})
    return m.count_distinct(d, ["period"], "v").orderBy("period")


@query(with_("T") + f"SELECT l.o AS label, {LN.format('r.o')} AS region FROM {one('rdf:type', CONCEPT)} t JOIN {one('rdfs:label')} l ON l.s = t.s JOIN {one('hasFormat', 'urn:format#BUILDING')} f ON f.s = t.s JOIN {one('hasRegion')} r ON r.s = t.s ORDER BY 1, 2 LIMIT 100")
def k4_animated(spark, sf):
    d = m.match(triples(spark, sf), [("?c", "rdf:type", CONCEPT), ("?c", "rdfs:label", "?label"), ("?c", "hasFormat", "urn:format#BUILDING"), ("?c", "hasRegion", "?r")], bind={"?region": "?r"})
    return d.select("label", "region").orderBy("label", "region").limit(100)


@query(with_("T") + f"SELECT l.o AS label, CAST(f.o AS BIGINT) AS score FROM {one('rdf:type', CONCEPT)} t JOIN {one('rdfs:label')} l ON l.s = t.s JOIN {one('score')} f ON f.s = t.s ORDER BY 2 DESC, 1 LIMIT 25")
def k4_public_figures(spark, sf):
    d = m.match(triples(spark, sf), [("?c", "rdf:type", CONCEPT), ("?c", "rdfs:label", "?label"), ("?c", "score", "?score")])
    return d.select("label", F.col("score").cast("long").alias("score")).orderBy(F.desc("score"), "label").limit(25)


@query(with_("T") + f"SELECT l.o AS label, {LN.format('e.o')} AS extent, {LN.format('d.o')} AS dimension FROM {one('rdf:type', VARIANT)} t JOIN {one('isVariantOf')} v ON v.s = t.s JOIN {one('rdfs:label')} l ON l.s = v.o JOIN {one('hasExtent')} e ON e.s = t.s JOIN {one('hasDimension', 'urn:dimension#1-URGENT')} d ON d.s = t.s ORDER BY 1, 2, 3 LIMIT 50")
def k4_twitter(spark, sf):
    d = m.match(triples(spark, sf), [("?v", "rdf:type", VARIANT), ("?v", "isVariantOf", "?c"), ("?c", "rdfs:label", "?label"), ("?v", "hasExtent", "?e"), ("?v", "hasDimension", "urn:dimension#1-URGENT"), ("?v", "hasDimension", "?d")], bind={"?extent": "?e", "?dimension": "?d"})
    return d.select("label", "extent", "dimension").orderBy("label", "extent", "dimension").limit(50)


@query(with_("T") + f"SELECT t.s AS node, l.o AS label FROM (SELECT * FROM {one('rdf:type', REGION)} UNION ALL SELECT * FROM {one('rdf:type', VARIANT)}) t LEFT JOIN {one('rdfs:label')} l ON l.s = t.s")
def k4_all_classes(spark, sf):
    d = [m.match(triples(spark, sf), [("?node", "rdf:type", c)], optional=[[("?node", "rdfs:label", "?label")]]) for c in (REGION, VARIANT)]
    return d[0].unionByName(d[1])


@query(with_("T") + f"SELECT l.o AS label, {LN.format('d.o')} AS dimension, {LN.format('r.o')} AS region FROM {one('rdf:type', VARIANT)} t JOIN {one('hasExtent', 'urn:extent#P')} e ON e.s = t.s JOIN {one('hasDimension')} d ON d.s = t.s JOIN {one('isVariantOf')} v ON v.s = t.s JOIN {one('rdfs:label')} l ON l.s = v.o JOIN {one('hasRegion')} r ON r.s = v.o ORDER BY 1, 2, 3 LIMIT 100")
def k4_no_text(spark, sf):
    d = m.match(triples(spark, sf), [("?v", "rdf:type", VARIANT), ("?v", "hasExtent", "urn:extent#P"), ("?v", "hasDimension", "?d"), ("?v", "isVariantOf", "?c"), ("?c", "rdfs:label", "?label"), ("?c", "hasRegion", "?r")], bind={"?dimension": "?d", "?region": "?r"})
    return d.select("label", "dimension", "region").orderBy("label", "dimension", "region").limit(100)


CULTURAL = with_("T") + f"SELECT l.o AS name, k.o AS region_label, {LN.format('b.o')} AS broader FROM {one('rdf:type', CONCEPT)} t JOIN {one('rdfs:label')} l ON l.s = t.s JOIN {one('hasRegion')} r ON r.s = t.s JOIN {one('rdfs:label')} k ON k.s = r.o LEFT JOIN {one('broader')} b ON b.s = r.o ORDER BY 1, 2 LIMIT 100"


def _cultural_refs(source):
    d = m.match(source, [("?c", "rdf:type", CONCEPT), ("?c", "rdfs:label", "?name"), ("?c", "hasRegion", "?r"), ("?r", "rdfs:label", "?region_label")], optional=[[("?r", "broader", "?b")]], bind={"?broader": "?b"})
    return d.select("name", "region_label", "broader").orderBy("name", "region_label").limit(100)


@query(CULTURAL)
def k4_cultural_refs(spark, sf):
    return _cultural_refs(triples(spark, sf))


@query(CULTURAL)
def k4_cultural_refs_by_cost(spark, sf):
    """The same over analysed tables: the statistics of the patterns decide the order of the joins."""
    return _cultural_refs(catalogued(spark, sf))


@query(with_("T") + f"SELECT v.s AS variant, l.o AS name, {LN.format('e.o')} AS extent FROM {one('isVariantOf')} v JOIN {one('rdfs:label')} l ON l.s = v.o JOIN {one('hasExtent')} e ON e.s = v.s")
def k4_ideas(spark, sf):
    d = m.match(triples(spark, sf), [("?variant", "isVariantOf", "?c"), ("?c", "rdfs:label", "?name"), ("?variant", "hasExtent", "?e")], bind={"?extent": "?e"})
    return d.select("variant", "name", "extent")


# each pattern is a table of its own, so that the engine knows their sizes before it orders the joins
TRANSFORMED = with_("T") + f""", ty AS MATERIALIZED {one('rdf:type', VARIANT)}, v AS MATERIALIZED {one('isVariantOf')}, l AS MATERIALIZED {one('rdfs:label')},
d AS MATERIALIZED {one('hasDimension')}, e AS MATERIALIZED {one('hasExtent')}, n AS MATERIALIZED {one('note')}
SELECT ty.s AS variant, l.o AS name, {LN.format('d.o')} AS dimension, {LN.format('e.o')} AS extent, n.o AS note
FROM ty JOIN v ON v.s = ty.s JOIN l ON l.s = v.o JOIN d ON d.s = ty.s JOIN e ON e.s = ty.s LEFT JOIN n ON n.s = ty.s"""


def _transformations(source):
    d = m.match(source, [("?variant", "rdf:type", VARIANT), ("?variant", "isVariantOf", "?c"), ("?c", "rdfs:label", "?name"), ("?variant", "hasDimension", "?d"), ("?variant", "hasExtent", "?e")], optional=[[("?variant", "note", "?note")]], bind={"?dimension": "?d", "?extent": "?e"})
    return d.select("variant", "name", "dimension", "extent", "note")


@query(TRANSFORMED)
def k4_transformations(spark, sf):
    return _transformations(triples(spark, sf))


@query(TRANSFORMED)
def k4_transformations_by_cost(spark, sf):
    """The same over analysed tables."""
    return _transformations(catalogued(spark, sf))


@query(with_("T") + f"SELECT r.s AS region, l.o AS label, b.o AS broader, count(DISTINCT c.s) AS n FROM {one('rdf:type', REGION)} r JOIN {one('rdfs:label')} l ON l.s = r.s JOIN {one('broader')} b ON b.s = r.s JOIN {one('hasRegion')} c ON c.o = r.s JOIN {one('rdf:type', CONCEPT)} t ON t.s = c.s GROUP BY 1, 2, 3 ORDER BY n DESC, 1")
def k4_regions(spark, sf):
    d = m.match(triples(spark, sf), [("?region", "rdf:type", REGION), ("?region", "rdfs:label", "?label"), ("?region", "broader", "?broader"), ("?c", "hasRegion", "?region"), ("?c", "rdf:type", CONCEPT)])
    return m.count_distinct(d, ["region", "label", "broader"], "c").orderBy(F.desc("n"), "region")


@query(with_("T") + f"SELECT r.s AS region, l.o AS label, count(DISTINCT c.s) AS n FROM {one('rdf:type', REGION)} r JOIN {one('rdfs:label')} l ON l.s = r.s JOIN {one('hasRegion')} c ON c.o = r.s GROUP BY 1, 2 ORDER BY n DESC, 1 LIMIT 20")
def k4_platform_stats(spark, sf):
    d = m.match(triples(spark, sf), [("?region", "rdf:type", REGION), ("?region", "rdfs:label", "?label"), ("?c", "hasRegion", "?region")])
    return m.count_distinct(d, ["region", "label"], "c").orderBy(F.desc("n"), "region").limit(20)


@query(with_("T") + f"SELECT l.o AS name, {LN.format('f.o')} AS format, {LN.format('e.o')} AS extent, count(DISTINCT v.s) AS n FROM {one('rdfs:label')} l JOIN {one('hasFormat')} f ON f.s = l.s JOIN {one('isVariantOf')} v ON v.o = l.s JOIN {one('hasExtent')} e ON e.s = v.s GROUP BY 1, 2, 3 ORDER BY 1, 2, 3 LIMIT 50")
def k4_color_and_animation(spark, sf):
    d = m.match(triples(spark, sf), [("?c", "rdfs:label", "?name"), ("?c", "hasFormat", "?f"), ("?v", "isVariantOf", "?c"), ("?v", "hasExtent", "?e")], bind={"?format": "?f", "?extent": "?e"})
    return m.count_distinct(d, ["name", "format", "extent"], "v").orderBy("name", "format", "extent").limit(50)


@query(with_("T") + f"SELECT {LN.format('d.o')} AS dimension, {LN.format('e.o')} AS extent, count(DISTINCT d.s) AS n FROM {one('rdf:type', VARIANT)} t JOIN {one('hasDimension')} d ON d.s = t.s JOIN {one('hasExtent')} e ON e.s = d.s GROUP BY 1, 2")
def k4_transformation_analysis(spark, sf):
    d = m.match(triples(spark, sf), [("?v", "rdf:type", VARIANT), ("?v", "hasDimension", "?d"), ("?v", "hasExtent", "?e")], bind={"?dimension": "?d", "?extent": "?e"})
    return m.count_distinct(d, ["dimension", "extent"], "v")


@query(with_("T") + f"SELECT {LN.format('o')} AS value, count(DISTINCT s) AS n FROM T WHERE p = 'hasExtent' GROUP BY 1")
def f2_count_distinct(spark, sf):
    return m.count_distinct(m.match(triples(spark, sf), [("?v", "hasExtent", "?e")], bind={"?value": "?e"}), ["value"], "v")


@query(with_("T") + f"SELECT v.s AS variant, r.o AS region FROM {one('isVariantOf')} v JOIN {one('hasRegion')} r ON r.s = v.o")
def e9_path(spark, sf):
    return m.match(triples(spark, sf), [("?variant", "isVariantOf", "?c"), ("?c", "hasRegion", "?region")]).select("variant", "region")


@query(with_("T") + f"SELECT c.s AS c, v.s AS variant, {LN.format('e.o')} AS extent FROM {one('rdf:type', CONCEPT)} c LEFT JOIN ({one('isVariantOf')} v JOIN {one('hasExtent', 'urn:extent#P')} e ON e.s = v.s) ON v.o = c.s")
def e10_optional(spark, sf):
    d = m.match(triples(spark, sf), [("?c", "rdf:type", CONCEPT)], optional=[[("?variant", "isVariantOf", "?c"), ("?variant", "hasExtent", "urn:extent#P"), ("?variant", "hasExtent", "?e")]], bind={"?extent": "?e"})
    return d.select("c", "variant", "extent")


@query(with_("T") + f"SELECT f AS format, (SELECT count(*) > 0 FROM {one('rdf:type', CONCEPT)} t JOIN {one('hasFormat')} h ON h.s = t.s WHERE h.o = 'urn:format#' || f) AS answer FROM (SELECT unnest(['BUILDING', 'NOWHERE']) AS f)")
def k6_ask(spark, sf):
    x = triples(spark, sf)
    answers = [m.ask(x, [("?c", "rdf:type", CONCEPT), ("?c", "hasFormat", f"urn:format#{f}")]).select(F.lit(f).alias("format"), "answer") for f in ("BUILDING", "NOWHERE")]
    return answers[0].unionByName(answers[1])


@query(with_("T") + "SELECT s, p, o FROM T WHERE s = 'urn:customer#5'")
def k7_describe(spark, sf):
    return m.describe(triples(spark, sf), "urn:customer#5").select("s", "p", "o")


# ---- building and completing


@query("SELECT 'urn:order#' || o_orderkey AS s, 'status' AS p, o_orderstatus AS o, 'literal' AS o_kind FROM orders WHERE o_orderstatus <> 'O' UNION ALL SELECT 'urn:order#' || o_orderkey, 'word', unnest(string_split(o_orderpriority, '-')), 'iri' FROM orders")
def k1_to_triples(spark, sf):
    o = frame(spark, sf, "orders").withColumn("st", F.when(F.col("o_orderstatus") != "O", F.col("o_orderstatus")).otherwise(" "))
    facts = [Fact("status", F.col("st")), Fact("word", F.split("o_orderpriority", "-"), "iri", many=True)]
    return t.to_triples(o, F.concat(F.lit("urn:order#"), F.col("o_orderkey").cast("string")), facts).select("s", "p", "o", "o_kind")


@query(with_("G") + ", d AS (SELECT lower(broader) AS n, min(broader) AS l FROM G GROUP BY 1) SELECT 'urn:r#' || replace(n, ' ', '_') AS s, 'rdfs:label' AS p, l AS o FROM d UNION ALL SELECT 'urn:r#' || replace(n, ' ', '_'), 'rdf:type', c FROM d, (SELECT unnest(['urn:class#A', 'urn:class#B']) AS c)")
def k2_ensure_individuals(spark, sf):
    g = frame(spark, sf, "G")
    return t.ensure_individuals(g, F.col("broader"), "urn:r#", ["urn:class#A", "urn:class#B"], local_name_for(F.col("broader"))).select("s", "p", "o")


@query(with_("T") + "SELECT s, p, o FROM T UNION SELECT o, 'isRegionOf', s FROM T WHERE p = 'hasRegion' UNION SELECT o, 'hasVariant', s FROM T WHERE p = 'isVariantOf'")
def k3_add_inverses(spark, sf):
    return t.add_inverses(triples(spark, sf), [("hasRegion", "isRegionOf"), ("hasVariant", "isVariantOf")]).select("s", "p", "o")


@query(with_("T") + "SELECT s, p, o FROM T WHERE p <> 'hasExtent' OR o = 'urn:extent#P' UNION SELECT DISTINCT s, 'seen', 'yes' FROM T WHERE p = 'score'")
def j5_add_remove(spark, sf):
    x = triples(spark, sf)
    more = x.where("p = 'score'").withColumns({"p": F.lit("seen"), "o": F.lit("yes")})
    return t.remove(t.add(t.add(x, more), more), x.where("p = 'hasExtent' AND o <> 'urn:extent#P'")).select("s", "p", "o")


# ---- subgraphs


SUBSET = with_("T") + """, seed AS (SELECT DISTINCT s FROM T WHERE p = 'hasRegion' AND o = 'urn:nation#NATION_6' AND s IN (SELECT s FROM T WHERE p = 'rdf:type' AND o = 'urn:class#Concept')),
fwd AS (SELECT DISTINCT o AS s FROM T WHERE p IN ('hasRegion') AND s IN (SELECT s FROM seed)),
back AS (SELECT DISTINCT s FROM T WHERE p = 'isVariantOf' AND o IN (SELECT s FROM seed)),
chosen AS (SELECT s FROM seed UNION SELECT s FROM fwd UNION SELECT s FROM back),
outside AS (SELECT s FROM T WHERE p = 'rdf:type' AND s NOT IN (SELECT s FROM chosen))
SELECT DISTINCT s, p, o FROM T WHERE s IN (SELECT s FROM chosen) AND NOT (o_kind = 'iri' AND o IN (SELECT s FROM outside))"""


@query(SUBSET)
def k8_extract_subset(spark, sf):
    x = triples(spark, sf)
    seed = sub.seeds(x, CONCEPT, ["hasRegion"]).join(x.where("p = 'hasRegion' AND o = 'urn:nation#NATION_6'"), "s", "left_semi")
    return sub.extract_subset(x, seed, ["hasRegion"], ["isVariantOf"], [CONCEPT, VARIANT], [REGION]).select("s", "p", "o")


@query(with_("T") + "SELECT DISTINCT s FROM T WHERE p = 'rdf:type' AND o = 'urn:class#Concept' AND s IN (SELECT s FROM T WHERE p IN ('score', 'hasRegion'))")
def e7_seeds(spark, sf):
    return sub.seeds(triples(spark, sf), CONCEPT, ["score", "hasRegion"])


@query(with_("T") + "SELECT DISTINCT s FROM T WHERE p = 'rdf:type' AND o = 'urn:class#Region' AND (s IN (SELECT o FROM T WHERE p = 'hasRegion') OR s IN (SELECT s FROM T WHERE p = 'rdfs:label' AND o IN ('Unknown', 'Worldwide'))) UNION ALL SELECT 'urn:nation#EVERYWHERE'")
def d7_vocabulary(spark, sf):
    x = triples(spark, sf)
    # two regions that nothing refers to: one goes, the other stays for its label
    more = [("urn:nation#ATLANTIS", "rdf:type", REGION, "iri"), ("urn:nation#EVERYWHERE", "rdf:type", REGION, "iri"), ("urn:nation#EVERYWHERE", "rdfs:label", "Worldwide", "literal")]
    x = x.unionByName(t.constant(x, more))
    return sub.kept_vocabulary(x, [CONCEPT, VARIANT], [REGION], x.where("p = 'hasRegion'").select(F.col("o").alias("s")))


@query("WITH bare AS (SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT -1, 'Nobody') SELECT 'urn:stub#' || c_custkey AS s, 'rdfs:label' AS p, c_name AS o FROM bare UNION ALL SELECT 'urn:stub#' || c_custkey, 'rdf:type', 'urn:class#Idea' FROM bare")
def k9_stubs(spark, sf):
    x = t.add_inverses(triples(spark, sf), [("hasVariant", "isVariantOf")])
    # one seed that no order names, beside the customers
    seed = frame(spark, sf, "customer").select("c_custkey", "c_name").unionByName(spark.createDataFrame([(-1, "Nobody")], "c_custkey long, c_name string"))
    seed = seed.select(F.concat(F.lit("urn:customer#"), F.col("c_custkey").cast("string")).alias("s"), "c_name", "c_custkey")
    facts = [Fact("rdfs:label", F.col("c_name"), lang="en"), Fact("rdf:type", F.lit("urn:class#Idea"), "iri")]
    return sub.make_stubs(x, seed, "hasVariant", facts, F.concat(F.lit("urn:stub#"), F.col("c_custkey").cast("string"))).select("s", "p", "o")


@query(with_("T") + "SELECT DISTINCT s, p, o FROM T UNION SELECT DISTINCT s, 'rdfs:comment', 'none' FROM T WHERE s NOT IN (SELECT s FROM T WHERE p = 'rdf:type' AND o IN ('urn:class#Concept', 'urn:class#Variant'))")
def k10_annotate_untyped(spark, sf):
    return sub.annotate_untyped(triples(spark, sf), [CONCEPT, VARIANT], "none").select("s", "p", "o")


@query(with_("T") + ", i AS (SELECT DISTINCT s FROM T WHERE p = 'rdf:type' AND o <> 'urn:class#Region') SELECT T.s, T.p, T.o FROM T WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.s = T.s) AND NOT EXISTS (SELECT 1 FROM i WHERE i.s = T.o)")
def k11_split_schema(spark, sf):
    x = triples(spark, sf)
    return sub.split_schema(x, sub.typed(x, CONCEPT, VARIANT)).select("s", "p", "o")


# ---- repair


@query(with_("T") + "SELECT s, p, o FROM T WHERE s <> 'urn:nation#NATION_6' AND o <> 'urn:nation#NATION_6' AND p NOT IN ('hasExtent', 'score')")
def k12_remove(spark, sf):
    return t.remove_predicate(t.remove_node(triples(spark, sf), "urn:nation#NATION_6"), "hasExtent", "score").select("s", "p", "o")


@query(with_("T") + "SELECT s, p, o FROM T WHERE NOT (p = 'broader' AND s = 'urn:nation#NATION_6' AND o = 'urn:region#EUROPE') UNION SELECT 'urn:nation#NATION_6', 'broader', 'urn:region#WEST' UNION SELECT 'urn:nation#NONE', 'broader', 'urn:region#WEST'")
def k13_move_parent(spark, sf):
    x = t.move_parent(triples(spark, sf), "urn:nation#NATION_6", "urn:region#EUROPE", "urn:region#WEST", "broader")
    return t.move_parent(x, "urn:nation#NONE", "urn:region#EUROPE", "urn:region#WEST", "broader").select("s", "p", "o")


@query(with_("T") + "SELECT DISTINCT s, p, o FROM T UNION ALL SELECT 'urn:region#' || r_name, 'rdf:type', 'urn:class#Region' FROM region")
def k14_declare(spark, sf):
    x = triples(spark, sf)
    names = frame(spark, sf, "region").select(F.concat(F.lit("urn:region#"), "r_name").alias("n"))
    wanted = t.to_triples(names, F.col("n"), [Fact("rdf:type", F.lit(REGION), "iri")]).unionByName(x.where(f"p = 'rdf:type' AND o = '{REGION}'").withColumn("o", F.lit("urn:class#Other")))
    return t.declare(x, wanted).select("s", "p", "o")


UPSERT = "SELECT DISTINCT 'urn:item#' || l_orderkey || '-' || l_linenumber AS child, 'urn:order#' || CASE WHEN l_linenumber = 7 THEN -l_orderkey ELSE l_orderkey END AS parent FROM lineitem"
UPSERTED = with_("T") + f", c AS ({UPSERT}), ok AS (SELECT * FROM c WHERE parent IN (SELECT s FROM T)) SELECT s, p, o FROM T UNION SELECT child, 'rdf:type', 'urn:class#Item' FROM ok UNION SELECT child, 'isPartOf', parent FROM ok UNION SELECT parent, 'hasPart', child FROM ok"
REPORTED = with_("T") + f", c AS ({UPSERT}), k AS (SELECT DISTINCT s FROM T) SELECT count(*) AS n, count(k.s) AS matched, count(*) - count(k.s) AS unmatched, count(k.s) AS changed FROM c LEFT JOIN k ON k.s = c.parent"


def _upsert(spark, sf, times=1):
    x = triples(spark, sf)
    li = frame(spark, sf, "lineitem")
    key = F.when(F.col("l_linenumber") == 7, -F.col("l_orderkey")).otherwise(F.col("l_orderkey")).cast("string")
    child = li.select(F.concat(F.lit("urn:item#"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("child"), F.concat(F.lit("urn:order#"), key).alias("parent")).distinct()
    for _ in range(times):
        x, report = t.upsert_children(x, child, "child", "parent", [Fact("rdf:type", F.lit("urn:class#Item"), "iri")], "isPartOf", "hasPart")
    return x, report


@query(UPSERTED)
def k15_upsert_children(spark, sf):
    return _upsert(spark, sf)[0].select("s", "p", "o")


@query(UPSERTED)
def k15_upsert_children_whole(spark, sf):
    """Upserted twice: the second time changes nothing."""
    return _upsert(spark, sf, 2)[0].select("s", "p", "o")


@query(REPORTED)
def k15_upsert_report(spark, sf):
    return _upsert(spark, sf)[1]


@query(REPORTED)
def k15_upsert_report_whole(spark, sf):
    return _upsert(spark, sf)[1]


@query(with_("T") + "SELECT s, p, o FROM T WHERE NOT (p = 'rdfs:label' AND s LIKE 'urn:nation#%') UNION SELECT 'urn:nation#' || n_name, 'rdfs:label', lower(n_name) FROM nation")
def k16_set_annotations(spark, sf):
    table = t.to_triples(frame(spark, sf, "nation"), F.concat(F.lit("urn:nation#"), "n_name"), [Fact("rdfs:label", F.lower("n_name"), lang="en")])
    return t.set_annotations(triples(spark, sf), table, ["rdfs:label", "rdfs:comment"]).select("s", "p", "o")


@query(with_("T") + "SELECT DISTINCT s, p, CASE p WHEN 'hasExtent' THEN 'any' ELSE o END AS o, CASE WHEN p IN ('hasExtent', 'broader') THEN 'literal' ELSE o_kind END AS o_kind FROM T")
def k17_iri_to_literal(spark, sf):
    return t.iri_to_literal(triples(spark, sf), ["hasExtent", "broader"], {"hasExtent": "any"}).select("s", "p", "o", "o_kind")


@query(with_("T") + "SELECT DISTINCT s, CASE WHEN p = 'broader' THEN 'rdf:type' ELSE p END AS p, CASE WHEN p = 'rdf:type' AND o = 'urn:class#Region' THEN 'owl:NamedIndividual' ELSE o END AS o FROM T")
def k18_class_to_individual(spark, sf):
    x = triples(spark, sf).withColumn("p", F.when(F.col("p") == "broader", t.SUBCLASS).otherwise(F.col("p")))
    return t.class_to_individual(x, x.where("s LIKE 'urn:nation#%'").select("s"), class_type=REGION).select("s", "p", "o")


@query(with_("T") + "SELECT s, p, o FROM T WHERE o <> 'urn:class#Region'")
def k19_drop_class(spark, sf):
    return t.drop_class(triples(spark, sf), REGION).select("s", "p", "o")


@query(with_("T") + "SELECT s, p, o FROM T UNION SELECT 'urn:nation#' || n_name, 'rdf:type', 'urn:group#' || r_name FROM nation JOIN region ON n_regionkey = r_regionkey")
def k20_assign_groups(spark, sf):
    x = triples(spark, sf)
    g = frame(spark, sf, "G").select(F.concat(F.lit("urn:nation#"), "label").alias("s"), F.concat(F.lit("urn:group#"), "broader").alias("group"))
    more = spark.createDataFrame([("urn:nation#NOWHERE", "urn:group#X")], "s string, group string")
    return t.assign_groups(x, g.unionByName(more)).select("s", "p", "o")


@query(with_("T") + ", c AS (SELECT s FROM T WHERE p = 'rdf:type' AND o = 'urn:class#Concept') SELECT s, p, o FROM T UNION SELECT s || '-idea', 'rdf:type', 'urn:class#Idea' FROM c UNION SELECT s || '-idea', 'isConceptualizedAs', s FROM c UNION SELECT s, 'conceptualizes', s || '-idea' FROM c")
def k21_ensure_ideas(spark, sf):
    x = triples(spark, sf)
    for _ in range(2):
        x = t.ensure_linked(x, sub.typed(x, CONCEPT), F.concat("s", F.lit("-idea")), "urn:class#Idea", "conceptualizes", "isConceptualizedAs")
    return x.select("s", "p", "o")


@query(with_("V") + ", u AS (SELECT parent, idx, min(dimension) AS dimension, min(extent) AS extent FROM V GROUP BY 1, 2) SELECT 'urn:v#' || parent || '-' || idx AS s, 'rdf:type' AS p, 'urn:class#Variant' AS o FROM u UNION ALL SELECT 'urn:v#' || parent || '-' || idx, 'isVariantOf', 'urn:order#' || parent FROM u UNION ALL SELECT 'urn:v#' || parent || '-' || idx, 'hasExtent', 'urn:extent#' || extent FROM u WHERE idx % 2 = 0 UNION ALL SELECT 'urn:v#' || parent || '-' || idx, 'hasDimension', 'urn:dimension#' || unnest([dimension, 'X']) FROM u WHERE idx % 2 = 0")
def k22_build_variants(spark, sf):
    v = frame(spark, sf, "V").groupBy("parent", "idx").agg(F.min("dimension").alias("dimension"), F.min("extent").alias("extent"))
    notes = v.where("idx % 2 = 0").select("parent", "idx", F.array("dimension", F.lit("X")).alias("dims"), "extent")
    name = F.concat(F.lit("urn:v#"), F.col("parent").cast("string"), F.lit("-"), F.col("idx").cast("string"))
    return t.build_variants(v.select("parent", "idx"), notes, ["parent", "idx"], name, F.concat(F.lit("urn:order#"), F.col("parent").cast("string")), "dims", "extent").select("s", "p", "o")


@query("WITH d AS (SELECT DISTINCT 'urn:conv#' || conv_id AS c, 'urn:reference#' || role AS r, role FROM conversations) SELECT DISTINCT r AS s, 'rdfs:label' AS p, role AS o FROM d UNION ALL SELECT DISTINCT r, 'rdf:type', 'urn:class#Role' FROM d UNION ALL SELECT DISTINCT r, 'rdf:type', 'urn:class#Reference' FROM d UNION ALL SELECT c, 'hasReference', r FROM d UNION ALL SELECT r, 'isReferencedIn', c FROM d")
def k23_build_references(spark, sf):
    c = frame(spark, sf, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    refs = F.transform("roles", lambda x: F.struct(x.alias("individual"), F.lit("urn:class#Role").alias("class"), x.alias("label")))
    return t.build_references(c.withColumn("refs", refs), F.concat(F.lit("urn:conv#"), F.col("conv_id").cast("string")), "refs").select("s", "p", "o")


# ---- reports


@query(with_("T") + "SELECT s, coalesce(min(o) FILTER (p = 'rdfs:label'), regexp_extract(s, '([^#/]*)$', 1)) AS label, string_agg(DISTINCT o, ',' ORDER BY o) FILTER (p = 'rdf:type') AS types FROM T GROUP BY s")
def b10_entity_cards(spark, sf):
    x = triples(spark, sf)
    second = x.where("s LIKE 'urn:nation#%'").withColumn("o", F.lit("ignored"))
    return r.entity_cards(x, second).select("s", "label", F.array_join("types", ",").alias("types"))


@query(with_("T") + "SELECT count(*) AS triples, count(DISTINCT s) FILTER (p = 'rdf:type' AND o = 'urn:class#Region') AS classes, CAST(0 AS BIGINT) AS object_properties, CAST(0 AS BIGINT) AS data_properties, count(DISTINCT s) FILTER (p = 'rdf:type' AND o <> 'urn:class#Region') AS individuals FROM T")
def f18_graph_statistics(spark, sf):
    return r.graph_statistics(triples(spark, sf), class_type=REGION)


@query(with_("T") + ", u AS (SELECT o AS class, count(*) AS used FROM T WHERE p = 'rdf:type' GROUP BY 1), b AS (SELECT o AS class, count(DISTINCT s) AS subclasses FROM T WHERE p = 'broader' GROUP BY 1) SELECT coalesce(u.class, b.class) AS class, coalesce(used, 0) AS used, coalesce(subclasses, 0) AS subclasses, false AS declared FROM u FULL JOIN b ON u.class = b.class")
def f19_class_usage(spark, sf):
    x = triples(spark, sf)
    return r.class_usage(x.withColumn("p", F.when(F.col("p") == "broader", t.SUBCLASS).otherwise(F.col("p"))))


@query(with_("T") + ", ty AS (SELECT DISTINCT o AS class, s FROM T WHERE p = 'rdf:type'), n AS (SELECT class, count(*) AS individuals, CASE WHEN count(*) <= 40 THEN string_agg(s, ',' ORDER BY s) END AS members FROM ty GROUP BY 1), ch AS (SELECT o AS class, string_agg(DISTINCT s, ',' ORDER BY s) AS children FROM T WHERE p = 'broader' GROUP BY 1), dm AS (SELECT ty.class, string_agg(DISTINCT p, ',' ORDER BY p) AS domain_of FROM T JOIN ty ON ty.s = T.s WHERE p NOT IN ('rdf:type', 'broader') GROUP BY 1) SELECT coalesce(n.class, ch.class) AS class, coalesce(individuals, 0) AS individuals, members, children, domain_of FROM n FULL JOIN ch ON n.class = ch.class LEFT JOIN dm ON dm.class = n.class")
def k24_class_report(spark, sf):
    x = triples(spark, sf)
    x = x.withColumn("p", F.when(F.col("p") == "broader", t.SUBCLASS).otherwise(F.col("p")))
    x = x.unionByName(r.observed_schema(x.where(F.col("p") != t.SUBCLASS)))
    d = r.class_report(x.where("NOT (p = 'rdfs:subClassOf' AND o LIKE 'urn:class%')")).where("individuals > 0 OR children IS NOT NULL")
    return d.select("class", "individuals", *[F.array_join(c, ",").alias(c) for c in ("members", "children", "domain_of")])


@query(with_("T") + ", ty AS (SELECT DISTINCT o AS class, s FROM T WHERE p = 'rdf:type'), dm AS (SELECT p, string_agg(DISTINCT ty.class, ',' ORDER BY ty.class) AS domains FROM T JOIN ty ON ty.s = T.s WHERE p <> 'rdf:type' GROUP BY 1), rg AS (SELECT p, string_agg(DISTINCT ty.class, ',' ORDER BY ty.class) AS ranges FROM T JOIN ty ON ty.s = T.o WHERE p <> 'rdf:type' GROUP BY 1) SELECT dm.p AS property, domains, coalesce(ranges, '') AS ranges FROM dm LEFT JOIN rg USING (p)")
def k25_property_report(spark, sf):
    return r.property_report(r.observed_schema(triples(spark, sf))).select("property", F.array_join("domains", ",").alias("domains"), F.array_join("ranges", ",").alias("ranges"))


@query("SELECT n_name AS region, 'not used' AS problem FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer) UNION ALL SELECT 'Atlantis', 'not allowed' UNION ALL SELECT 'Utopia', 'not used'")
def k26_check_vocab(spark, sf):
    n = frame(spark, sf, "nation")
    more = lambda name: spark.createDataFrame([(name,)], "region string")
    seen = frame(spark, sf, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("region"))
    return r.check_vocab(seen.unionByName(more("Atlantis")), n.select(F.col("n_name").alias("region")).unionByName(more("Utopia")), ["region"])


@query("WITH i AS (SELECT n_name AS label, CASE WHEN n_nationkey % 5 = 0 THEN 'Q ' || n_name ELSE 'Q' || n_nationkey // 2 END AS e FROM nation), g AS (SELECT e, count(DISTINCT label) AS n FROM i GROUP BY 1) SELECT e AS external, n, 'malformed' AS problem FROM g WHERE e LIKE 'Q %' UNION ALL SELECT e, n, 'shared' FROM g WHERE n > 1")
def k26_check_external_ids(spark, sf):
    k = F.col("n_nationkey")
    ids = frame(spark, sf, "nation").select(F.col("n_name").alias("label"), F.when(k % 5 == 0, F.concat(F.lit("Q "), "n_name")).otherwise(F.concat(F.lit("Q"), F.floor(k / 2).cast("string"))).alias("e"))
    return r.check_external_ids(ids, "label", "e").select("external", "problem", "n")


KINDS = "('owl:Ontology', 'owl:Class', 'owl:ObjectProperty', 'owl:DatatypeProperty', 'rdfs:Class', 'rdf:Property')"


@query(with_("T") + f"SELECT 'data' AS graph, count(*) > 0 AS answer FROM T WHERE p = 'rdf:type' AND o IN {KINDS} UNION ALL SELECT 'schema', count(*) > 0 FROM T WHERE p = 'rdf:type' AND CASE o WHEN '{REGION}' THEN 'owl:Class' ELSE o END IN {KINDS}")
def k27_is_ontology(spark, sf):
    x = triples(spark, sf)
    schema = x.withColumn("o", F.when(F.col("o") == REGION, "owl:Class").otherwise(F.col("o")))
    data = r.is_ontology(x).select(F.lit("data").alias("graph"), "answer")
    return data.unionByName(r.is_ontology(schema).select(F.lit("schema").alias("graph"), "answer"))


@query(with_("T") + "SELECT p, CAST(sum(CASE WHEN o_kind = 'iri' THEN 1 ELSE 0 END) AS BIGINT) AS left_over, count(*) AS n FROM T WHERE p IN ('broader', 'rdfs:label') GROUP BY p")
def k28_leftovers(spark, sf):
    return r.leftovers(triples(spark, sf), ["broader", "rdfs:label"])


# ---- lines and blocks


@query(with_("T") + "SELECT '<' || s || '> <' || p || '> ' || CASE WHEN o_kind = 'iri' THEN '<' || o || '>' WHEN p = 'rdfs:label' THEN '\"' || o || '\"@en' WHEN p = 'score' THEN '\"' || o || '\"^^<xsd:integer>' ELSE '\"' || o || '\"^^<xsd:string>' END || ' .' AS line FROM T")
def a9_ntriples(spark, sf):
    return triples(spark, sf).select(files.ntriples_line().alias("line"))


@query(with_("T") + "SELECT s, p, o, o_kind FROM T UNION ALL SELECT 'urn:doc#' || doc_id, 'text', text, 'literal' FROM documents")
def a11_ntriples_round_trip(spark, sf):
    none = F.lit(None).cast("string")
    texts = frame(spark, sf, "documents").select(F.concat(F.lit("urn:doc#"), F.col("doc_id").cast("string")).alias("s"), F.lit("text").alias("p"), F.col("text").alias("o"), F.lit("literal").alias("o_kind"), none.alias("o_type"), none.alias("o_lang"))
    return files.parse_ntriples(triples(spark, sf).unionByName(texts).select(files.ntriples_line().alias("value"))).select("s", "p", "o", "o_kind")


@query(with_("T") + "SELECT s, '<' || s || '> ' || string_agg(DISTINCT part, ' ; ' ORDER BY part) || ' .' AS block FROM (SELECT s, p || ' ' || CASE WHEN o_kind = 'iri' THEN '<' || o || '>' WHEN p = 'rdfs:label' THEN '\"' || o || '\"@en' WHEN p = 'score' THEN '\"' || o || '\"^^xsd:integer' ELSE '\"' || o || '\"^^xsd:string' END AS part FROM T) GROUP BY s")
def a10_turtle_blocks(spark, sf):
    return files.turtle_blocks(triples(spark, sf))


TURTLE = with_("T") + """, d AS (SELECT DISTINCT s, p || ' ' || CASE WHEN o_kind = 'iri' THEN '<' || o || '>' WHEN p = 'rdfs:label' THEN '"' || o || '"@en' WHEN p = 'score' THEN '"' || o || '"^^xsd:integer' ELSE '"' || o || '"^^xsd:string' END AS part FROM T),
k AS (SELECT s, part, row_number() OVER (ORDER BY s, part) AS place, row_number() OVER (PARTITION BY s ORDER BY part) AS k, count(*) OVER (PARTITION BY s) AS n FROM d) """


@query(TURTLE + "SELECT place, s, CASE WHEN k = 1 THEN '<' || s || '> ' ELSE '    ' END || part || CASE WHEN k = n THEN ' .' ELSE ' ;' END AS line FROM k")
def a10_turtle_lines(spark, sf):
    return files.turtle_lines(triples(spark, sf))
