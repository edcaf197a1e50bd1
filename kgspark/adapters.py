"""The library's input shapes made from the star-schema tables: entities, variants, concepts, triples.

Each adapter is one SQL text that Spark and other engines read alike; `view` returns it with the tables as
they are registered, `frame` runs it over the parquet files of a folder.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .plans.catalog import Catalogued, register
from .sources.files import write_triples
from .storage import exists, scratch, state_of

E = """SELECT p_partkey AS id, replace(p_name,' ','-') AS slug, p_name AS title, split(p_name,' ') AS formats,
       p_brand AS platform, p_type AS image_type, p_retailprice AS views FROM part"""

O = """SELECT o_orderkey AS id, o_custkey AS parent, CAST(year(o_orderdate) AS INT) AS yr,
       CASE WHEN year(o_orderdate) < 1996 THEN 'Pre1996' WHEN year(o_orderdate) <= 1997 THEN 'P1996to1997'
            WHEN year(o_orderdate) <= 1999 THEN 'P1998to1999' ELSE 'P2000toPresent' END AS period,
       o_orderpriority AS platform, o_orderstatus AS status, o_totalprice AS views FROM orders"""

V = """SELECT l_orderkey AS parent, l_linenumber AS idx, l_partkey AS part, l_returnflag AS dimension,
       l_linestatus AS extent, l_extendedprice AS price FROM lineitem"""

G = "SELECT n_nationkey AS id, n_name AS label, r_name AS broader FROM nation JOIN region ON n_regionkey = r_regionkey"

C = "SELECT c_custkey AS id, c_name AS label, c_nationkey AS region_id, c_mktsegment AS format, c_acctbal AS score FROM customer"

D = "SELECT documents.*, quality, toxic FROM documents LEFT JOIN labels ON documents.doc_id = labels.doc_id"

PIXELS = "SELECT l_orderkey AS image_id, l_partkey % 256 AS r, l_suppkey % 256 AS g, CAST(l_quantity AS INT) % 256 AS b FROM lineitem"

#: (subject, predicate, object, kind of object, tables)
FACTS = (
    ("concat('urn:customer#', c_custkey)", "rdf:type", "'urn:class#Concept'", "iri", "customer"),
    ("concat('urn:customer#', c_custkey)", "rdfs:label", "c_name", "literal", "customer"),
    ("concat('urn:customer#', c_custkey)", "hasFormat", "concat('urn:format#', c_mktsegment)", "iri", "customer"),
    ("concat('urn:customer#', c_custkey)", "hasRegion", "concat('urn:nation#', n_name)", "iri", "customer JOIN nation ON c_nationkey = n_nationkey"),
    ("concat('urn:customer#', c_custkey)", "score", "CAST(CAST(round(c_acctbal * 100) AS BIGINT) AS STRING)", "literal", "customer"),
    ("concat('urn:nation#', n_name)", "rdf:type", "'urn:class#Region'", "iri", "nation"),
    ("concat('urn:nation#', n_name)", "rdfs:label", "n_name", "literal", "nation"),
    ("concat('urn:nation#', n_name)", "broader", "concat('urn:region#', r_name)", "iri", "nation JOIN region ON n_regionkey = r_regionkey"),
    ("concat('urn:order#', o_orderkey)", "rdf:type", "'urn:class#Variant'", "iri", "orders"),
    ("concat('urn:order#', o_orderkey)", "isVariantOf", "concat('urn:customer#', o_custkey)", "iri", "orders"),
    ("concat('urn:order#', o_orderkey)", "hasExtent", "concat('urn:extent#', o_orderstatus)", "iri", "orders"),
    ("concat('urn:order#', o_orderkey)", "hasDimension", "concat('urn:dimension#', o_orderpriority)", "iri", "orders"),
    ("concat('urn:order#', o_orderkey)", "note", "concat('still open: ', o_orderpriority)", "literal", "orders WHERE o_orderstatus = 'P'"),
)
T = " UNION ALL ".join(f"SELECT {s} AS s, '{p}' AS p, {o} AS o, '{k}' AS o_kind FROM {t}" for s, p, o, k, t in FACTS)

SQL = {"E": E, "O": O, "V": V, "G": G, "C": C, "D": D, "T": T, "PIXELS": PIXELS}
TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An adapter by its letter, or a table by its name."""
    if name not in SQL:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql, used = SQL[name], {}
    for t in TABLES:
        if f" {t}" in sql:
            used[f"{t}_t"] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
    text = re.sub(r"\b(FROM|JOIN) (\w+)(?=\s|$)", lambda m: f"{m[1]} {{{m[2]}_t}} AS {m[2]}", sql)
    return spark.sql(text, **used)


_STORED: dict[tuple, str] = {}


def triples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The triple table with all its columns, stored by predicate once per application and state of its input tables, and again after `storage.forget`.

    Graph operators scan it several times; stored by predicate, each pattern reads its own partition.
    Types and languages of literals are constant here.
    """
    return spark.read.schema("s string, o string, o_kind string, o_type string, o_lang string, p string").parquet(stored_triples(spark, sf_dir)).select("s", "p", "o", "o_kind", "o_type", "o_lang")


def stored_triples(spark: SparkSession, sf_dir: str) -> str:
    """Path of the stored triple table."""
    key = (spark.sparkContext.applicationId, sf_dir, *(state_of(spark, f"{sf_dir}/{t}.parquet") for t in ("customer", "nation", "orders", "region")))
    if key not in _STORED or not exists(spark, _STORED[key]):  # `storage.forget` may have deleted it
        t = frame(spark, sf_dir, "T")
        t = t.selectExpr("s", "p", "o", "o_kind", "CASE WHEN p = 'score' THEN 'xsd:integer' WHEN o_kind = 'literal' THEN 'xsd:string' END AS o_type", "CASE WHEN p = 'rdfs:label' THEN 'en' END AS o_lang")
        path = scratch(spark, "triples")
        write_triples(t, path)
        _STORED[key] = path
    return _STORED[key]


_CATALOGUED: dict[str, Catalogued] = {}


def catalogued(spark: SparkSession, sf_dir: str) -> Catalogued:
    """The stored triple table as analysed tables by predicate, registered once for each stored table."""
    path = stored_triples(spark, sf_dir)
    if path not in _CATALOGUED:
        _CATALOGUED[path] = register(spark, path, "kgspark_" + path.rpartition("-")[2])
    return _CATALOGUED[path]


def with_(*names: str) -> str:
    """WITH clause of adapters, for a SQL twin; the triple table, which twins read many times, is made once."""
    return "WITH " + ", ".join(f"{n} AS {'MATERIALIZED ' if n == 'T' else ''}({SQL[n]})" for n in names) + " "
