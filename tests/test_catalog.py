"""Patterns over analysed tables: the same solutions, and joins that start from the small patterns."""

import pytest
from pyspark.sql import functions as F

from kgspark import adapters
from kgspark.plans import catalog
from kgspark.plans import match as m
from kgspark.sources import files

SF = "/root/testdata/sf0.001"


@pytest.fixture
def tables(spark, tmp_path):
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.cbo.enabled", "spark.sql.cbo.joinReorder.enabled")}
    t = adapters.triples(spark, SF)
    odd = t.limit(1).select("s", F.lit("is part/of").alias("p"), "o", "o_kind", "o_type", "o_lang")
    files.write_triples(t.unionByName(odd), str(tmp_path / "t"))
    c = catalog.register(spark, str(tmp_path / "t"), "test_triples")
    yield c
    c.drop()
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def leaves(plan):
    """Tables of a left-deep plan, the innermost first."""
    return [x.split("[")[0].rsplit(".", 1)[1] for x in plan.splitlines() if "Relation spark_catalog" in x]


def test_rows_are_those_of_the_frame(spark, tables):
    t = adapters.triples(spark, SF)
    assert set(tables.tables) == {r.p for r in t.select("p").distinct().collect()} | {"is part/of"}
    for pattern in [("?s", "hasRegion", "?o"), ("?s", "rdf:type", "urn:class#Region"), ("?s", "?p", "urn:nation#NATION_6"), ("?s", "none", "?o")]:
        want = m.match(t, [pattern]).where("p <> 'is part/of'" if "?p" in pattern else "true")
        got = m.match(tables, [pattern]).where("p <> 'is part/of'" if "?p" in pattern else "true")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.select(*got.columns).collect()))
    assert catalog.rows_of(spark, tables.tables["hasRegion"]) == t.where("p = 'hasRegion'").count()


def test_joins_start_from_the_selective_pattern(spark, tables):
    patterns = [("?v", "isVariantOf", "?c"), ("?v", "hasDimension", "?d"), ("?c", "rdfs:label", "?name"), ("?c", "hasRegion", "urn:nation#NATION_6")]
    d = m.match(tables, patterns)
    want = m.match(adapters.triples(spark, SF), patterns)
    assert sorted(map(tuple, d.collect())) == sorted(map(tuple, want.select(*d.columns).collect()))
    order = [next(p for p, t in tables.tables.items() if t == x) for x in leaves(d._jdf.queryExecution().optimizedPlan().toString())]
    assert sorted(order) == ["hasDimension", "hasRegion", "isVariantOf", "rdfs:label"]
    assert set(order[:2]) != {"isVariantOf", "hasDimension"}, "the largest patterns are joined first"
    spark.conf.set("spark.sql.cbo.joinReorder.enabled", "false")
    as_written = m.match(tables, patterns)._jdf.queryExecution().optimizedPlan().toString()
    assert leaves(as_written)[:2] == [tables.tables["isVariantOf"], tables.tables["hasDimension"]]
