"""The triple table: building, completing and repairing it.

Columns: s, p, o, o_kind (iri, literal, bnode), o_type, o_lang. The table is a set; a literal's identity is
its value, type and language together. Builders take `TRIPLE` columns only and give them back.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRIPLE = ("s", "p", "o", "o_kind", "o_type", "o_lang")
SCHEMA = "s string, p string, o string, o_kind string, o_type string, o_lang string"
TYPE, LABEL, SUBCLASS = "rdf:type", "rdfs:label", "rdfs:subClassOf"


@dataclass(frozen=True)
class Fact:
    """How a column becomes triples: predicate, object expression (an array gives one triple per item), kind, type and language."""

    p: str
    o: Column
    kind: str = "literal"
    type: str | None = None
    lang: str | None = None
    many: bool = False


def as_set(triples: DataFrame) -> DataFrame:
    return triples.select(*TRIPLE).dropDuplicates(list(TRIPLE))


def constant(spark_frame: DataFrame, rows: Sequence[tuple]) -> DataFrame:
    """A small frame of literal triples in the session of another frame; short rows are padded with nulls."""
    return spark_frame.sparkSession.createDataFrame([tuple(r) + (None,) * (6 - len(r)) for r in rows], SCHEMA)


def to_triples(df: DataFrame, subject: Column, facts: Sequence[Fact]) -> DataFrame:
    """K1: one triple per fact and row (or item); null and empty objects give none. One pass over the rows, no shuffle."""
    text = lambda c: c.cast("string")
    each = []
    for f in facts:
        items = F.transform(f.o, text) if f.many else F.array(text(f.o))
        items = F.filter(F.coalesce(items, F.array().cast("array<string>")), lambda o: o.isNotNull() & (F.trim(o) != ""))
        each.append(_typed(items, f))
    d = df.select(subject.alias("s"), F.explode(F.concat(*each)).alias("t"))
    return d.where("s IS NOT NULL").select("s", *[F.col(f"t.{c}").alias(c) for c in TRIPLE[1:]])


def _typed(items: Column, f: Fact) -> Column:
    return F.transform(items, lambda o: F.struct(F.lit(f.p).alias("p"), o.alias("o"), F.lit(f.kind).alias("o_kind"), F.lit(f.type).cast("string").alias("o_type"), F.lit(f.lang).cast("string").alias("o_lang")))


def link(df: DataFrame, s: Column, p: str, o: Column) -> DataFrame:
    """Triples between two nodes, one per row."""
    none = F.lit(None).cast("string")
    return df.select(s.alias("s"), F.lit(p).alias("p"), o.alias("o"), F.lit("iri").alias("o_kind"), none.alias("o_type"), none.alias("o_lang"))


def ensure_individuals(df: DataFrame, label: Column, namespace: str, classes: Sequence[str], name: Column) -> DataFrame:
    """K2: type and label triples of each distinct label; every class is given. Labels with the same local name (lower case) share one node and its least label."""
    d = df.select(label.alias("l"), F.lower(name).alias("n")).where("l IS NOT NULL AND n IS NOT NULL").groupBy("n").agg(F.min("l").alias("l"))
    facts = [Fact(LABEL, F.col("l"), lang="en"), *[Fact(TYPE, F.lit(c), "iri") for c in classes]]
    return to_triples(d, F.concat(F.lit(namespace), F.col("n")), facts)


def add_inverses(triples: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """K3: with the inverse of every link whose predicate has one; done twice it adds nothing."""
    both = {a: b for a, b in pairs} | {b: a for a, b in pairs}
    inverse = F.create_map(*[F.lit(x) for kv in both.items() for x in kv])
    none = F.lit(None).cast("string")
    turned = triples.where(F.col("p").isin(*both) & (F.col("o_kind") != "literal")).select(F.col("o").alias("s"), F.element_at(inverse, F.col("p")).alias("p"), F.col("s").alias("o"), F.lit("iri").alias("o_kind"), none.alias("o_type"), none.alias("o_lang"))
    return as_set(triples.select(*TRIPLE).unionByName(turned))


def add(triples: DataFrame, more: DataFrame) -> DataFrame:
    """Set union."""
    return as_set(triples.select(*TRIPLE).unionByName(more.select(*TRIPLE)))


def remove(triples: DataFrame, gone: DataFrame) -> DataFrame:
    """Set difference, null-safe on all columns."""
    return triples.select(*TRIPLE).subtract(gone.select(*TRIPLE))


def remove_node(triples: DataFrame, *nodes: str) -> DataFrame:
    """No triple whose subject, or object as a node, is one of these."""
    gone = F.col("s").isin(*nodes) | (F.col("o").isin(*nodes) & (F.col("o_kind") != "literal"))
    return triples.where(~gone)


def remove_predicate(triples: DataFrame, *predicates: str) -> DataFrame:
    """K12."""
    return triples.where(~F.col("p").isin(*predicates))


def move_parent(triples: DataFrame, child: str, old: str, new: str, p: str = SUBCLASS) -> DataFrame:
    """The link to the old parent goes if it is there; the link to the new one is there afterwards."""
    stays = triples.where(~((F.col("s") == child) & (F.col("p") == p) & (F.col("o") == old)))
    return add(stays, constant(triples, [(child, p, new, "iri")]))


def declare(triples: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted triples of subjects that do not occur yet are added; others are left alone."""
    fresh = wanted.join(triples.select("s").distinct(), "s", "left_anti")
    return add(triples, fresh)


def upsert_children(triples: DataFrame, children: DataFrame, child: str, parent: str, facts: Sequence[Fact], up: str, down: str) -> tuple[DataFrame, DataFrame]:
    """New children get all facts and both links, known ones only missing links; a child whose parent has no triple is reported.

    Gives the new table and the report `(n, matched, unmatched, changed)`.
    """
    known = triples.select("s").distinct()
    c = children.join(known.select(F.col("s").alias("ps_")), F.col(parent) == F.col("ps_"), "left").join(known.select(F.col("s").alias("cs_")), F.col(child) == F.col("cs_"), "left")
    ok = c.where("ps_ IS NOT NULL")
    made = to_triples(ok.where("cs_ IS NULL"), F.col(child), facts)
    links = link(ok, F.col(child), up, F.col(parent)).unionByName(link(ok, F.col(parent), down, F.col(child)))
    report = c.agg(F.count("*").alias("n"), F.count("ps_").alias("matched"), F.sum(F.col("ps_").isNull().cast("int")).alias("unmatched"), F.sum((F.col("ps_").isNotNull() & F.col("cs_").isNull()).cast("int")).alias("changed"))
    return add(triples, made.unionByName(links)), report


def set_annotations(triples: DataFrame, table: DataFrame, predicates: Sequence[str]) -> DataFrame:
    """For the subjects of `table` the triples of these predicates are those of the table, and no others."""
    subjects = table.select("s").distinct().withColumn("hit_", F.lit(True))
    old = triples.join(subjects, "s", "left").where(~(F.coalesce("hit_", F.lit(False)) & F.col("p").isin(*predicates)))
    return add(old.select(*TRIPLE), table)


def iri_to_literal(triples: DataFrame, predicates: Sequence[str], constants: Mapping[str, str] | None = None) -> DataFrame:
    """Node values of these predicates as strings; some predicates get a constant."""
    hit = F.col("p").isin(*predicates) & (F.col("o_kind") == "iri")
    value = F.col("o")
    for p, v in (constants or {}).items():
        value = F.when(F.col("p") == p, F.lit(v)).otherwise(value)
    return as_set(triples.select("s", "p", F.when(hit, value).otherwise(F.col("o")).alias("o"), F.when(hit, "literal").otherwise(F.col("o_kind")).alias("o_kind"), F.when(hit, "xsd:string").otherwise(F.col("o_type")).alias("o_type"), "o_lang"))


def class_to_individual(triples: DataFrame, classes: DataFrame, class_type: str = "owl:Class", individual_type: str = "owl:NamedIndividual") -> DataFrame:
    """For subjects `(s)` the class type becomes the individual type and subClassOf becomes type."""
    c = classes.select("s").distinct().withColumn("hit_", F.lit(True))
    d = triples.join(c, "s", "left").withColumn("hit_", F.coalesce("hit_", F.lit(False)))
    o = F.when(F.col("hit_") & (F.col("p") == TYPE) & (F.col("o") == class_type), F.lit(individual_type)).otherwise(F.col("o"))
    p = F.when(F.col("hit_") & (F.col("p") == SUBCLASS), F.lit(TYPE)).otherwise(F.col("p"))
    return as_set(d.select("s", p.alias("p"), o.alias("o"), "o_kind", "o_type", "o_lang"))


def drop_class(triples: DataFrame, *classes: str) -> DataFrame:
    """K19."""
    return remove_node(triples, *classes)


def assign_groups(triples: DataFrame, membership: DataFrame) -> DataFrame:
    """Type triples from a table `(s, group)`, for subjects that occur."""
    there = membership.join(triples.select("s").distinct(), "s", "left_semi")
    return add(triples, link(there, F.col("s"), TYPE, F.col("group")))


def ensure_linked(triples: DataFrame, subjects: DataFrame, node: Column, node_class: str, up: str, down: str, label: Column | None = None) -> DataFrame:
    """For each subject `(s)` one derived node of a class, linked both ways; done twice it adds nothing."""
    d = subjects.distinct().withColumn("node_", node)
    facts = [Fact(TYPE, F.lit(node_class), "iri"), Fact(down, F.col("s"), "iri"), *([Fact(LABEL, label, lang="en")] if label is not None else [])]
    return add(triples, to_triples(d, F.col("node_"), facts).unionByName(link(d, F.col("s"), up, F.col("node_"))))


def build_variants(variants: DataFrame, annotations: DataFrame, key: Sequence[str], subject: Column, parent: Column, dimension: str, extent: str, namespace: str = "urn:") -> DataFrame:
    """Triples of variants with their annotations; the dimension is an array and gives one link per item."""
    d = variants.join(annotations, list(key), "left")
    to = lambda kind, x: F.concat(F.lit(f"{namespace}{kind}#"), x)
    return to_triples(d, subject, [Fact(TYPE, F.lit(f"{namespace}class#Variant"), "iri"), Fact("isVariantOf", parent, "iri"), Fact("hasDimension", F.transform(dimension, lambda x: to("dimension", x)), "iri", many=True), Fact("hasExtent", to("extent", F.col(extent)), "iri")])


def build_references(df: DataFrame, subject: Column, references: str, up: str = "hasReference", down: str = "isReferencedIn", supertype: str = "urn:class#Reference", namespace: str = "urn:reference#") -> DataFrame:
    """An array of struct(individual, class, label): each individual once with its least label, its class and the supertype, linked both ways."""
    d = df.select(subject.alias("subject_"), F.explode(references).alias("r")).where("r.individual IS NOT NULL AND subject_ IS NOT NULL")
    node = F.concat(F.lit(namespace), F.col("individual"))
    one = d.groupBy(F.col("r.individual").alias("individual")).agg(F.min("r.label").alias("label"), F.collect_set("r.class").alias("classes"))
    made = to_triples(one, node, [Fact(LABEL, F.col("label"), lang="en"), Fact(TYPE, F.col("classes"), "iri", many=True), Fact(TYPE, F.lit(supertype), "iri")])
    pairs = d.select("subject_", F.col("r.individual").alias("individual")).distinct()
    return made.unionByName(link(pairs, F.col("subject_"), up, node)).unionByName(link(pairs, node, down, F.col("subject_")))


def rewrite_labels(triples: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels replaced through a table `(old, new)`."""
    m = labels.select(F.col("old").alias("old_"), F.col("new").alias("new_"))
    j = triples.join(m, (F.col("p") == LABEL) & (F.col("o") == F.col("old_")), "left")
    return j.select("s", "p", F.coalesce("new_", "o").alias("o"), "o_kind", "o_type", "o_lang")
