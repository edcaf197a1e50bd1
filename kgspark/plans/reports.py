"""Reports on the triple table: cards, class and property pages, statistics, conformance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .triples import LABEL, SUBCLASS, TYPE


def _values(p: str):
    return F.array_sort(F.collect_set(F.when(F.col("p") == p, F.col("o"))))


def entity_cards(*encodings: DataFrame) -> DataFrame:
    """One card per subject: label (else local name), comment, and the sorted parents, domains, ranges and types. Of several encodings the first that has a subject gives its card."""
    every = None
    for k, t in enumerate(encodings):
        d = t.select("s", "p", "o", F.lit(k).alias("k"))
        every = d if every is None else every.unionByName(d)
    if len(encodings) > 1:
        first = every.groupBy("s").agg(F.min("k").alias("k"))
        every = every.join(first, ["s", "k"], "left_semi")
    one = lambda p: F.min(F.when(F.col("p") == p, F.col("o")))
    d = every.groupBy("s").agg(F.coalesce(one(LABEL), F.regexp_extract("s", r"([^#/]*)$", 1)).alias("label"), one("rdfs:comment").alias("comment"), _values(SUBCLASS).alias("parents"), _values("rdfs:domain").alias("domains"), _values("rdfs:range").alias("ranges"), _values(TYPE).alias("types"))
    return d


def graph_statistics(triples: DataFrame, class_type: str = "owl:Class", object_type: str = "owl:ObjectProperty", data_type: str = "owl:DatatypeProperty") -> DataFrame:
    """triples, and distinct subjects by kind, as one row."""
    of = lambda t: F.countDistinct(F.when((F.col("p") == TYPE) & (F.col("o") == t), F.col("s")))
    other = F.countDistinct(F.when((F.col("p") == TYPE) & ~F.col("o").isin(class_type, object_type, data_type), F.col("s")))
    return triples.agg(F.count("*").alias("triples"), of(class_type).alias("classes"), of(object_type).alias("object_properties"), of(data_type).alias("data_properties"), other.alias("individuals"))


def class_usage(triples: DataFrame, class_type: str = "owl:Class") -> DataFrame:
    """for each class how often it is used as a type, its number of sub-classes, and whether it is declared."""
    used = triples.where(F.col("p") == TYPE).groupBy(F.col("o").alias("class")).agg(F.count("*").alias("used"))
    subs = triples.where(F.col("p") == SUBCLASS).groupBy(F.col("o").alias("class")).agg(F.countDistinct("s").alias("subclasses"))
    declared = triples.where((F.col("p") == TYPE) & (F.col("o") == class_type)).select(F.col("s").alias("class"), F.lit(True).alias("declared")).distinct()
    d = used.join(subs, "class", "full").join(declared, "class", "full")
    return d.select("class", F.coalesce("used", F.lit(0)).alias("used"), F.coalesce("subclasses", F.lit(0)).alias("subclasses"), F.coalesce("declared", F.lit(False)).alias("declared"))


def listed(pairs: DataFrame, key: str, value: str, most: int, count: str, out: str) -> DataFrame:
    """`(key, count, out)`: the number of distinct values of each key, and their sorted list where there are at most `most`.

    Values are counted first; only those of keys within the bound are gathered, so no row holds more than `most`.
    """
    d = pairs.select(key, value).distinct()
    n = d.groupBy(key).agg(F.count("*").alias(count))
    few = d.join(n.where(F.col(count) <= most).select(key), key, "left_semi").groupBy(key).agg(F.array_sort(F.collect_list(value)).alias(out))
    return n.join(few, key, "left")


def class_report(triples: DataFrame, most: int = 40, longest: int = 10_000) -> DataFrame:
    """By class its individuals, parents, children, and the properties with it as domain or range: the number of each, and their list.

    Individuals are listed if there are at most `most`, the others if there are at most `longest`; else the list is null.
    """
    types = triples.where(F.col("p") == TYPE).select(F.col("o").alias("class"), "s")
    d = listed(types, "class", "s", most, "individuals", "members")
    for p, key, value, out in ((SUBCLASS, "s", "o", "parents"), (SUBCLASS, "o", "s", "children"), ("rdfs:domain", "o", "s", "domain_of"), ("rdfs:range", "o", "s", "range_of")):
        own = triples.where(F.col("p") == p).select(F.col(key).alias("class"), F.col(value).alias("v"))
        d = d.join(listed(own, "class", "v", longest, f"n_{out}", out), "class", "full")
    return d.fillna(0, ["individuals", "n_parents", "n_children", "n_domain_of", "n_range_of"])


def property_report(triples: DataFrame, longest: int = 10_000) -> DataFrame:
    """Domains and ranges by property, the number of each and their list if there are at most `longest`; properties without either have no row."""
    own = lambda p, out: listed(triples.where(F.col("p") == p).select(F.col("s").alias("property"), F.col("o").alias("v")), "property", "v", longest, f"n_{out}", out)
    d = own("rdfs:domain", "domains").join(own("rdfs:range", "ranges"), "property", "full").fillna(0, ["n_domains", "n_ranges"])
    for out in ("domains", "ranges"):
        d = d.withColumn(out, F.when(F.col(f"n_{out}") == 0, F.array().cast("array<string>")).otherwise(F.col(out)))
    return d


def observed_schema(triples: DataFrame) -> DataFrame:
    """Domain and range triples as used: the types of the subjects and of the objects of each predicate."""
    types = triples.where(F.col("p") == TYPE).select("s", F.col("o").alias("t")).distinct()
    links = triples.where(F.col("p") != TYPE)
    none = F.lit(None).cast("string")
    row = lambda d, p: d.select(F.col("p").alias("s"), F.lit(p).alias("p"), F.col("t").alias("o"), F.lit("iri").alias("o_kind"), none.alias("o_type"), none.alias("o_lang"))
    domains = links.join(types, "s").select("p", "t").distinct()
    ranges = links.where(F.col("o_kind") == "iri").join(types.select(F.col("s").alias("o"), "t"), "o").select("p", "t").distinct()
    return row(domains, "rdfs:domain").unionByName(row(ranges, "rdfs:range"))


def check_vocab(values: DataFrame, vocab: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Values not allowed, and allowed ones never seen: `(*keys, problem)`."""
    v, a = values.select(*keys).distinct(), vocab.select(*keys).distinct()
    return v.join(a, list(keys), "left_anti").withColumn("problem", F.lit("not allowed")).unionByName(a.join(v, list(keys), "left_anti").withColumn("problem", F.lit("not used")))


def check_external_ids(ids: DataFrame, label: str, external: str, form: str = r"^Q[0-9]+$") -> DataFrame:
    """External ids that are malformed, or shared by several labels: `(external, problem, n)`."""
    d = ids.where(F.col(external).isNotNull()).groupBy(F.col(external).alias("external")).agg(F.countDistinct(label).alias("n"))
    bad = d.where(~F.col("external").rlike(form)).withColumn("problem", F.lit("malformed"))
    return bad.unionByName(d.where("n > 1").withColumn("problem", F.lit("shared")))


def is_ontology(triples: DataFrame) -> DataFrame:
    """One row, whether there is an ontology header or any class or property."""
    kinds = ("owl:Ontology", "owl:Class", "owl:ObjectProperty", "owl:DatatypeProperty", "rdfs:Class", "rdf:Property")
    return triples.where((F.col("p") == TYPE) & F.col("o").isin(*kinds)).limit(1).agg((F.count("*") > 0).alias("answer"))


def leftovers(triples: DataFrame, predicates: Sequence[str]) -> DataFrame:
    """How many values of these predicates are nodes and should be literals."""
    return triples.where(F.col("p").isin(*predicates)).groupBy("p").agg(F.sum((F.col("o_kind") == "iri").cast("int")).alias("left_over"), F.count("*").alias("n"))
