"""Subgraphs: extraction by seeds, stubs, and the split of schema from data."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .triples import LABEL, TRIPLE, TYPE, Fact, add, as_set, to_triples


def typed(triples: DataFrame, *classes: str) -> DataFrame:
    """Subjects of any of the classes, `(s)`."""
    return triples.where((F.col("p") == TYPE) & F.col("o").isin(*classes)).select("s").distinct()


def seeds(triples: DataFrame, cls: str, any_of: Sequence[str]) -> DataFrame:
    """Subjects of a class that have any of several predicates."""
    has = triples.where(F.col("p").isin(*any_of)).select("s").distinct()
    return typed(triples, cls).join(has, "s", "left_semi")


def neighbours(triples: DataFrame, nodes: DataFrame, predicates: Sequence[str]) -> DataFrame:
    """Objects one link away from the nodes, `(s)`."""
    return triples.where(F.col("p").isin(*predicates) & (F.col("o_kind") == "iri")).join(nodes, "s", "left_semi").select(F.col("o").alias("s")).distinct()


def kept_vocabulary(triples: DataFrame, data_classes: Sequence[str], conditional: Sequence[str], used: DataFrame, always: Sequence[str] = ("Unknown", "Worldwide")) -> DataFrame:
    """Typed subjects without a data class; those of the conditional classes only if used or so labelled."""
    every = triples.where(F.col("p") == TYPE).select("s").distinct()
    rest = every.join(typed(triples, *data_classes), "s", "left_anti")
    bound = typed(triples, *conditional)
    named = triples.where((F.col("p") == LABEL) & F.col("o").isin(*always)).select("s").distinct()
    return rest.join(bound, "s", "left_anti").unionByName(rest.join(bound, "s", "left_semi").join(used.unionByName(named).distinct(), "s", "left_semi")).distinct()


def extract_subset(triples: DataFrame, seed: DataFrame, out: Sequence[str], into: Sequence[str], data_classes: Sequence[str], conditional: Sequence[str], schema: DataFrame | None = None) -> DataFrame:
    """K8: the seeds, what they link to by `out` predicates, what links to them by `into` predicates, and the kept vocabulary.

    All triples of these go in, but none whose object is a data individual that was not selected; then the schema.
    """
    forward = neighbours(triples, seed, out)
    back = triples.where(F.col("p").isin(*into)).join(seed.select(F.col("s").alias("o")), "o", "left_semi").select("s").distinct()
    chosen = seed.unionByName(forward).unionByName(back).unionByName(kept_vocabulary(triples, data_classes, conditional, forward)).distinct()
    data = typed(triples, *data_classes, *conditional)
    outside = data.join(chosen, "s", "left_anti").select(F.col("s").alias("o"), F.lit("iri").alias("o_kind"))
    part = triples.join(chosen, "s", "left_semi").join(outside, ["o", "o_kind"], "left_anti").select(*TRIPLE)
    return as_set(part if schema is None else part.unionByName(schema.select(*TRIPLE)))


def make_stubs(triples: DataFrame, seed: DataFrame, linked_by: str, facts: Sequence[Fact], subject: Column) -> DataFrame:
    """K9: triples for seeds without a link: `seed` has `(s, …)` with what the facts need."""
    linked = triples.where(F.col("p") == linked_by).select("s").distinct()
    return to_triples(seed.join(linked, "s", "left_anti"), subject, facts)


def annotate_untyped(triples: DataFrame, types: Sequence[str], comment: str, p: str = "rdfs:comment") -> DataFrame:
    """A default comment on subjects that have none of the types."""
    bare = triples.select("s").distinct().join(typed(triples, *types), "s", "left_anti")
    return add(triples, to_triples(bare, F.col("s"), [Fact(p, F.lit(comment), lang="en")]))


def split_schema(triples: DataFrame, individuals: DataFrame) -> DataFrame:
    """Triples whose subject and object are both no individual. `individuals` has `(s)`."""
    i = individuals.select("s").distinct()
    nodes = i.select(F.col("s").alias("o"), F.lit("iri").alias("o_kind"))
    return triples.join(i, "s", "left_anti").join(nodes, ["o", "o_kind"], "left_anti").select(*TRIPLE)
