"""Graph patterns on a triple table as joins: Catalyst orders and executes them.

A term that starts with `?` is a variable, others are constants. Each pattern is a filtered projection of
the table, so predicates reach the scan, and a table stored by predicate is read by partition.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import local_name

Pattern = tuple[str, str, str]


def _solutions(triples: DataFrame | Callable[[Pattern], DataFrame], pattern: Pattern) -> DataFrame:
    """Bindings of one pattern; a variable that occurs twice in it must bind alike."""
    d, names = triples(pattern) if callable(triples) else triples, {}
    for column, term in zip(("s", "p", "o"), pattern, strict=True):
        if not term.startswith("?"):
            d = d.where(F.col(column) == term)
        elif term[1:] in names:
            d = d.where(F.col(column) == F.col(names[term[1:]]))
        else:
            names[term[1:]] = column
    return d.select(*[F.col(c).alias(v) for v, c in names.items()]) if names else d.select(F.lit(1).alias("found_"))


def _join(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
    shared = [c for c in right.columns if c in left.columns]
    if shared:
        return left.join(right, shared, how)
    if how == "left":
        return left.join(right, F.lit(True), "left")
    return left.crossJoin(right)


def match(triples: DataFrame | Callable[[Pattern], DataFrame], patterns: Sequence[Pattern], optional: Sequence[Sequence[Pattern]] = (), bind: Mapping[str, str] | None = None) -> DataFrame:
    """Solutions of all patterns as rows, one column per variable; repeated solutions stay.

    Each optional block is joined from the left and leaves its variables null where it has no solution.
    `bind` adds local names: new variable -> variable of a node. Patterns are joined so that each shares a
    variable with those before it where one does. `triples` is a frame, or gives the frame for a pattern, as the
    tables of `catalog.register` do, whose statistics let Spark order the joins by their cost.
    """
    left, rest = None, list(patterns)
    while rest:
        k = next((i for i, p in enumerate(rest) if left is None or any(t.startswith("?") and t[1:] in left.columns for t in p)), 0)
        part = _solutions(triples, rest.pop(k))
        left = part if left is None else _join(left, part, "inner")
    for block in optional:
        inner = None
        for p in block:
            part = _solutions(triples, p)
            inner = part if inner is None else _join(inner, part, "inner")
        left = _join(left, inner, "left")
    for new, old in (bind or {}).items():
        left = left.withColumn(new.lstrip("?"), local_name(F.col(old.lstrip("?"))))
    return left


def count_distinct(solutions: DataFrame, by: Sequence[str], of: str, out: str = "n") -> DataFrame:
    """K5, F2: number of distinct bindings of a variable by other variables; unbound ones do not count."""
    return solutions.groupBy(*by).agg(F.countDistinct(of).alias(out))


def ask(triples: DataFrame, patterns: Sequence[Pattern]) -> DataFrame:
    """K6: one row, whether the patterns have a solution."""
    return match(triples, patterns).limit(1).agg((F.count("*") > 0).alias("answer"))


def describe(triples: DataFrame, node: str) -> DataFrame:
    """K7: all triples of a node."""
    return triples.where(F.col("s") == node)
