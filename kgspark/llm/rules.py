"""Quality rules: learned decision lists over text statistics, all in DataFrame expressions.

The statistics of a text are array and string expressions. Sequential covering learns rules for the
unwanted class: a rule grows by the condition (statistic above or below a threshold) of the largest
information gain on the growing rows, and is pruned to the prefix that is most precise on the pruning
rows. Each step is one aggregate over a bounded labelled sample. The list becomes a chain of `when`s.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_labels, checkpointed, labelled_texts

SPACE = "concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))"
UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"

#: Statistics that rules may use, as SQL over the columns of `statistics`.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "bangs_per_word": "n_bangs / greatest(n_words, 1)",
    "distinct_share": "n_distinct_words / greatest(n_words, 1)",
    "n_words": "n_words",
}


def statistics(docs: DataFrame, id_col: str, text_col: str, *more: str) -> DataFrame:
    """Counts of every text: `(id_col, *more, n_words, word_chars, n_symbols, …)`, a narrow projection.

    Words are runs of other than space, tab and line ends. Repeated three-word windows are found by
    sorting the windows' hashes with their places, so a text costs n log n whatever it repeats.
    """
    d = docs.select(F.col(id_col), *more, F.coalesce(text_col, F.lit("")).alias("t_"))
    d = d.withColumn("b_", F.expr(f"trim(BOTH {SPACE} FROM t_)"))
    d = d.withColumn("w_", F.expr(r"CASE WHEN b_ = '' THEN CAST(array() AS array<string>) ELSE split(b_, '[\\x20\\x09-\\x0D]+') END"))
    d = d.withColumn("n_words", F.size("w_").cast("long"))
    d = d.withColumn("h_", F.expr("CASE WHEN n_words >= 3 THEN transform(sequence(0, CAST(n_words AS int) - 3), i -> xxhash64(w_[i], w_[i + 1], w_[i + 2])) ELSE CAST(array() AS array<bigint>) END"))
    # windows found twice or more: neighbours in the order of hashes
    d = d.withColumn("s_", F.expr("CASE WHEN size(array_distinct(h_)) < size(h_) THEN sort_array(transform(h_, (h, i) -> struct(h, i))) ELSE CAST(array() AS array<struct<h: bigint, i: int>>) END"))
    d = d.withColumn("p_", F.expr("sort_array(transform(filter(s_, (x, k) -> x.h = get(s_, k - 1).h OR x.h = get(s_, k + 1).h), x -> x.i))"))
    d = d.withColumn("n_repeat_words", F.expr("aggregate(transform(p_, (p, k) -> least(3, coalesce(get(p_, k + 1), p + 3) - p)), 0L, (a, x) -> a + x)"))
    d = d.withColumn("l_", F.expr(f"filter(split(t_, '\\n', -1), x -> length(trim(BOTH {SPACE} FROM x)) > 0)"))
    return d.select(
        id_col, *more, "n_words",
        F.expr(f"CAST(length(translate(t_, {SPACE}, '')) AS bigint)").alias("word_chars"),
        F.expr("CAST(length(t_) - length(translate(t_, '#*$%&|<>', '')) AS bigint)").alias("n_symbols"),
        F.expr("CAST(size(l_) - size(array_distinct(l_)) AS bigint)").alias("n_dup_lines"),
        "n_repeat_words",
        F.size("l_").cast("long").alias("n_lines"),
        F.expr(f"length(t_) - length(translate(t_, {UPPER}, ''))").alias("n_upper"),
        F.expr("length(t_) - length(translate(t_, '!', ''))").alias("n_bangs"),
        F.size(F.array_distinct("w_")).alias("n_distinct_words"),
    )


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def column(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value > self.threshold if self.above else value <= self.threshold

    def __str__(self) -> str:
        return f"{self.feature} {'>' if self.above else '<='} {self.threshold:g}"


def all_of(rule: list[Condition]) -> Column:
    out = F.lit(True)
    for c in rule:
        out = out & c.column()
    return out


def tightest(rule: list[Condition]) -> list[Condition]:
    """The same conjunction without conditions that another one of it implies."""
    best: dict[tuple[str, bool], Condition] = {}
    for c in rule:
        k = c.feature, c.above
        if k not in best or (c.threshold > best[k].threshold) == c.above:
            best[k] = c
    return list(best.values())


def gain(p: float, n: float, p0: float, n0: float) -> float:
    """FOIL's information gain of a condition that leaves p of p0 and n of n0 rows."""
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn(stats: DataFrame, max_rules: int = 8, max_conditions: int = 3, precision: float = 0.9, least: int = 5, cuts: int = 24) -> list[list[Condition]]:
    """Ordered rules for y = 0 from labelled statistics `(y, …)`; each rule is a conjunction.

    A hash of the id deals a third of the rows to pruning; rules grow on the others. A rule is kept while on the
    pruning rows at least `precision` of what it covers is unwanted, and it covers a third of `least` unwanted rows
    there. Of several conditions on the same side of one statistic only the tightest stays. Of conditions with equal
    gain the first in the order of the statistics and of their thresholds is taken. Without rows of both
    classes, or with too few for a rule to show its worth, the list is empty.
    """
    names = list(FEATURES)
    values = stats.select((F.col("y") == 0).cast("int").alias("bad"), "*", *[F.expr(f"CAST({FEATURES[f]} AS double)").alias(f"v{k}") for k, f in enumerate(names)])
    values = checkpointed(values.withColumn("prune", F.pmod(F.xxhash64("sample_id", F.lit(3)), F.lit(3)) == 0))
    grid = [j / (cuts + 1) for j in range(1, cuts + 1)]
    unwanted = F.when(F.col("bad") == 1, 1)
    q = values.agg(*[F.percentile_approx(f"v{k}", grid, 2000).alias(f"a{k}") for k in range(len(names))], *[F.percentile_approx(F.col(f"v{k}") * unwanted, grid, 2000).alias(f"b{k}") for k in range(len(names))]).first()
    points = [sorted({x for x in [*(q[f"a{k}"] or []), *(q[f"b{k}"] or [])] if x is not None}) for k in range(len(names))]

    def below(k: int) -> Column:
        return F.size(F.filter(F.array(*[F.lit(x) for x in points[k]]), lambda x: x < F.col(f"v{k}")))

    bins = F.array(*[F.struct(F.lit(k).alias("f"), below(k).alias("bin")) for k in range(len(names)) if points[k]])
    if not any(points):
        return []
    growing, pruning = ~F.col("prune"), F.col("prune")
    rules: list[list[Condition]] = []
    left = values
    for _ in range(max_rules):
        rule: list[Condition] = []
        now = left.where(growing)
        for _ in range(max_conditions):
            counts = now.select("bad", F.explode(bins).alias("x")).groupBy("x.f", "x.bin").agg(F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")).collect()
            by: dict[int, dict[int, tuple[int, int]]] = {}
            for r in counts:
                by.setdefault(r["f"], {})[r["bin"]] = (r["p"], r["n"])
            if not by:
                break
            p0, n0 = (sum(x[i] for x in next(iter(by.values())).values()) for i in (0, 1))
            best = (0.0, None)
            for k, table in sorted(by.items()):
                for j, x in enumerate(points[k]):
                    # value <= x: bins up to j, since a bin counts the points below the value
                    p, n = (sum(c[i] for b, c in table.items() if b <= j) for i in (0, 1))
                    for above, pp, nn in ((False, p, n), (True, p0 - p, n0 - n)):
                        g = gain(pp, nn, p0, n0) if pp >= least / 2 else 0.0
                        if g > best[0] + 1e-9:
                            best = (g, Condition(names[k], above, x))
            if best[1] is None:
                break
            rule.append(best[1])
            now = now.where(best[1].column())
            if not n0:
                break
        if not rule:
            break
        # every prefix on the pruning rows, in one aggregate
        sums = left.where(pruning).agg(*[F.sum(F.when(all_of(rule[: k + 1]), e)).alias(f"{s}{k}") for k in range(len(rule)) for s, e in (("p", F.col("bad")), ("n", 1 - F.col("bad")))]).first()
        worth = [((sums[f"p{k}"] or 0), (sums[f"n{k}"] or 0)) for k in range(len(rule))]
        score = [(p - n) / (p + n) if p + n else -1.0 for p, n in worth]
        keep = max(range(len(rule)), key=lambda k: (round(score[k], 6), worth[k][0], -k))
        p, n = worth[keep]
        if p + n and p < precision * (p + n) or 3 * p < least:
            break
        rule = tightest(rule[: keep + 1])
        rules.append(rule)
        left = left.where(~all_of(rule))
    return rules


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", train_on: Column | None = None, bound: int = 20_000) -> list[list[Condition]]:
    """Rules from at most about `bound` labelled texts, chosen by a hash of the id."""
    sample = bounded_labels(labels.where(train_on) if train_on is not None else labels, label, bound, id_col)
    return learn(statistics(labelled_texts(docs, sample, id_col, text_col), "sample_id", "text", "y"))


def verdict(rules: list[list[Condition]]) -> Column:
    """True unless a rule of the ordered list holds."""
    if not rules:
        return F.lit(True)
    out = F.when(all_of(rules[0]), F.lit(False))
    for rule in rules[1:]:
        out = out.when(all_of(rule), F.lit(False))
    return out.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: list[list[Condition]], id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, max_repeat: float = 0.5) -> DataFrame:
    """Statistics, base verdict and final verdict of every row.

    base_failed: fewer than `min_words` words, or more than `max_repeat` of them in repeated three-word
    windows. kept: not base_failed and no learned rule holds. Null and empty texts have no words and fail;
    repeated rows are judged alike; an empty table gives an empty one.
    """
    s = statistics(docs, id_col, text_col)
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > 100 * max_repeat * F.col("n_words"))
    out = s.withColumn("base_failed", failed).withColumn("kept", F.when(F.col("base_failed"), False).otherwise(verdict(rules)))
    return out.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
