"""Secret scans: fixed patterns, and a battery of randomness tests on long tokens, all in SQL expressions.

For a token the encoding is inferred (hex, base32, base64). Three tests ask whether it can be random in
that alphabet: chi-squared of the signs' counts, runs above and below the middle, serial correlation.
Their squared deviates add to one score; random strings score low. How often natural text of the same
length scores as low is measured on stretches of the documents themselves (all their words, run together),
which gives each token a p-value within its length class; Benjamini and Hochberg's procedure over all
tokens sets the score up to which a length class is flagged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns and their order.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
TOKEN = r"[A-Za-z0-9+/_=-]{20,}+"  # whole tokens
KINDS = ("assign", "access", "hex", "random")
ALPHABETS = {"hex": "0123456789abcdef", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"}

LENGTHS = (20, 26, 34, 46, 64)  #: lower ends of the length classes
STEP = 0.25  #: width of a score bin
TOP = 240  #: last score bin, of all scores from 60 on; three squared normal deviates add to so much once in 10^12


def blocks(values: Column, n: int = 64) -> Column:
    """An array as an array of arrays of at most `n` items."""
    return F.when(F.size(values) > 0, F.transform(F.sequence(F.lit(1), F.size(values), F.lit(n)), lambda i: F.slice(values, i, n))).otherwise(F.array())


def running(values: Column, start: Column, step, depth: int = 3) -> Column:
    """For each item of an array of longs what `step` has made of `start` and all items before it; `step` is associative.

    An array that grows item by item is copied each time. So only blocks of 64 are walked in this way, and the blocks'
    own results, in `depth` levels: the work follows the array's length up to 64^3 blocks.
    """

    def walk(items: Column, first: Column) -> Column:
        zero = F.struct(first.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(items, zero, lambda s, x: F.struct(step(s["at"], x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")), lambda s: s["out"])

    if depth == 0:
        return walk(values, start)

    def over(parts: Column) -> Column:
        wholes = F.transform(parts, lambda p: F.aggregate(F.slice(p, 2, 64), F.element_at(p, 1), step))
        return let(wholes, lambda w: F.flatten(F.zip_with(parts, running(w, start, step, depth - 1), walk)))

    return F.when(F.size(values) <= 64, walk(values, start)).otherwise(let(blocks(values), over))


def spans(text: Column, pattern: str, kind: int) -> Column:
    """Array of struct(start, kind, end, match) of all matches, leftmost and apart.

    The places follow from the pieces between the matches: a match starts after all pieces and matches
    before it.
    """
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.arrays_zip(F.split(text, pattern, -1).alias("piece"), hits.alias("hit")), lambda x: x["hit"].isNotNull())

    def placed(p: Column) -> Column:
        before = running(F.transform(p, lambda x: (F.length(x["piece"]) + F.length(x["hit"])).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b)
        start = lambda x, a: (a + F.length(x["piece"])).cast("int")
        return F.zip_with(p, before, lambda x, a: F.struct(start(x, a).alias("start"), F.lit(kind).alias("kind"), (start(x, a) + F.length(x["hit"])).alias("end"), x["hit"].alias("hit")))

    none = F.expr("CAST(array() AS array<struct<start: int, kind: int, end: int, hit: string>>)")
    return F.when(text.rlike(pattern), let(pairs, placed)).otherwise(none)


def outside(candidates: Column, base: Column) -> Column:
    """The candidate spans that no base span holds; one ordering of both and a running maximum of the base spans' ends."""
    place = lambda s, end, k: F.struct(s["start"].alias("start"), F.lit(k).alias("mine"), end.alias("end"), s.alias("span"))
    both = F.array_sort(F.concat(F.transform(base, lambda s: place(s, s["end"], 0)), F.transform(candidates, lambda s: place(s, F.lit(0), 1))))
    ends = lambda b: running(F.transform(b, lambda x: x["end"].cast("long")), F.lit(0).cast("long"), lambda a, b: F.greatest(a, b))
    free = lambda b: F.filter(F.zip_with(b, ends(b), lambda x, e: F.struct(x["mine"].alias("mine"), x["span"].alias("span"), e.alias("end"))), lambda x: (x["mine"] == 1) & (x["end"] < x["span"]["end"]))
    return F.when((F.size(base) == 0) | (F.size(candidates) == 0), candidates).otherwise(F.transform(let(both, free), lambda x: x["span"]))


def encoding(token: Column) -> Column:
    bare = F.regexp_replace(token, "=+$", "")
    return F.when(bare.rlike("^([0-9a-f]+|[0-9A-F]+)$"), "hex").when(bare.rlike("^[A-Z2-7]+$"), "base32").otherwise("base64")


def let(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often it is used."""
    return F.element_at(F.transform(F.array(value), body), 1)


def by_encoding(kind: Column, value) -> Column:
    return F.when(kind == "hex", value("hex")).when(kind == "base32", value("base32")).otherwise(value("base64"))


def score_bin(token: Column) -> Column:
    """Bin of the token's score: squared deviates of the three tests, added. A chi-squared deviate that fills the last bin alone ends it."""

    def halves(v: Column, kind: str) -> Column:
        signs = ALPHABETS[kind]
        return F.translate(v["x"], signs + "=", "0" * (len(signs) // 2) + "1" * (len(signs) // 2) + "0")

    def counted(v: Column) -> Column:
        n, k = F.length(v["x"]).cast("double"), v["k"]
        same = F.aggregate(F.array_distinct(v["signs"]), F.lit(0.0), lambda s, c: s + F.pow(n - F.length(F.replace(v["x"], c, F.lit(""))), F.lit(2.0)))
        chi = F.greatest((k / n * same - n - (k - 1)) / F.sqrt(2 * (k - 1)), F.lit(0.0))
        return F.struct(n.alias("n"), F.pow(chi, F.lit(2.0)).alias("chi"), v["x"].alias("x"), v["kind"].alias("kind"), v["signs"].alias("signs"))

    def summed(v: Column) -> Column:
        codes = F.transform(v["signs"], lambda c: by_encoding(v["kind"], lambda k: F.instr(F.lit(ALPHABETS[k]), c)).cast("double"))
        bits = by_encoding(v["kind"], lambda k: halves(v, k))
        return F.struct(v["n"].alias("n"), v["chi"].alias("chi"), codes.alias("c"), bits.alias("bits"))

    def total(v: Column) -> Column:
        n, c, plus = v["n"], v["c"], lambda s, x: s + x
        of = lambda pattern: (n - F.length(F.replace(v["bits"], F.lit(pattern), F.lit("")))) / len(pattern)
        up, runs = of("1"), 1 + of("01") + of("10")
        both = 2 * up * (n - up)
        spread = both * (both - n) / (n * n * (n - 1))
        z_runs = F.when(spread > 0, (runs - both / n - 1) / F.sqrt(spread)).otherwise(F.sqrt(n))
        mean = F.aggregate(c, F.lit(0.0), plus) / n
        square = F.aggregate(c, F.lit(0.0), lambda s, x: s + x * x) - n * mean * mean
        ends = F.element_at(c, 1) + F.element_at(c, -1)
        product = F.aggregate(F.zip_with(c, F.slice(c, 2, F.size(c)), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
        z_serial = F.when(square > 1e-9, (product - mean * (2 * n * mean - ends) + (n - 1) * mean * mean) / square * F.sqrt(n)).otherwise(F.sqrt(n))
        return v["chi"] + F.pow(z_runs, F.lit(2.0)) + F.pow(z_serial, F.lit(2.0))

    bare = F.regexp_replace(F.translate(token, "_-", "/+"), "=+$", "")
    known = let(
        F.struct(encoding(token).alias("kind"), bare.alias("bare")),
        lambda v: let(
            F.when(v["kind"] == "hex", F.lower(v["bare"])).otherwise(v["bare"]),
            lambda x: F.struct(v["kind"].alias("kind"), x.alias("x"), by_encoding(v["kind"], lambda k: F.lit(float(len(ALPHABETS[k])))).alias("k"), F.split(x, "").alias("signs")),
        ),
    )
    score = let(let(known, counted), lambda v: F.when(v["chi"] >= TOP * STEP, TOP * STEP).otherwise(let(summed(v), total)))
    # a token of signs outside the alphabet only (such as a rule of equals signs) is not random
    return F.when(F.length(bare) >= 8, F.least(F.floor(score / STEP), F.lit(TOP)).cast("int")).otherwise(TOP)


def length_class(size: Column) -> Column:
    out = F.lit(0)
    for k, low in enumerate(LENGTHS):
        out = F.when(size >= low, k).otherwise(out)
    return out


def natural(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`(token)`: the letters of every whole text without its long tokens, cut into stretches one after another, of each length class in turn.

    The last letters of a text, too few for the next stretch, are no stretch: at most that many of a text are not counted.
    """
    sizes = [low + 2 for low in LENGTHS]
    letters = F.regexp_replace(F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), TOKEN, ""), "[^A-Za-z]+", "")
    # first into pieces that hold one stretch of each length, since places inside a long string are found by walking it
    piece = docs.select(F.explode(F.regexp_extract_all(letters, F.lit(f".{{1,{sum(sizes)}}}"), F.lit(0))).alias("piece"))
    cut = F.array(*[F.struct(F.substring("piece", 1 + sum(sizes[:k]), n).alias("token"), F.lit(n).alias("n")) for k, n in enumerate(sizes)])
    return piece.select(F.explode(F.filter(cut, lambda x: F.length(x["token"]) == x["n"])).alias("x")).select("x.token")


def token_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """`(length_class, score_bin, tokens, natural)`: counts of tokens and of natural stretches, combined before the shuffle."""
    found = docs.select(F.explode(F.regexp_extract_all(F.coalesce(F.col(text_col), F.lit("")), F.lit(TOKEN), F.lit(0))).alias("token"), F.lit(0).alias("natural"))
    rated = found.unionByName(natural(docs, text_col).withColumn("natural", F.lit(1)))
    rated = rated.select("natural", length_class(F.length("token")).alias("length_class"), score_bin(F.col("token")).alias("score_bin"))
    return rated.groupBy("length_class", "score_bin").agg(F.sum(1 - F.col("natural")).alias("tokens"), F.sum("natural").alias("natural"))


def fit(docs: DataFrame, text_col: str = "text", q: float = 0.05) -> list[int]:
    """For each length class the highest score bin that is flagged (-1: none), at false-discovery rate `q`.

    The counts have at most 5 * 241 rows whatever the input's size. Tokens of the last bin are never flagged.
    """
    rows = token_counts(docs, text_col).collect()
    natural = [[0] * (TOP + 1) for _ in LENGTHS]
    tokens = [[0] * (TOP + 1) for _ in LENGTHS]
    for r in rows:
        natural[r["length_class"]][r["score_bin"]] = r["natural"]
        tokens[r["length_class"]][r["score_bin"]] = r["tokens"]
    p = []  # (p-value, length class, bin, tokens)
    for k in range(len(LENGTHS)):
        seen, every = 0, sum(natural[k])
        for b in range(TOP):
            seen += natural[k][b]
            if tokens[k][b]:
                p.append(((1 + seen) / (1 + every), k, b, tokens[k][b]))
    p.sort()
    total, rank, cut = sum(map(sum, tokens)), 0, 0.0
    for value, _, _, n in p:
        rank += n
        if value <= q * rank / total:
            cut = value
    return [max([b for value, c, b, _ in p if c == k and value <= cut], default=-1) for k in range(len(LENGTHS))]


def scan(docs: DataFrame, limits: list[int], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`(id_col, n_assign, n_access, n_hex, base, spans)` for every row of `docs`, a narrow projection.

    `base` and `spans` list kind:start:end (code points, end exclusive) by start, then kind; spans adds
    `random` for flagged tokens that lie in no base span. Null and empty texts have none; repeated rows
    are treated alike; an empty table gives an empty one.
    """
    t = F.col("t_")
    d = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("t_"))
    assign = F.filter(spans(t, ASSIGN, 0), lambda s: F.length(F.regexp_extract(s["hit"], ASSIGN, 2)) >= 6)
    d = d.withColumn("b_", F.array_sort(F.concat(assign, spans(t, ACCESS, 1), spans(t, HEX, 2))))
    d = d.withColumn("c_", outside(spans(t, TOKEN, 3), F.col("b_")))
    d = d.select(id_col, "b_", F.when(F.size("c_") > 0, flagged(F.col("c_"), limits)).otherwise(F.filter("c_", lambda c: F.lit(False))).alias("f_"))
    count = lambda k: F.size(F.filter("b_", lambda s: s["kind"] == k)).cast("long")
    return d.select(id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), joined(F.col("b_")).alias("base"), joined(F.array_sort(F.concat("b_", "f_"))).alias("spans"))


def joined(s: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(s, lambda x: F.concat_ws(":", F.element_at(names, x["kind"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def flagged(candidates: Column, limits: list[int]) -> Column:
    """Of an array of token spans those whose score bin is within the limit of their length class."""
    limit = F.array(*[F.lit(x) for x in limits])
    return F.filter(candidates, lambda c: score_bin(c["hit"]) <= F.element_at(limit, length_class(F.length(c["hit"])) + 1))
