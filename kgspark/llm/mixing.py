"""Mixing sources to target weights by systematic sampling.

A source's words are to be taken r = target / size of the source times. Its documents stand in order of size (then of a
hash of the id), their expected copies are summed along that order, one random offset per source is added, and a
document is taken once for each integer boundary that its stretch crosses.

The largest documents, of which a single one may be a tenth of its source, expect whole numbers of copies: from the
largest down, what r times the words so far lack, in units of the document, is rounded down after the offset is added.
What they leave open, less than the last of them, is shared by all others, whose expected copies are equal; a prefix sum
of those is rank times copies. Their order by size spreads the boundaries over all sizes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators.order import numbered
from .common import WORD, stored

CAP = 3  #: most copies of a source's words
LARGEST = 256  #: documents of a source that expect whole numbers of copies


def targets(sizes: DataFrame, weight_of_rank: Column | None = None, cap: int = CAP) -> DataFrame:
    """Adds `target` to a table of sources `(source, source_size)`, one row each.

    Sources by code point, null last, weigh 1, 2, 3, repeating (or `weight_of_rank`, an expression over
    `rank` from 0). All targets together are all words. A target stops at `cap` times its source's size
    and the excess goes to the others by weight. The level, words for each unit of weight, is found in rounds: each
    is one aggregate over the sources and takes out those whose cap lies under the level so far. It only rises, so
    the rounds end; the sources, which may be millions of hosts, never meet in one task.
    """
    w = weight_of_rank if weight_of_rank is not None else F.pmod(F.col("rank"), F.lit(3)) + 1
    t = numbered(sizes, [F.col("source").asc_nulls_last()], "place").withColumn("rank", F.col("place") - 1)
    t = stored(t.select("source", "source_size", w.cast("long").alias("weight"), (F.lit(cap) * F.col("source_size")).alias("most")))
    level, full = 0.0, -1
    while True:
        under = F.col("most") <= F.lit(level) * F.col("weight")
        taken = F.when(under, 1)
        n, every, most, weight, out = t.agg(F.count(taken), F.sum("source_size"), F.sum(F.col("most") * taken), F.sum("weight"), F.sum(F.col("weight") * taken)).first()
        if n == full or weight is None:
            break
        left = weight - (out or 0)
        # integers are divided as the same expression over columns would be
        full, level = n, float(every - (most or 0)) / left if left else level
    target = F.when(F.col("most") <= F.lit(level) * F.col("weight"), F.col("most").cast("double")).otherwise(F.lit(level) * F.col("weight"))
    return t.select("source", "source_size", target.alias("target"))


def offset(source: Column, seed: int) -> Column:
    """A number in [0, 1) for each source and seed."""
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(source, F.lit("")), F.lit(f"#{seed}"))), 1, 8), 16, 10).cast("double") / 4294967296.0


def whole_copies(sizes: Column, r: Column, u: Column) -> Column:
    """Copies of a source's largest documents, by their sizes from the largest down, and the words these take."""
    start = F.struct(F.lit(0).cast("long").alias("upto"), F.lit(0).cast("long").alias("taken"), F.array().cast("array<long>").alias("copies"))

    def step(a: Column, size: Column) -> Column:
        upto = a["upto"] + size
        open_ = F.floor((r * upto - a["taken"]) / F.when(size > 0, size).otherwise(1) + u)
        c = F.when(size > 0, F.least(F.greatest(open_, F.lit(0)), F.lit(CAP))).otherwise(0).cast("long")
        return F.struct(upto.alias("upto"), (a["taken"] + c * size).alias("taken"), F.concat(a["copies"], F.array(c)).alias("copies"))

    return F.aggregate(sizes, start, step)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 9, largest: int = LARGEST) -> DataFrame:
    """`(id_col, size, source_size, target, copies)` for every row of `docs`; copies is at most 3.

    size is the number of words (null text: 0). A null source is a source of its own. Rows that are alike
    in id, source and size share a place in the order, each with its own stretch. An empty table gives an
    empty one.

    Ranks within a source come from counts: rows are dealt by (source, size, two hex digits of the id's
    md5), a bucket's offset is the running count over the buckets before it, and only inside a bucket rows
    are numbered. So a source with a third of all rows is spread over thousands of buckets.
    """
    hashed = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    # the texts are read once; what follows works on this narrow table
    d = stored(docs.select(
        F.col(id_col).alias("mix_id"), F.col(source_col).alias("source"), hashed.alias("h"), F.substring(hashed, 1, 2).alias("h2"),
        F.coalesce(F.regexp_count(text_col, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
    ))
    buckets = d.groupBy("source", "size", "h2").agg(F.count("*").alias("n"))
    sources = buckets.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"))
    t = targets(sources).withColumn("r", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    u = offset(F.col("source"), seed)
    # running counts first over a source's sizes, then over a size's buckets: each window sees a bounded table
    sizes = buckets.groupBy("source", "size").agg(F.sum("n").alias("n"))
    lower = W.partitionBy("source").orderBy("size").rowsBetween(W.unboundedPreceding, -1)
    of_source = W.partitionBy("source")
    sizes = sizes.select(F.col("source").alias("s1"), F.col("size").alias("z1"), "n", F.coalesce(F.sum("n").over(lower), F.lit(0)).alias("under"), F.sum("n").over(of_source).alias("all"))
    # sizes of at most `largest` documents of a source, from the largest down
    over = F.col("all") - F.col("under") - F.col("n")
    few = sizes.where(over < largest).groupBy("s1").agg(F.max("all").alias("all"), F.array_sort(F.collect_list(F.struct((-F.col("z1")).alias("neg"), F.least("n", largest - over).cast("int").alias("times")))).alias("top"))
    few = few.withColumn("top", F.flatten(F.transform("top", lambda x: F.array_repeat(-x["neg"], x["times"]))))
    t = t.join(few, t["source"].eqNullSafe(few["s1"])).withColumn("whole", whole_copies(F.col("top"), F.col("r"), u)).drop("s1", "top")
    left = F.col("source_size") - F.col("whole.upto")
    rest = F.when(left > 0, F.least(F.greatest((F.col("target") - F.col("whole.taken")) / left, F.lit(0.0)), F.lit(float(CAP)))).otherwise(0.0)
    t = t.select("source", "source_size", "target", "all", rest.alias("r"), F.col("whole.copies").alias("whole"))
    before = W.partitionBy("source", "size").orderBy("h2").rowsBetween(W.unboundedPreceding, -1)
    base = buckets.select("source", "size", "h2", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("within"))
    base = base.join(sizes, base["source"].eqNullSafe(sizes["s1"]) & (base["size"] == sizes["z1"])).select("source", "size", "h2", (F.col("under") + F.col("within")).alias("base"))
    base = base.join(t, base["source"].eqNullSafe(t["source"])).select(base["source"].alias("s"), F.col("size").alias("z"), F.col("h2").alias("g"), "base", "source_size", "target", "all", "r", "whole")
    inside = W.partitionBy("source", "size", "h2").orderBy("h", "mix_id")
    ranked = d.select("mix_id", "source", "size", "h2", F.row_number().over(inside).alias("k"))
    both = ranked.join(base, ranked["source"].eqNullSafe(base["s"]) & (F.col("size") == F.col("z")) & (F.col("h2") == F.col("g")))
    rank = F.col("base") + F.col("k")
    crossed = F.floor(rank * F.col("r") + u) - F.floor((rank - 1) * F.col("r") + u)
    from_top = (F.col("all") - rank + 1).cast("int")
    crossed = F.when(from_top <= F.size("whole"), F.element_at("whole", F.least(from_top, F.size("whole")))).otherwise(crossed)
    return both.select(F.col("mix_id").alias(id_col), "size", "source_size", "target", F.least(crossed, F.lit(CAP)).cast("long").alias("copies"))
