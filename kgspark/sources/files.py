"""Readers and writers of records, documents and triples."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.scalars import escape_literal, unescape_literal
from ..operators.order import dealt, numbered
from ..plans.triples import TRIPLE
from ..storage import folders, publish, read_newest, remove, versions


def read_records(spark: SparkSession, path: str, schema: StructType | str, multi_line: bool = True) -> DataFrame:
    """A1, A3: a JSON array of records, or one record per line; a byte-order mark is accepted. Missing fields are null."""
    return spark.read.schema(schema).option("multiLine", multi_line).json(path)


def read_keyed(spark: SparkSession, path: str, value_schema: str, key: str = "key", digits: int = 4) -> DataFrame:
    """A2: a JSON object used as a map, one row per entry; numeric keys get leading zeros."""
    d = spark.read.text(path, wholetext=True).select(F.explode(F.from_json(F.regexp_replace("value", "^﻿", ""), f"map<string, struct<{value_schema}>>")).alias("k", "v"))
    padded = F.when(F.col("k").rlike("^[0-9]+$") & (F.length("k") < digits), F.lpad("k", digits, "0")).otherwise(F.col("k"))
    return d.select(padded.alias(key), "v.*")


def read_partitioned_folders(spark: SparkSession, root: str, schema: str, name: str = "*.json", folder: str = "folder", only: Sequence[str] | None = None) -> DataFrame:
    """A4: the files of all sub-folders as one frame, the folder's name as a column; `only` reads some folders."""
    paths = [f"{root}/{x}/{name}" for x in only] if only else f"{root}/*/{name}"
    d = spark.read.schema(schema).json(paths)
    return d.withColumn(folder, F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)))


def write_folders(df: DataFrame, root: str, folder: str) -> None:
    """A4: rows as JSON in one sub-folder for each value of a column, `<column>=<value>`; a null value has a folder too."""
    df.write.mode("overwrite").partitionBy(folder).json(root)


def read_folders(spark: SparkSession, root: str, schema: str, folder: str) -> DataFrame:
    """A4: what `write_folders` wrote, with the folder's value as text."""
    return spark.read.schema(f"{schema}, `{folder}` string").json(root)


def list_files(spark: SparkSession, root: str, pattern: str = "*", numbered: str = r"_(\d+)\.[^/]*$") -> DataFrame:
    """A5: `(path, length, file_id)` of files; the id is what `numbered` finds in the path, by default the number after the last underscore. Contents are not read."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root).select("path", "length")
    return d.withColumn("file_id", F.regexp_extract("path", numbered, 1).try_cast("bigint"))


def read_contents(spark: SparkSession, root: str, pattern: str = "*", least: int = 1) -> DataFrame:
    """`(path, length, content)` of files of at least `least` bytes; shorter ones are left out before they are opened."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    return d.where(F.col("length") >= least).select("path", "length", "content")


def read_first(spark: SparkSession, paths: Sequence[str], schema: str, multi_line: bool = True) -> DataFrame:
    """The first of several sources that exists, else an empty frame."""
    for p in paths:
        try:
            return read_records(spark, p, schema, multi_line)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    return spark.createDataFrame([], schema)


def write_records(df: DataFrame, path: str, form: str = "parquet", by: Sequence[str] = ()) -> str:
    """Overwrite by a new version beside the old one; `read_current` gives the old or the new rows, never a part. Gives the new files' path."""
    return publish(df, path, form, by)


def read_current(spark: SparkSession, path: str, schema: StructType | str, form: str = "parquet") -> DataFrame:
    """The rows that `write_records` last completed."""
    return read_newest(spark, path, schema, form)


def analytics_document(meta: DataFrame, **graphs: DataFrame) -> DataFrame:
    """One JSON document: `meta`'s only row, and each graph's rows as an array. For small graphs; large ones are written one folder each."""
    out = meta.select(F.to_json(F.struct("*")).alias("meta"))
    for name, d in graphs.items():
        rows = d.select(F.to_json(F.struct(*sorted(d.columns))).alias("j")).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list("j")), ","), F.lit("]")).alias(name))
        out = out.crossJoin(rows)
    parts = [F.concat(F.lit(f'"{n}":'), F.col(n)) for n in ("meta", *graphs)]
    return out.select(F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}")).alias("document"))


_SHARDS = "graph string, shard long, first long, rows long"


def write_shards(path: str, meta: DataFrame, rows_per_shard: int = 100_000, **graphs: DataFrame) -> None:
    """A8 for graphs of any size: each graph's array as shards of `rows_per_shard` JSON rows, in the order of their text, and an index of them.

    A shard is one text file, written by one task; the index has a row for each: `(graph, shard, first place, rows)`. It
    is published last, as a whole version that names the folder of its shards, so readers see the old document or the new.
    """
    spark = meta.sparkSession
    known = None
    folder = uuid.uuid4().hex
    for name, d in {"meta": meta, **graphs}.items():
        j = numbered(d.select(F.to_json(F.struct(*sorted(d.columns)), {"ignoreNullFields": "false"}).alias("value")), ["value"])
        j = j.withColumn("shard", F.floor((F.col("place") - 1) / rows_per_shard))
        j.repartition("shard").sortWithinPartitions("shard", "place").select("value", "shard").write.partitionBy("shard").text(f"{path}/{folder}/{name}")
        own = j.groupBy("shard").agg(F.min("place").alias("first"), F.count("*").alias("rows")).select(F.lit(name).alias("graph"), "shard", "first", "rows")
        known = own if known is None else known.unionByName(own)
    publish(known.withColumn("folder", F.lit(folder)).coalesce(1), f"{path}/index")
    current = {folder, *(r[0] for v in versions(spark, f"{path}/index") for r in spark.read.schema(_SHARDS + ", folder string").parquet(f"{path}/index/{v}").select("folder").distinct().collect())}
    for old in folders(spark, path):
        if old not in current and old != "index":
            remove(spark, f"{path}/{old}")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The shards of the newest document."""
    return read_newest(spark, f"{path}/index", _SHARDS + ", folder string")


def read_shards(spark: SparkSession, path: str, graph: str, schema: StructType | str) -> DataFrame:
    """The rows of one graph, with the shard that each is in; an empty frame if the document has none."""
    empty = spark.createDataFrame([], schema).withColumn("shard", F.lit(0).cast("long"))
    own = read_index(spark, path).where(F.col("graph") == graph)
    folder = own.select("folder").first()
    if folder is None:
        return empty
    d = spark.read.schema("value string, shard long").text(f"{path}/{folder[0]}/{graph}")
    return d.join(own.select("shard"), "shard").select(F.from_json("value", empty.drop("shard").schema).alias("row"), "shard").select("row.*", "shard")


def document_pieces(spark: SparkSession, path: str) -> Iterator[str]:
    """The whole document as pieces of text, one shard at a time, graphs by name after `meta`; together they are one JSON object."""
    index = read_index(spark, path).orderBy(F.col("graph") != "meta", "graph", "shard").collect()  # a row for each shard
    at = None
    for r in index:
        if r["graph"] != at:
            yield ("{" if at is None else "," if at == "meta" else "],") + f'"{r["graph"]}":' + ("" if r["graph"] == "meta" else "[")
        lines = spark.read.text(f"{path}/{r['folder']}/{r['graph']}/shard={r['shard']}", wholetext=True).first()[0]
        yield ("," if r["graph"] == at else "") + ",".join(lines.splitlines())
        at = r["graph"]
    yield "}" if at in (None, "meta") else "]}"


def write_document(path: str, meta: DataFrame, **graphs: DataFrame) -> None:
    """Each graph as its own Parquet folder beside `meta`, each overwritten as in A7."""
    for name, d in {"meta": meta, **graphs}.items():
        write_records(d, f"{path}/{name}")


def node(c: Column, kind: Column | None = None) -> Column:
    n = F.concat(F.lit("<"), c, F.lit(">"))
    return n if kind is None else F.when(kind == "bnode", F.concat(F.lit("_:"), c)).otherwise(n)


def ntriples_line(s: str = "s", p: str = "p", o: str = "o") -> Column:
    """One triple as a line; literals escaped, with language or type."""
    literal = F.concat(F.lit('"'), escape_literal(F.col(o)), F.lit('"'), F.coalesce(F.concat(F.lit("@"), F.col("o_lang")), F.concat(F.lit("^^<"), F.col("o_type"), F.lit(">")), F.lit("")))
    obj = F.when(F.col("o_kind") == "literal", literal).otherwise(node(F.col(o), F.col("o_kind")))
    return F.concat_ws(" ", node(F.col(s)), node(F.col(p)), obj, F.lit("."))


def write_ntriples(triples: DataFrame, path: str) -> None:
    """A9."""
    triples.select(ntriples_line().alias("value")).write.mode("overwrite").text(path)


def parse_ntriples(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines as triples; blank lines and comments are left out."""
    d = lines.where(F.col(value).rlike(r"^<[^>]*> <[^>]*> (?:<|_:|\")[\s\S]* \.\s*$"))
    head = F.regexp_extract(value, r"^<[^>]*> <[^>]*> ", 0)
    d = d.withColumn("rest_", F.substr(value, F.length(head) + 1))
    # the closing quote is the last one: what follows it holds none
    tail = F.regexp_extract("rest_", r'"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)? \.\s*$', 0)
    kind = F.when(F.col("rest_").startswith("<"), "iri").when(F.col("rest_").startswith("_:"), "bnode").otherwise("literal")
    d = d.withColumn("tail_", tail).withColumn("o_kind", kind)
    body = F.substr("rest_", F.lit(2), F.length("rest_") - F.length("tail_") - 1)
    node_name = F.regexp_extract("rest_", r"^(?:<([^>]*)>|_:(\S+))", 1)
    o = F.when(F.col("o_kind") == "literal", unescape_literal(body)).when(F.col("o_kind") == "iri", node_name).otherwise(F.regexp_extract("rest_", r"^_:(\S+)", 1))
    empty = lambda c: F.nullif(c, F.lit(""))
    lang, kind_of = F.regexp_extract("tail_", r'^"@([A-Za-z0-9-]+)', 1), F.regexp_extract("tail_", r'^"\^\^<([^>]*)>', 1)
    return d.select(F.regexp_extract(value, r"^<([^>]*)>", 1).alias("s"), F.regexp_extract(value, r"^<[^>]*> <([^>]*)>", 1).alias("p"), o.alias("o"), "o_kind", empty(kind_of).alias("o_type"), empty(lang).alias("o_lang"))


def read_ntriples(spark: SparkSession, path: str) -> DataFrame:
    """A11."""
    return parse_ntriples(spark.read.text(path))


def turtle_part() -> Column:
    """Predicate and object of a triple, as a block has them."""
    literal = F.concat(F.lit('"'), escape_literal(F.col("o")), F.lit('"'), F.coalesce(F.concat(F.lit("@"), F.col("o_lang")), F.concat(F.lit("^^"), F.col("o_type")), F.lit("")))
    return F.concat(F.col("p"), F.lit(" "), F.when(F.col("o_kind") == "literal", literal).otherwise(node(F.col("o"))))


def turtle_blocks(triples: DataFrame) -> DataFrame:
    """A10: `(s, block)`: all of a subject's properties in one block, sorted, `;` between and `.` last.

    A block is one row, so a subject must fit into one; `turtle_lines` has no such bound.
    """
    d = triples.select("s", turtle_part().alias("part")).groupBy("s").agg(F.array_sort(F.collect_set("part")).alias("parts"))
    return d.select("s", F.concat(node(F.col("s")), F.lit(" "), F.array_join("parts", " ; "), F.lit(" .")).alias("block"))


def turtle_lines(triples: DataFrame) -> DataFrame:
    """A10: `(place, s, line)`: the same text with one row for each property, numbered from 1; a subject may have any number.

    Distinct properties are sorted by range over many tasks. A line opens its subject's block if the line before is
    another subject's, and ends it if the line after is; at the ends of a range the neighbouring ranges tell, from a
    table with one row for each. No row and no task holds all properties of a subject.
    """
    d = dealt(triples.select("s", turtle_part().alias("part")).distinct(), None, ["s", "part"])
    ranges = d.groupBy("part_").agg(F.min("s").alias("first_"), F.max("s").alias("last_"), F.count("*").alias("n_"))
    order = W.partitionBy(F.lit(0)).orderBy("part_")  # one row for each range
    ranges = ranges.select("part_", F.lag("last_").over(order).alias("before_"), F.lead("first_").over(order).alias("after_"), (F.sum("n_").over(order.rowsBetween(W.unboundedPreceding, 0)) - F.col("n_")).alias("base_"))
    inside = W.partitionBy("part_").orderBy("in_")
    d = d.withColumns({"lag_": F.lag("s").over(inside), "lead_": F.lead("s").over(inside)}).join(F.broadcast(ranges), "part_")
    opens, ends = ~F.col("s").eqNullSafe(F.coalesce("lag_", "before_")), ~F.col("s").eqNullSafe(F.coalesce("lead_", "after_"))
    line = F.concat(F.when(opens, F.concat(node(F.col("s")), F.lit(" "))).otherwise("    "), F.col("part"), F.when(ends, " .").otherwise(" ;"))
    return d.select((F.col("base_") + F.col("in_") + 1).cast("long").alias("place"), "s", line.alias("line"))


def write_turtle_blocks(triples: DataFrame, path: str, prefixes: Sequence[tuple[str, str]] = ()) -> None:
    """A10: the lines of `turtle_lines` as text files; in the order of their names they are one document, the prefixes first."""
    d = turtle_lines(triples).select("place", F.col("line").alias("value"))
    if prefixes:
        head = "\n".join(f"@prefix {p}: <{n}> ." for p, n in prefixes)
        d = d.unionByName(triples.sparkSession.createDataFrame([(0, head)], "place long, value string"))
    d.sort("place").select("value").write.mode("overwrite").text(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Pages `(page_id, url, html)`."""
    return spark.read.schema("page_id long, url string, html string").parquet(path)


def write_triples(triples: DataFrame, path: str) -> None:
    """The triple table stored by predicate, so that a pattern reads the partitions of its own predicate only."""
    triples.select(*TRIPLE).repartition("p", F.pmod(F.xxhash64("s"), F.lit(32))).write.mode("overwrite").partitionBy("p").parquet(path)


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select(*TRIPLE)
