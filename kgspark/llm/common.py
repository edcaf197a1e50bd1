"""What the operators of this subpackage share: tables between steps, bounded label samples, text columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import checkpointed, forget, shared_folder, stored  # noqa: F401

#: Words are runs of anything but these (space, tab, line feed, vertical tab, form feed, carriage return).
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def join_few(df: DataFrame, few: DataFrame, on: list[str], by: str, salts: int = 64) -> DataFrame:
    """`df` with the columns of `few` (one row for each key, null where it has none).

    The rows of one key are dealt over `salts` tasks by a hash of `by`, and the rows of `few` stand once for each.
    """
    few = few.withColumn("salt_", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return df.withColumn("salt_", F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")).join(few, [*on, "salt_"], "left").drop("salt_")


def text_bytes(text: Column | str) -> Column:
    """UTF-8 bytes of a text, null as empty; this is how the Python stages receive texts."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).cast("binary")


def bounded_labels(labels: DataFrame, label: str, bound: int, id_col: str = "doc_id") -> DataFrame:
    """At most about `bound` labelled ids, chosen by a hash of the id, one row per id.

    Rows without an id or label are left out; of several labels for an id the largest counts. The same
    ids are chosen in every run. The result has the columns `sample_id` and `y`.
    """
    one = labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(id_col).alias("sample_id")).agg(F.max(label).cast("int").alias("y"))
    n = one.count()
    if n <= bound:
        return one
    return one.where(F.pmod(F.xxhash64("sample_id", F.lit(7)), F.lit(1_000_000)) < int(1_000_000 * bound / n))


def labelled_texts(docs: DataFrame, sample: DataFrame, id_col: str, text_col: str, chars: int | None = None) -> DataFrame:
    """`sample_id, y, text` of the documents in a bounded sample; the sample's size is known, so it is broadcast.

    With `chars` the texts are bounded too: where they have more characters together, fewer ids are taken, by another
    hash, so that about as many remain. What is gathered of them on the driver is then bounded whatever their length.
    """
    d = docs.select(F.col(id_col).alias("sample_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "sample_id")
    n = (d.agg(F.sum(F.length("text"))).first()[0] or 0) if chars is not None else 0
    if chars is None or n <= chars:
        return d
    return d.where(F.pmod(F.xxhash64("sample_id", F.lit(13)), F.lit(1_000_000)) < int(1_000_000 * chars / n))


def crc_fold(id_col: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id written as text, modulo `folds`; a null id counts as empty text, whose remainder is 0."""
    return F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), F.lit(folds))
