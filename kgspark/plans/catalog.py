"""The triple table in Spark's catalog, with statistics, so that the cost of joins decides their order.

A table stored by predicate is registered as one table for each predicate, and its columns are analysed. Spark's own
cost-based optimiser then knows how many rows each pattern has and how many distinct nodes, and starts a chain of
patterns from the small ones whatever their order in the query.
"""

from __future__ import annotations

from dataclasses import dataclass
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import folders
from .triples import TRIPLE

_COLUMNS = "s string, o string, o_kind string, o_type string, o_lang string"


@dataclass
class Catalogued:
    """Tables by predicate, to be given to `match.match` in place of a frame."""

    spark: SparkSession
    tables: dict[str, str]

    def __call__(self, pattern: tuple[str, str, str]) -> DataFrame:
        """The triples that can fit a pattern: those of its predicate, or of all where that is a variable."""
        p = pattern[1]
        if not p.startswith("?"):
            return self._of(p) if p in self.tables else self.spark.createDataFrame([], f"p string, {_COLUMNS}").select(*TRIPLE)
        every = None
        for name in self.tables:
            every = self._of(name) if every is None else every.unionByName(self._of(name))
        return every

    def _of(self, p: str) -> DataFrame:
        return self.spark.table(self.tables[p]).withColumn("p", F.lit(p)).select(*TRIPLE)

    def drop(self) -> None:
        """Forget the tables; their files stay."""
        for t in self.tables.values():
            self.spark.sql(f"DROP TABLE IF EXISTS {t}")


def register(spark: SparkSession, path: str, name: str) -> Catalogued:
    """Tables `<name>_0`, `<name>_1`, … over the folders of `files.write_triples`, with the statistics of s and o.

    Turns on cost-based optimisation and join reordering for the session; plans over tables without statistics are not
    affected. Predicates are few: one folder is listed for each.
    """
    spark.conf.set("spark.sql.cbo.enabled", "true")
    spark.conf.set("spark.sql.cbo.joinReorder.enabled", "true")
    tables = {}
    for k, folder in enumerate(f for f in folders(spark, path) if f.startswith("p=")):
        table = f"{name}_{k}"
        spark.sql(f"DROP TABLE IF EXISTS {table}")
        spark.sql(f"CREATE TABLE {table} ({_COLUMNS}) USING parquet LOCATION '{path}/{folder}'")
        spark.sql(f"ANALYZE TABLE {table} COMPUTE STATISTICS FOR COLUMNS s, o")
        tables[unquote(folder[2:])] = table
    return Catalogued(spark, tables)


def rows_of(spark: SparkSession, table: str) -> int:
    """Number of rows that the catalog has for an analysed table."""
    r = spark.sql(f"DESCRIBE EXTENDED {table}").where("col_name = 'Statistics'").first()
    return int(r["data_type"].rsplit(",", 1)[1].split()[0])
