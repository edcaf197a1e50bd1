"""Samples of streams (H5, H6): stateful processing that keeps the lowest lots of each group across batches."""

from __future__ import annotations

import sys

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.order import lot, sample, sample_per_group

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need no copy of this package

_TIME = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class LowestLots(StatefulProcessor):
    """State: the `n` lowest lots of a key so far. Gives the rows that are among them when they come."""

    def __init__(self, n: int):
        self.n = n

    def init(self, handle) -> None:
        self.kept = handle.getValueState("kept", "lots array<string>")

    def handleInputRows(self, key, rows, timerValues):
        lots = list(self.kept.get()[0]) if self.kept.exists() else []
        for part in rows:
            new = part[~part["lot_"].isin(lots)]
            if len(lots) >= self.n:
                new = new[new["lot_"] < lots[-1]]
            new = new.sort_values("lot_", kind="stable").drop_duplicates("lot_").head(self.n)
            lots = sorted([*lots, *new["lot_"]])[: self.n]
            yield pd.DataFrame({"row_": new["row_"][new["lot_"].isin(lots)]})
        self.kept.update((lots,))

    def close(self) -> None:
        pass


def admitted(rows: DataFrame, key: str, n: int, group: str | None = None, seed: int = 0, salts: int = 16) -> DataFrame:
    """Of a stream, the rows that were among the `n` lowest lots of their group (of all, without one) when they came.

    The sample of all rows so far is that of these (`sampled`), since a row that was left out has `n` keys below it. They
    are few: about n ln(N / n) of N keys. The state is `n` lots for each group and salt; the salt, from the lot, spreads a
    group of very many rows over `salts` keys of state. Repeated keys count once, whatever batch they come in.
    Needs the state store that Spark ships for arbitrary state, which is set for the session.
    """
    rows.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    drawn = lot(key, seed)
    d = rows.select(
        F.pmod(F.conv(F.substring(drawn, 1, 4), 16, 10).cast("int"), F.lit(salts)).alias("salt_"),
        (F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")).alias("group_"),
        (F.col(group).isNull() if group else F.lit(False)).alias("none_"),
        F.concat(drawn, F.lit(":"), F.coalesce(F.col(key).cast("string"), F.lit(""))).alias("lot_"),
        F.to_json(F.struct(*rows.columns), _TIME).alias("row_"),
    )
    d = d.groupBy("salt_", "group_", "none_").transformWithStateInPandas(LowestLots(n), "row_ string", "append", "none")
    return d.select(F.from_json("row_", rows.schema, _TIME).alias("row_")).select("row_.*")


def sampled(log: DataFrame, key: str, n: int, group: str | None = None, seed: int = 0) -> DataFrame:
    """H5, H6: the sample as of now, from all rows that `admitted` has given so far."""
    return sample_per_group(log, group, key, n, seed) if group else sample(log, key, n, seed)
