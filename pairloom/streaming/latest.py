"""The last row of each key on a stream, as keyed state that may expire."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from pairloom.operators.rows import keep_last

_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Last(StatefulProcessor):
    """Holds the order of a key's last row and lets through rows that come after it."""

    def __init__(self, order: str, expiry_ms: int | None):
        self.order, self.expiry_ms = order, expiry_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "at long", self.expiry_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        best = None
        for part in rows:  # a key's rows come in parts of bounded size
            part = part[part[self.order].notna()]
            if len(part):
                row = part.loc[[part[self.order].idxmax()]]
                best = row if best is None or row[self.order].iloc[0] > best[self.order].iloc[0] else best
        if best is None:
            return
        at = int(best[self.order].iloc[0])
        if not self.last.exists() or at > self.last.get()[0]:
            self.last.update((at,))
            yield best

    def close(self) -> None:
        pass


def latest_rows(rows: DataFrame, key: str, order: str, expiry_ms: int | None = None) -> DataFrame:
    """Of a stream: every row that becomes the last of its ``key`` by ``order`` (a long), as it does.

    The state of a key is one number, kept in RocksDB on the executors and in
    the checkpoint. With ``expiry_ms`` a key is forgotten that long after its
    last change, and a row that comes then counts as its first. Of rows with
    equal order the first to arrive stays; rows without a key are one key, rows
    without an order are left out. Null-free integer columns aside, values pass
    as they are.
    """
    spark = rows.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _STORE)
    keyed = rows.where(F.col(order).isNotNull())
    return keyed.groupBy(key).transformWithStateInPandas(_Last(order, expiry_ms), rows.schema, "Append", "ProcessingTime" if expiry_ms else "None")


def write_latest(rows: DataFrame, key: str, order: str, out: str, checkpoint: str, expiry_ms: int | None = None) -> StreamingQuery:
    """Append the changes of ``latest_rows`` for all that has arrived, then stop; started again it goes on where it stopped.

    With an expiry the clock alone would always call for another batch, so all that has arrived is one batch.
    """
    changes = latest_rows(rows, key, order, expiry_ms)
    until = {"once": True} if expiry_ms else {"availableNow": True}
    return (
        changes.writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(**until).start(out)
    )


def read_latest(spark: SparkSession, out: str, key: str, order: str) -> DataFrame:
    """The last row of each key from the changes that were written: what ``keep_last`` gives for all rows that arrived."""
    return keep_last(spark.read.parquet(out), key, order)
