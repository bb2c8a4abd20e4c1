"""Keyed upserts as streams: op-log rows in, the newest version of each key out.

Arrival order is not trusted: what decides is seq, kept in state or resolved on read.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

STATE = "k string, seq long, type int, v string"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Newest(StatefulProcessor):
    """A key's newest version, rows one by one; a row leaves for each micro-batch that brought a newer one."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "seq long, type int, v string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        was = self.held.get() if self.held.exists() else None
        best = was
        for r in rows:
            if best is None or r["seq"] > best[0]:
                best = (r["seq"], r["type"], r["v"])
        if best is not was:
            self.held.update(tuple(best))
            yield Row(k=key[0], seq=best[0], type=best[1], v=best[2])

    def close(self) -> None:
        pass


def upsert_view(stream: DataFrame) -> DataFrame:
    """An update stream with the newest version of each key that a micro-batch raised. State lies in RocksDB, so it may outgrow memory."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    return stream.groupBy("k").transformWithState(Newest(), STATE, "update", "none")


def append_view(stream: DataFrame, path: str, checkpoint: str):
    """A query that writes each micro-batch of an update stream to a folder of its own number, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_runs(stream: DataFrame, path: str, checkpoint: str):
    """A query that appends each micro-batch to the op log at path, sorted; exactly once, by the file sink's commit log."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
