"""Op logs: rows (k, seq, type, v). type 1 is a value, 0 a deletion (v is null); seq grows with each commit.

Keys and values are opaque bytes; string keys work alike, for both kinds compare byte by byte.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codec import entry_size

DELETE, VALUE = 0, 1
OP_SCHEMA = T.StructType([T.StructField("k", T.BinaryType(), False), T.StructField("seq", T.LongType(), False), T.StructField("type", T.IntegerType(), False), T.StructField("v", T.BinaryType(), True)])
BATCH_SCHEMA = T.StructType([T.StructField("op_idx", T.IntegerType(), False), T.StructField("k", T.BinaryType(), False), T.StructField("type", T.IntegerType(), False), T.StructField("v", T.BinaryType(), True)])


#: What one task sorts at most, in bytes and in entries (a row of few bytes takes some hundred in memory).
TASK_BYTES, TASK_ENTRIES = 64 << 20, 500_000
#: Parts that a task numbers: several, so that hashing deals them out evenly.
PARTS_A_TASK = 8


def tasks_for(size: int, entries: int) -> int:
    """Tasks for so many bytes and entries: they follow from what there is to sort, and not from how small runs are cut."""
    return max(1, -(-size // TASK_BYTES), -(-entries // TASK_ENTRIES))


def as_bytes(x: bytes | bytearray | str) -> bytes:
    return x.encode() if isinstance(x, str) else bytes(x)


class WriteBatch:
    """An ordered, atomic list of puts and deletes."""

    HEADER = 12

    def __init__(self) -> None:
        self._ops: list[tuple[int, bytes, bytes | None]] = []

    def put(self, key: bytes | str, value: bytes | str) -> WriteBatch:
        self._ops.append((VALUE, as_bytes(key), as_bytes(value)))
        return self

    def delete(self, key: bytes | str) -> WriteBatch:
        self._ops.append((DELETE, as_bytes(key), None))
        return self

    def clear(self) -> None:
        self._ops.clear()

    def count(self) -> int:
        return len(self._ops)

    def approximate_size(self) -> int:
        return self.HEADER + sum(1 + len(k) + len(v or b"") + 10 for _, k, v in self._ops)

    def iterate(self, handler) -> None:
        """Calls handler.put(key, value) and handler.delete(key) in the order of the batch."""
        for kind, k, v in self._ops:
            handler.put(k, v) if kind == VALUE else handler.delete(k)

    def rows(self, first_seq: int) -> list[tuple[bytes, int, int, bytes | None]]:
        return [(k, first_seq + i, kind, v) for i, (kind, k, v) in enumerate(self._ops)]

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(i, k, kind, v) for i, (kind, k, v) in enumerate(self._ops)], BATCH_SCHEMA)

    @classmethod
    def from_rows(cls, rows) -> WriteBatch:
        batch = cls()
        batch._ops = [(r["type"], bytes(r["k"]), None if r["v"] is None else bytes(r["v"])) for r in sorted(rows, key=lambda r: r["op_idx"])]
        return batch


class BatchSize(NamedTuple):
    """First and last op_idx of a batch (None if it is empty), its operations and their encoded bytes."""

    low: int | None
    high: int | None
    entries: int
    bytes: int


def batch_size(batch: DataFrame) -> BatchSize:
    n_bytes = F.coalesce(F.sum(entry_size(F.col("k"), F.col("v"))), F.lit(0))
    return BatchSize(*batch.agg(F.min("op_idx"), F.max("op_idx"), F.count("*"), n_bytes).first())


def with_seq(batch: DataFrame, base: int, size: BatchSize | None = None) -> DataFrame:
    """A batch's operations with their sequence numbers: base + 1 on, in the order of op_idx, gaps closed.

    The position is found from counts per part, so no task sorts the whole batch; the number of tasks grows with it.
    """
    low, high, entries, n_bytes = size or batch_size(batch)
    if low is None:
        return batch.select("k", F.lit(None).cast("long").alias("seq"), "type", "v")
    tasks = max(1, batch.sparkSession.sparkContext.defaultParallelism, tasks_for(n_bytes, entries))
    width = (high - low) // (PARTS_A_TASK * tasks) + 1
    split = batch.withColumn("part", F.expr(f"(op_idx - {low}) div {width}"))
    sizes = split.groupBy("part").agg(F.count("*").alias("n"))
    starts = sizes.withColumn("start", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    nth = F.row_number().over(Window.partitionBy("part").orderBy("op_idx"))
    return split.repartition(tasks, "part").withColumn("nth", nth).join(F.broadcast(starts.select("part", "start")), "part").select("k", (F.col("start") + F.col("nth") + F.lit(base)).alias("seq"), "type", "v")


def batch_last_ops(ops: DataFrame, batch: str = "batch_id", index: str = "op_idx") -> DataFrame:
    """Per batch and key the last operation, which is the one that a replay in order leaves, and the batch's count."""
    last = ops.groupBy(batch, "k").agg(F.max_by(F.struct("type", "v"), index).alias("op"), F.count("*").alias("n_ops"))
    return last.select(batch, "k", "op.type", "op.v", "n_ops")


def synthetic_ops(spark: SparkSession, n: int, value_size: int = 100, seed: int = 0) -> DataFrame:
    """n puts of keys key_<i> with hexadecimal values of value_size characters that depend on key and seed alone."""
    words = -(-value_size // 64)
    value = F.concat(*[F.sha2(F.concat_ws(":", F.lit(seed), F.lit(j), F.col("id").cast("string")), 256) for j in range(words)])
    return spark.range(n).select(F.format_string("key_%d", F.col("id")).cast("binary").alias("k"), (F.col("id") + 1).alias("seq"), F.lit(VALUE).alias("type"), F.substring(value, 1, value_size).cast("binary").alias("v"))
