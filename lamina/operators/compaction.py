"""Flush cuts, level picking and compaction, as DataFrame plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import entry_size
from .latest import for_snapshots, latest
from .ops import VALUE

MB = 1 << 20
#: Target bytes of levels 0 to 6.
LEVEL_TARGETS = (0, 10 * MB, 100 * MB, 1024 * MB, 10 * 1024 * MB, 100 * 1024 * MB, 1024 * 1024 * MB)


def output_level(level, levels: int = 7):
    return F.least(level + 1, F.lit(levels - 1))


def memtable_cut(ops: DataFrame, write_buffer_size: int, width: int = 1 << 16) -> DataFrame:
    """ops with run: a new run begins each time the encoded entries so far pass another buffer's bytes.

    The running sum is taken within ranges of width sequence numbers, on top of the sums of the ranges before, themselves
    taken in ranges of width.
    """
    sized = ops.withColumn("bytes", entry_size(F.col("k"), F.col("v"))).withColumn("band", F.expr(f"seq div {width}L"))
    sums = sized.groupBy("band").agg(F.sum("bytes").alias("b")).withColumn("far", F.expr(f"band div {width}L"))
    before = lambda w: F.coalesce(F.sum("b").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # Ranges of ranges: what is ordered as a whole has a row for width squared sequence numbers.
    far = sums.groupBy("far").agg(F.sum("b").alias("b")).select("far", before(Window.orderBy("far")).alias("base"))
    near = sums.withColumn("inner", before(Window.partitionBy("far").orderBy("band")))
    starts = near.join(far, "far").select("band", (F.col("base") + F.col("inner")).alias("start"))
    own = F.sum("bytes").over(Window.partitionBy("band").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0))
    run = F.expr(f"(start + own - bytes) div {write_buffer_size}L")
    return sized.withColumn("own", own).join(starts, "band").withColumn("run", run).drop("own", "start", "band")


def file_stats(ops: DataFrame, by: list[str]) -> DataFrame:
    """A catalogue row for each run: entries, bytes, smallest and largest key and sequence number."""
    return ops.groupBy(*by).agg(F.count("*").alias("num_entries"), F.sum(entry_size(F.col("k"), F.col("v"))).alias("file_size"), F.min("k").alias("smallest"), F.max("k").alias("largest"), F.min("seq").alias("min_seq"), F.max("seq").alias("max_seq"))


def pick_compaction(files: DataFrame, targets: tuple[int, ...] = LEVEL_TARGETS) -> DataFrame:
    """level, number of the files to compact: all of level 0 if it has any, else the first file of the first level over its target."""
    spark = files.sparkSession
    values = ", ".join(f"({i}, {t}L)" for i, t in enumerate(targets[:-1]))
    target = spark.sql(f"select * from values {values} as t(level, target)")
    sums = files.groupBy("level").agg(F.sum("file_size").alias("total"), F.min("number").alias("first_number"))
    due = sums.join(F.broadcast(target), "level").filter((F.col("level") == 0) | (F.col("total") > F.col("target")))
    chosen = due.agg(F.min_by(F.struct("level", "first_number"), "level").alias("c")).select("c.level", "c.first_number")
    return files.join(F.broadcast(chosen), "level").filter((F.col("level") == 0) | (F.col("number") == F.col("first_number"))).select("level", "number")


def compacted(inputs: DataFrame, bottom: bool, pinned: list[int] | tuple = ()) -> DataFrame:
    """The versions that a compaction keeps: the newest of each key, and what pinned snapshots see.

    Tombstones go only at the bottom, where no deeper file can hold the key: elsewhere older values would come back.
    """
    if not pinned:
        out = latest(inputs)
        return out.filter(F.col("type") == VALUE) if bottom else out
    kept = for_snapshots(inputs, list(pinned))
    if not bottom:
        return kept
    oldest = kept.withColumn("oldest", F.min("seq").over(Window.partitionBy("k")))
    return oldest.filter((F.col("type") == VALUE) | (F.col("seq") > F.col("oldest"))).drop("oldest")
