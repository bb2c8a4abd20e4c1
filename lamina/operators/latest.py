"""The one primitive that reads compose on: the newest version of each key, as of a sequence number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ops import VALUE


def merged(*runs: DataFrame) -> DataFrame:
    """All versions from several runs; filters on the key pass through to each run's scan."""
    return reduce(lambda a, b: a.unionByName(b), runs)


def as_of(ops: DataFrame, seq: int | None) -> DataFrame:
    """What a snapshot sees; it must be cut before the newest is chosen."""
    return ops if seq is None else ops.filter(F.col("seq") <= seq)


def latest(ops: DataFrame, seq: int | None = None) -> DataFrame:
    """The newest version of each key, tombstones included: one shuffle, and a row a key and task goes into it.

    Ranked, with the group limit below the shuffle too: 4.0 s where max_by of the row took 4.3, for 6,000,000 versions of
    20,000 keys, and 5.8 where it took 6.2, for 1,000,000 keys. Both sort.
    """
    w = Window.partitionBy("k").orderBy(F.desc("seq"))
    return as_of(ops, seq).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("k", "seq", "type", "v")


def live(ops: DataFrame, seq: int | None = None) -> DataFrame:
    """k, seq, v of the keys that are there."""
    return latest(ops, seq).filter(F.col("type") == VALUE).select("k", "seq", "v")


def tombstones(ops: DataFrame, seq: int | None = None) -> DataFrame:
    return latest(ops, seq).filter(F.col("type") != VALUE).select("k", "seq")


def version_counts(ops: DataFrame) -> DataFrame:
    return ops.groupBy("k").agg(F.count("*").alias("n_versions"), F.sum(F.when(F.col("type") == VALUE, 0).otherwise(1)).alias("n_deletes"), F.max("seq").alias("last_seq"))


def snapshot_diff(ops: DataFrame, before: int, after: int | None = None) -> DataFrame:
    """k, change (insert, update or delete), old and new value, between two snapshots; one pass over the log."""
    now = as_of(ops, after)
    was = F.col("seq") <= before
    state = now.groupBy("k").agg(F.max_by(F.struct("seq", "type", "v"), F.when(was, F.col("seq"))).alias("a"), F.max_by(F.struct("seq", "type", "v"), "seq").alias("b"))
    had, has = F.coalesce(F.col("a.type") == VALUE, F.lit(False)) & (F.col("a.seq") <= before), F.col("b.type") == VALUE
    change = F.when(had & ~has, "delete").when(~had & has, "insert").when(had & has & (F.col("a.seq") != F.col("b.seq")), "update")
    return state.select("k", change.alias("change"), F.when(had, F.col("a.v")).alias("old_v"), F.when(has, F.col("b.v")).alias("new_v")).filter("change is not null")


def for_snapshots(ops: DataFrame, pinned: list[int]) -> DataFrame:
    """The versions that the head or a pinned snapshot sees: what a compaction must keep."""
    cuts = sorted({int(s) for s in pinned})
    band = F.lit(0)
    for s in cuts:
        band = band + F.when(F.col("seq") > s, 1).otherwise(0)
    w = Window.partitionBy("k", "band").orderBy(F.desc("seq"))
    return ops.withColumn("band", band).withColumn("rn", F.row_number().over(w)).filter("rn = 1").select("k", "seq", "type", "v")
