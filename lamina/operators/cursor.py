"""Cursor verbs over the live keys, as lazy DataFrames: filters on the key reach every run's scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import work_folder
from .latest import live


def successor(prefix: bytes) -> bytes | None:
    """The least key above all keys with this prefix; None if there is none."""
    cut = prefix.rstrip(b"\xff")
    return cut[:-1] + bytes([cut[-1] + 1]) if cut else None


def _literal(df: DataFrame, key) -> Column:
    kind = dict(df.dtypes)["k"]
    return F.lit(key.encode() if kind == "binary" and isinstance(key, str) else bytearray(key) if isinstance(key, bytes) and kind == "binary" else key)


def in_range(df: DataFrame, lo=None, hi=None) -> DataFrame:
    """lo <= k < hi."""
    if lo is not None:
        df = df.filter(F.col("k") >= _literal(df, lo))
    if hi is not None:
        df = df.filter(F.col("k") < _literal(df, hi))
    return df


def scan(ops: DataFrame, lo=None, hi=None, prefix=None, reverse: bool = False, limit: int | None = None, seq: int | None = None, keys_only: bool = False, ordered: bool = True) -> DataFrame:
    """Live entries in key order. A limit makes it a top-k, which sorts nothing as a whole."""
    if prefix is not None:
        ops = with_prefix(ops, prefix)
    out = live(in_range(ops, lo, hi), seq)
    if keys_only:
        out = out.select("k")
    if ordered or limit is not None:
        out = out.orderBy(F.col("k").desc() if reverse else F.col("k").asc())
    return out if limit is None else out.limit(limit)


def with_prefix(df: DataFrame, prefix) -> DataFrame:
    if dict(df.dtypes)["k"] == "binary":
        raw = prefix.encode() if isinstance(prefix, str) else bytes(prefix)
        return in_range(df, raw, successor(raw)) if raw else df
    return df.filter(F.col("k").startswith(prefix))


def get(ops: DataFrame, key, seq: int | None = None) -> DataFrame:
    """The value of a key: one row or none."""
    return live(ops.filter(F.col("k") == _literal(ops, key)), seq)


def multi_get(ops: DataFrame, probes: DataFrame, seq: int | None = None) -> DataFrame:
    """k, found, v for each row of probes (k): versions of other keys go before the newest is chosen."""
    asked = probes.select("k").distinct()
    known = live(ops.join(asked, "k", "left_semi"), seq)
    return probes.join(known, "k", "left").select("k", F.col("seq").isNotNull().alias("found"), "v")


def first(ops: DataFrame, seq: int | None = None) -> DataFrame:
    return scan(ops, limit=1, seq=seq)


def last(ops: DataFrame, seq: int | None = None) -> DataFrame:
    return scan(ops, limit=1, seq=seq, reverse=True)


def seek(ops: DataFrame, target, seq: int | None = None) -> DataFrame:
    """The first entry at or after target."""
    return scan(ops, lo=target, limit=1, seq=seq)


def seek_prev(ops: DataFrame, target, seq: int | None = None) -> DataFrame:
    """The last entry before target."""
    return scan(ops, hi=target, limit=1, seq=seq, reverse=True)


def ranged(rows: DataFrame, parts: int | None = None) -> DataFrame:
    """rows in ranges of k, written once with part, the range's number: whoever reads them twice sees the same bounds."""
    spark = rows.sparkSession
    parts = parts or spark.sparkContext.defaultParallelism
    path = work_folder(spark, "ranged")
    out = rows.repartitionByRange(parts, "k").withColumn("part", F.spark_partition_id())
    out.write.parquet(path)
    return spark.read.schema(out.schema).parquet(path)


def multi_seek(ops: DataFrame, probes: DataFrame, seq: int | None = None, before: bool = False, parts: int | None = None) -> DataFrame:
    """k, at: for each probe the first live key at or after it (before: the last one before it).

    An as-of join: probes and keys are sorted together in ranges; a probe whose answer lies beyond its range takes the
    least (greatest) key of the ranges that follow, of which there are as many as partitions. Frames begin where a range
    does, in falling order for keys after a probe, so a row is looked at once.
    """
    keys = live(ops, seq).select("k", F.lit(0).alias("is_probe"))
    asked = probes.select("k").distinct().select("k", F.lit(1).alias("is_probe"))
    both = ranged(keys.unionByName(asked), parts)
    key = F.when(F.col("is_probe") == 0, F.col("k"))
    if before:
        near = F.last(key, True).over(Window.partitionBy("part").orderBy(F.col("k").asc(), F.col("is_probe").desc()).rowsBetween(Window.unboundedPreceding, -1))
        edge, beyond = F.max(key), F.max("edge").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    else:
        near = F.last(key, True).over(Window.partitionBy("part").orderBy(F.col("k").desc(), F.col("is_probe").asc()).rowsBetween(Window.unboundedPreceding, 0))
        edge, beyond = F.min(key), F.min("edge").over(Window.orderBy("part").rowsBetween(1, Window.unboundedFollowing))
    edges = both.groupBy("part").agg(edge.alias("edge")).withColumn("beyond", beyond).select("part", "beyond")
    out = both.withColumn("near", near).filter("is_probe = 1").join(F.broadcast(edges), "part", "left")  # a row a partition
    return out.select("k", F.coalesce("near", "beyond").alias("at"))


def neighbours(ops: DataFrame, seq: int | None = None, parts: int | None = None) -> DataFrame:
    """k with the live keys before and after it. Ranges are windowed apart; their edges are a row a partition."""
    dealt = ranged(live(ops, seq).select("k"), parts)
    w, by = Window.partitionBy("part").orderBy("k"), Window.orderBy("part")
    edges = dealt.groupBy("part").agg(F.min("k").alias("lo"), F.max("k").alias("hi"))
    edges = edges.select("part", F.lag("hi").over(by).alias("left"), F.lead("lo").over(by).alias("right"))
    out = dealt.withColumn("prev_k", F.lag("k").over(w)).withColumn("next_k", F.lead("k").over(w)).join(F.broadcast(edges), "part")
    return out.select("k", F.coalesce("prev_k", "left").alias("prev_k"), F.coalesce("next_k", "right").alias("next_k"))


def leveled_get(ops: DataFrame, seq: int | None = None) -> DataFrame:
    """The newest version by file precedence: ops carry level and number; level 0 newest file first, then deeper levels."""
    w = Window.partitionBy("k").orderBy(F.asc("level"), F.desc("number"), F.desc("seq"))
    return ops.withColumn("rn", F.row_number().over(w)).filter("rn = 1").drop("rn")


def contains(ops: DataFrame, key, seq: int | None = None) -> bool:
    return not get(ops, key, seq).isEmpty()

