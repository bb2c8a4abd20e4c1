"""Counters and ratios of reads, writes, caches and compactions."""

from __future__ import annotations

import threading
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass
class Metrics:
    reads: int = 0
    writes: int = 0
    read_ns: int = 0
    write_ns: int = 0
    cache_hits: int = 0
    cache_misses: int = 0
    table_hits: int = 0
    table_misses: int = 0
    physical_bytes: int = 0
    user_bytes: int = 0
    compactions: int = 0
    compacted_bytes: int = 0
    lock: threading.Lock = field(default_factory=threading.Lock, repr=False, compare=False)

    def add(self, **more: int) -> None:
        with self.lock:
            for name, n in more.items():
                setattr(self, name, getattr(self, name) + n)

    def reset(self) -> None:
        with self.lock:
            for name in self.values():
                setattr(self, name, 0)

    def values(self) -> dict[str, int]:
        return {n: getattr(self, n) for n in self.__dataclass_fields__ if n != "lock"}

    @staticmethod
    def _rate(hits: int, misses: int) -> float:
        return hits / (hits + misses) if hits + misses else 0.0

    def block_cache_hit_rate(self) -> float:
        return self._rate(self.cache_hits, self.cache_misses)

    def table_cache_hit_rate(self) -> float:
        return self._rate(self.table_hits, self.table_misses)

    def write_amplification(self) -> float:
        return self.physical_bytes / self.user_bytes if self.user_bytes else 1.0

    def to_df(self, spark: SparkSession) -> DataFrame:
        row = self.values() | {"block_cache_hit_rate": self.block_cache_hit_rate(), "table_cache_hit_rate": self.table_cache_hit_rate(), "write_amplification": self.write_amplification()}
        return spark.createDataFrame([tuple(row.values())], list(row))


def trace_metrics(trace: DataFrame) -> DataFrame:
    """One row from an op trace (kind 'read' or 'write', ns, hit boolean, bytes): counts, latencies, rates."""
    reads, writes = F.count_if(F.col("kind") == "read"), F.count_if(F.col("kind") == "write")
    hits, misses = F.count_if(F.col("hit")), F.count_if(~F.col("hit"))
    total = lambda k, c: F.coalesce(F.sum(F.when(F.col("kind") == k, F.col(c))), F.lit(0))
    return trace.agg(reads.alias("reads"), writes.alias("writes"), total("read", "ns").alias("read_ns"), total("write", "ns").alias("write_ns"), F.coalesce(hits / F.nullif(hits + misses, F.lit(0)), F.lit(0.0)).alias("hit_rate"))


def ratio(top, under, empty: float):
    return F.coalesce(top / F.nullif(under, F.lit(0)), F.lit(empty))


