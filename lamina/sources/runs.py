"""Sorted runs as Parquet: one folder a run, sorted by key and newest first, with Bloom filters on the key."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from collections.abc import Callable

from pyspark.sql import Window

from ..functions.codec import entry_size
from ..operators.ops import OP_SCHEMA, tasks_for
from .catalog import CorruptionError, FileMeta, Storage
from .shared import remove, work_folder

COLUMNS = ["k", "seq", "type", "v"]


def run_path(root: str, number: int) -> str:
    return f"{root.rstrip('/')}/runs/{number}.sst"


def write_run(ops: DataFrame, root: str, number: int, level: int, partitions: int | None = None, compression: str = "none", page_bytes: int = 4096, row_group_bytes: int = 4 << 20, fpp: float = 0.01) -> FileMeta | None:
    """Writes a run and returns its catalogue row; None if there was nothing to write.

    Large runs are dealt by ranges of their order, so files and row groups have narrow key ranges and reads skip the rest, and
    no task sorts more than its share, not even of one key's versions.
    """
    ordered = ops.select(*COLUMNS)
    ordered = ordered.repartitionByRange(partitions, F.col("k"), F.col("seq").desc()) if partitions and partitions > 1 else ordered.coalesce(1)
    writer = ordered.sortWithinPartitions(F.col("k"), F.col("seq").desc()).write.mode("error")
    _formatted(writer, compression, page_bytes, row_group_bytes, fpp).parquet(run_path(root, number))
    meta = describe(read_runs(ops.sparkSession, root, [number]))
    return None if meta is None else replace(meta, number=number, level=level)


def _formatted(writer, compression: str, page_bytes: int, row_group_bytes: int, fpp: float, keys: int | None = None):
    """Bloom filters on the key, for keys at most if given (1 MB each otherwise), small row groups, page checksums."""
    options = {"parquet.bloom.filter.enabled#k": "true", "parquet.bloom.filter.fpp#k": fpp, "parquet.page.size": page_bytes, "parquet.block.size": row_group_bytes, "parquet.page.write-checksum.enabled": "true", "compression": compression}
    if keys:
        options["parquet.bloom.filter.expected.ndv#k"] = keys
    for name, value in options.items():
        writer = writer.option(name, str(value))
    return writer


def cut_by_bytes(ops: DataFrame, target: int, parts: int) -> DataFrame:
    """ops with file: in the order of k, a new file begins where the entries so far pass another target bytes; a key is in one file.

    Keys are dealt to ranges, written once; only a range's bytes are summed across ranges, so no task sees all keys.
    """
    spark = ops.sparkSession
    sized = ops.withColumn("bytes", entry_size(F.col("k"), F.col("v"))).repartitionByRange(parts, "k").withColumn("part", F.spark_partition_id())
    path = work_folder(spark, "cut")
    sized.write.parquet(path)
    held = spark.read.schema(sized.schema).parquet(path)
    sums = held.groupBy("part").agg(F.sum("bytes").alias("b"))  # a row a range
    starts = sums.select("part", F.coalesce(F.sum("b").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    before = F.coalesce(F.sum("bytes").over(Window.partitionBy("part").orderBy("k").rangeBetween(Window.unboundedPreceding, Window.currentRow)), F.lit(0)) - F.sum("bytes").over(Window.partitionBy("part", "k"))
    return held.withColumn("before", before).join(F.broadcast(starts), "part").withColumn("file", F.expr(f"(start + before) div {target}L")).drop("bytes", "part", "before", "start")


def write_runs(ops: DataFrame, root: str, new_number: Callable[[], int], level: int, size: int, entries: int, target: int, compression: str = "none", page_bytes: int = 4096, row_group_bytes: int = 4 << 20, fpp: float = 0.01) -> list[FileMeta]:
    """Writes ops, of up to size bytes and entries, as runs of target bytes each in the order of keys, all in one job, and
    returns their catalogue rows. These are summed first: filters are sized by them, and reading thousands of runs back takes longer."""
    spark = ops.sparkSession
    parts = tasks_for(size, entries)
    staged = work_folder(spark, "compaction")
    cut = cut_by_bytes(ops.select(*COLUMNS), target, parts)
    storage, metas = Storage(spark, root), []
    stats = describe_by(cut, "file")
    if not stats:
        return metas
    writer = cut.repartition(parts, "file").sortWithinPartitions("file", F.col("k"), F.col("seq").desc()).write.partitionBy("file")
    keys = max(meta.num_entries for meta in stats.values())
    _formatted(writer, compression, page_bytes, row_group_bytes, fpp, keys).parquet(staged)
    for file in sorted(stats):  # a row and a rename for each run
        number = new_number()
        storage.adopt(f"{staged}/file={file}", f"runs/{number}.sst")
        metas.append(replace(stats[file], number=number, level=level))
    remove(spark, staged)
    return metas


def describe_by(runs: DataFrame, by: str) -> dict[int, FileMeta]:
    rows = runs.groupBy(by).agg(F.count("*").alias("n"), F.sum(entry_size(F.col("k"), F.col("v"))).alias("b"), F.hex(F.min("k")).alias("lo"), F.hex(F.max("k")).alias("hi"), F.min("seq").alias("s0"), F.max("seq").alias("s1"))
    return {r[by]: FileMeta(0, 0, r["b"], r["n"], r["lo"].lower(), r["hi"].lower(), r["s0"], r["s1"]) for r in rows.collect()}


def verify_run(spark: SparkSession, root: str, meta: FileMeta) -> None:
    """Reads a run with its page checksums and holds it against the catalogue."""
    conf = spark._jsc.hadoopConfiguration()
    was = conf.get("parquet.page.verify-checksum.enabled")
    conf.set("parquet.page.verify-checksum.enabled", "true")
    try:
        found = describe(read_runs(spark, root, [meta.number]))
    except Exception as e:
        raise CorruptionError(f"run {meta.number} can't be read: {e}") from e
    finally:
        conf.unset("parquet.page.verify-checksum.enabled") if was is None else conf.set("parquet.page.verify-checksum.enabled", was)
    if found is None or replace(found, number=meta.number, level=meta.level) != meta:
        raise CorruptionError(f"run {meta.number} is not what the catalogue says")


def check_ascending(ops: DataFrame) -> DataFrame:
    """ops, failing where a partition's entries don't rise by (k, falling seq): what a writer of sorted runs is given."""
    w = Window.partitionBy("__p").orderBy("__i")
    at = ops.withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    rises = F.lag("k").over(w).isNull() | (F.lag("k").over(w) < F.col("k")) | ((F.lag("k").over(w) == F.col("k")) & (F.lag("seq").over(w) > F.col("seq")))
    return at.withColumn("__ok", rises).filter(F.when(F.col("__ok"), True).otherwise(F.raise_error(F.lit("entries must rise")).cast("boolean"))).drop("__p", "__i", "__ok")


def describe(run: DataFrame) -> FileMeta | None:
    r = run.agg(F.count("*").alias("n"), F.sum(entry_size(F.col("k"), F.col("v"))).alias("b"), F.hex(F.min("k")).alias("lo"), F.hex(F.max("k")).alias("hi"), F.min("seq").alias("s0"), F.max("seq").alias("s1")).first()
    return FileMeta(0, 0, r["b"], r["n"], r["lo"].lower(), r["hi"].lower(), r["s0"], r["s1"]) if r["n"] else None


def read_runs(spark: SparkSession, root: str, numbers: list[int]) -> DataFrame:
    """The entries of runs; a filter on k reaches the scan, and min-max values and Bloom filters skip row groups."""
    if not numbers:
        return spark.createDataFrame([], OP_SCHEMA)
    return spark.read.schema(OP_SCHEMA).parquet(*[run_path(root, n) for n in numbers])


def dump_run(spark: SparkSession, root: str, number: int) -> DataFrame:
    """All entries of a run in key order."""
    return read_runs(spark, root, [number]).select("k", "v").orderBy("k")
