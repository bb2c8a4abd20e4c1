"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java and Python classes for the ASCII white space that separates words.
WHITE = r" \t-\r"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir; on a local master, as in tests, a folder of our own will do."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
        at = tempfile.mkdtemp(prefix="lamina-shared-")
        atexit.register(shutil.rmtree, at, ignore_errors=True)
        spark.conf.set("spark.checkpoint.dir", at)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Hadoop's file system, wherever it lies."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


class Work:
    """Tables written to a folder of this run under the shared folder: lineage is cut there, and lost executors cost no recomputation."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.at = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._clear)

    def _clear(self) -> None:
        try:
            remove(self.spark, self.at)
        except Exception:  # the session may be gone by then
            shutil.rmtree(self.at.removeprefix("file://"), ignore_errors=True)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.at}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.at}/{name}")

    def forget(self) -> None:
        """After a step: what is written needs its shuffle files no more, and Spark removes them once the driver's garbage is collected."""
        gc.collect()
        self.spark._jvm.System.gc()

    def drop(self, name: str) -> None:
        remove(self.spark, f"{self.at}/{name}")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id as long and text, null as empty; other columns go, whatever their names."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def raw_texts(docs: DataFrame) -> DataFrame:
    """doc_id and the UTF-8 bytes of text, null as empty."""
    return texts(docs).select("doc_id", F.col("text").cast("binary").alias("text"))


def text_hash(docs: DataFrame) -> Column:
    """XXH64 of a row's text as raw_texts gives it."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")).cast("binary"))


#: Rows of a table with (__id, __th) and a number that may be broadcast: 24 MB of keys and values.
FEW_ROWS = 1_000_000


def row_join(docs: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    """docs with marks (__id, __th, ...; a written table) on a row's doc_id and the hash of its text; null doc_ids meet too.

    How many rows marks has is counted: up to FEW_ROWS are broadcast, so that no document moves; more are joined by a shuffle.
    """
    on = docs["doc_id"].cast("long").eqNullSafe(marks["__id"]) & (text_hash(docs) == marks["__th"])
    return docs.join(F.broadcast(marks) if marks.count() <= FEW_ROWS else marks, on, how)


def one_space(text: Column) -> Column:
    """Each run of ASCII white space as one space. Single spaces, most runs, are not matches and so cost nothing."""
    return F.regexp_replace(text, rf"[\t-\r][{WHITE}]*| [{WHITE}]+", " ")


def crc_mod(doc_id: Column, n: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % n
