"""SimHash near-dedup by multi-index hashing.

Fingerprints within two bits of each other agree, in one of their two 32-bit segments, up to one bit. So each distinct
fingerprint enumerates the Hamming ball of radius one around either segment, fetches the fingerprints that the segment
table holds there, and the full distance is verified. Of two segments a bit apart one has that bit and the other has not;
only the one without it asks, which halves the ball.

A segment value that more than HOT fingerprints share would give pairs by the square. Its fingerprints, and those that ask
for it, are linked exactly in another way: two fingerprints are within two bits if and only if the radius-one balls around
the whole fingerprints meet, so each sends its 65 neighbours, and a neighbour met twice links those that sent it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work, raw_texts
from .components import components
from .near_copies import keep_one, shingles  # noqa: F401

BITS, HOT = 64, 32
LOW = 0xFFFFFFFF


def fingerprint(text: bytes, width: int) -> int:
    """A bit is set if it is in over half of the XXH64 of the text's word shingles, repeats included; no words give 0."""
    own = shingles(text, width)
    if not own:
        return 0
    n, ones = len(own), np.zeros(BITS, np.int64)
    bits = np.frombuffer(b"".join(own), np.uint8).reshape(n, 8)
    for k in range(0, n, 16384):  # memory stays bounded for very long texts
        part = np.unpackbits(bits[k : k + 16384], axis=1)
        full = len(part) // 255 * 255
        ones += part[:full].reshape(-1, 255, BITS).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64) + part[full:].sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, fp (signed long) for each row; null texts are empty, whole texts are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return raw_texts(docs).mapInArrow(run, "doc_id long, fp long")


def _segments(fp: Column) -> Column:
    low, high = fp.bitwiseAND(F.lit(LOW)), F.shiftrightunsigned(fp, 32)
    return F.array(F.struct(F.lit(0).alias("seg"), low.alias("val")), F.struct(F.lit(1).alias("seg"), high.alias("val")))


def _bits(n: int) -> Column:
    return F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)).cast("long") for k in range(n)])


def links(work: Work, fps: DataFrame, radius: int = 2, hot: int = HOT) -> DataFrame:
    """a, b: edges whose components are those of distinct fingerprints at most radius (0 to 2) bits apart.

    Cold table entries give verified pairs; hot ones give each member's link to the least one that shares a neighbour.
    """
    if not 0 <= radius <= 2:
        raise ValueError("the balls of radius one hold for distances up to two")
    if radius == 0:
        return fps.sparkSession.createDataFrame([], "a long, b long")
    table = fps.select("fp", F.explode(_segments(F.col("fp"))).alias("s")).select("fp", "s.seg", "s.val")
    ball = F.concat(F.array(F.lit(0).cast("long")), F.filter(_bits(32), lambda m: F.col("val").bitwiseAND(m) == 0))
    asks = table.select("fp", "seg", F.explode(F.transform(ball, lambda m: F.col("val").bitwiseOR(m))).alias("val"))
    crowded = work.save(table.groupBy("seg", "val").agg(F.count("*").alias("n")).filter(F.col("n") > hot).select("seg", "val"), "crowded")
    held = table if (calm := crowded.isEmpty()) else table.join(crowded, ["seg", "val"], "left_anti")
    apart = F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= radius
    pairs = asks.join(held.withColumnRenamed("fp", "other"), ["seg", "val"]).filter((F.col("fp") != F.col("other")) & apart)
    edges = pairs.select(F.greatest("fp", "other").alias("a"), F.least("fp", "other").alias("b"))
    if calm:
        return edges.distinct()
    members = asks.join(crowded, ["seg", "val"], "left_semi").select("fp").distinct()
    if radius == 2:
        around = F.transform(F.concat(F.array(F.lit(0).cast("long")), _bits(64)), lambda m: F.col("fp").bitwiseXOR(m))
        met = work.save(members.select("fp", F.explode(around).alias("key")).groupBy("key").agg(F.min("fp").alias("b"), F.max("fp").alias("c"), F.count("*").alias("n")).filter("b < c"), "met")
        # Those that met at a key are all within two bits of each other: each is linked with the least of them.
        sent = members.select("fp", F.explode(around).alias("key")).join(met.select("key", "b"), "key").select(F.col("fp").alias("a"), "b").filter("a <> b")
    else:
        flipped = F.transform(F.filter(_bits(64), lambda m: F.col("fp").bitwiseAND(m) == 0), lambda m: F.col("fp").bitwiseOR(m))
        sent = members.select("fp", F.explode(flipped).alias("key")).join(members.select(F.col("fp").alias("key")), "key").select(F.col("fp").alias("a"), F.col("key").alias("b"))
    return edges.union(sent.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))).distinct()


def near_groups(docs: DataFrame, width: int = 5, radius: int = 2, hot: int = HOT) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id.

    component_id is the smallest doc_id among documents whose fingerprints are linked, at most radius bits a step. Null
    and empty texts have fingerprint zero, linked like any other; null doc_ids take part, and are an id only where a
    component has no other. Repeated rows each return; no rows give none; other columns are ignored.
    """
    work = Work(docs.sparkSession, "simhash")
    rows = work.save(fingerprints(docs, width), "fingerprints")
    distinct = work.save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(work, links(work, distinct.select("fp"), radius, hot))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    rooted = work.save(rooted, "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
