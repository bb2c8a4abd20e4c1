"""Sharding by k-d tree partitioning, in DataFrame operations alone.

A node that stands for n shards is cut, along its widest metadata dimension, where n // 2 of n of its bytes lie below; so
leaves reach the target bytes. The weighted median is found by distributed histograms: each round sums the bytes of BINS
bins per node, map-side first, and looks closer into the bin that holds the cut. All nodes of a level share a round, and
what reaches the driver is a histogram, of a size that the data does not change.

The dimensions depend on the text alone, so equal texts fall together. A cut that would part a value is moved to its edge
if the bytes stay near enough; else it goes on along the text's checksum, so that whole texts stay together, and through a
group of equal texts, by doc_id, only where the group is too large for that.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Work, texts

OVERHEAD, BINS = 16, 2048
#: Bytes off the mark, as a share of a shard's target, that a cut may be: anywhere, and to keep equal texts together.
NEAR, WHOLE = 0.002, 0.02
TIES = ("text_crc32", "id_key")
DIMENSIONS = ("log_size", "chars_share", "text_crc32")


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32 and the dimensions, as long integers. A null text has no bytes."""
    rows = texts(docs)
    size, raw = F.octet_length("text"), F.col("text").cast("binary")
    return rows.select(
        "doc_id",
        (size + OVERHEAD).cast("long").alias("size"),
        F.crc32(raw).cast("long").alias("text_crc32"),
        F.floor(F.log(size + OVERHEAD) * 1e6).cast("long").alias("log_size"),
        F.floor(F.char_length("text") / F.greatest(size, F.lit(1)) * 1e6).cast("long").alias("chars_share"),
        F.coalesce("doc_id", F.lit(-1)).alias("id_key"),
    )


class _Node:
    """A node for the shards from first to last - 1; cut, once known: (column, value) pairs, rows at or below it go low."""

    def __init__(self, first: int, last: int):
        self.first, self.last, self.cut = first, last, None

    @property
    def mid(self) -> int:
        return self.first + (self.last - self.first) // 2


def _values(rows: list[list[int | None]]) -> str:
    """A table of as many rows as a level has nodes, as SQL text."""
    return ", ".join("(" + ", ".join("cast(null as bigint)" if v is None else f"{v}L" for v in r) + ")" for r in rows)


def _pairs(columns: list[str], pairs: list[tuple[str, int]], n: int) -> list[int | None]:
    return [x for name, v in pairs for x in (columns.index(name), v)] + [0, None] * (n - len(pairs))


class _Search:
    """One node's hunt for its cut: fixed holds the values that the cut shares so far, [lo, hi] what is left of the next."""

    def __init__(self, node: _Node, name: str, bounds: dict[str, tuple[int, int]], total: float):
        self.node, self.bounds, self.names, self.fixed, self.below = node, bounds, [name, *(x for x in TIES if x != name)], [], 0
        shards = node.last - node.first
        self.want, self.each = total * (shards // 2) / shards, total / shards
        self.lo, self.hi = bounds[name]

    @property
    def step(self) -> int:
        return max(1, -(-(self.hi - self.lo + 1) // BINS))

    def row(self, columns: list[str]) -> list[int | None]:
        """This hunt's row of the table that a round's rows are held against."""
        return [self.node.first, columns.index(self.names[len(self.fixed)]), self.lo, self.hi, self.step, *_pairs(columns, self.fixed, 2)]

    def narrow(self, bins: dict[int, tuple[int, int, int]]) -> bool:
        """Takes a histogram: a bin's bytes, least and largest value. True once the cut is set."""
        name, below = self.names[len(self.fixed)], self.below
        for _, (weight, lo, hi) in sorted(bins.items()):
            if below + weight >= self.want:
                break
            below += weight
        else:  # the cut lies at the end of what is left
            self.node.cut = [*self.fixed, (name, self.hi)]
            return True
        one = lo == hi
        deeper = one and len(self.fixed) + 1 < len(self.names)
        near = self.each * (WHOLE if deeper and name == "text_crc32" else NEAR)
        up, down = below + weight - self.want, self.want - below
        if one and not deeper or min(up, down) <= near:
            self.node.cut = [*self.fixed, (name, hi if up <= down else lo - 1)]
            return True
        self.below = below
        if deeper:
            self.fixed.append((name, lo))
            lo, hi = self.bounds[self.names[len(self.fixed)]]
        self.lo, self.hi = lo, hi
        return False


def _grow(work: Work, meta: DataFrame, shards: int, dims: tuple[str, ...]) -> DataFrame:
    """meta with the shard of each row as column node; every level is written, so no plan grows with the tree."""
    spark, names, spread = meta.sparkSession, [*dict.fromkeys([*dims, *TIES])], {}
    at, nodes, level = meta.withColumn("node", F.lit(0).cast("long")), [_Node(0, shards)], 0
    while open_ := [n for n in nodes if n.last - n.first > 1]:
        found = {r["node"]: r for r in at.groupBy("node").agg(F.sum("size").alias("total"), *[f(n).alias(f"{p}_{n}") for n in names for p, f in (("lo", F.min), ("hi", F.max))]).collect()}
        hunts = []
        for node in open_:
            r = found.get(node.first)
            bounds = {n: (r[f"lo_{n}"], r[f"hi_{n}"]) if r else (0, 0) for n in names}
            spread = spread or {d: max(1, bounds[d][1] - bounds[d][0]) for d in dims}
            widest = max(dims, key=lambda d: (bounds[d][1] - bounds[d][0]) / spread[d])
            hunts.append(_Search(node, widest, bounds, r["total"] if r else 0))
        keyed = at.select("node", "size", F.array(*names).alias("k"))
        while hunts:
            hunt = spark.sql(f"select * from values {_values([h.row(names) for h in hunts])} as t(node, c, lo, hi, step, c0, v0, c1, v1)")
            inside = F.expr("k[c] between lo and hi and (v0 is null or k[c0] = v0) and (v1 is null or k[c1] = v1)")
            near = keyed.join(F.broadcast(hunt), "node").filter(inside).withColumn("v", F.expr("k[c]"))  # a row a node, 40 or so
            bins: dict[int, dict] = {h.node.first: {} for h in hunts}
            for r in near.groupBy("node", F.expr("(v - lo) div step").alias("bin")).agg(F.sum("size").alias("bytes"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect():
                bins[r["node"]][r["bin"]] = (r["bytes"], r["lo"], r["hi"])
            hunts = [h for h in hunts if not h.narrow(bins[h.node.first])]
        cuts = spark.sql(f"select * from values {_values([[n.first, n.mid, *_pairs(names, n.cut, 3)] for n in open_])} as t(node, mid, c0, v0, c1, v1, c2, v2)")
        k = F.array(*names)
        low = lambda i, then: (k[F.col(f"c{i}")] < F.col(f"v{i}")) | ((k[F.col(f"c{i}")] == F.col(f"v{i}")) & then)
        below = low(0, F.col("v1").isNull() | low(1, F.col("v2").isNull() | low(2, F.lit(True))))
        moved = at.join(F.broadcast(cuts), "node", "left").select(*meta.columns, F.when(F.col("mid").isNull() | below, F.col("node")).otherwise(F.col("mid")).alias("node"))
        at = work.save(moved, f"level-{level}")
        if level:
            work.drop(f"level-{level - 1}")
        nodes = [x for n in nodes for x in ([n] if n.last - n.first < 2 else [_Node(n.first, n.mid), _Node(n.mid, n.last)])]
        level += 1
    return at


def kd_shards(docs: DataFrame, shards: int | None = None, target_bytes: int | None = None, dims: tuple[str, ...] = DIMENSIONS) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Either the number of shards is given, or target_bytes, which each leaf then holds about. Slots count from 0 without
    gaps in each shard, by doc_id within each of a shard's even parts. Null texts have the size of the overhead; null
    doc_ids and repeated rows are placed like others; an empty table gives no rows; other columns are ignored.
    """
    work = Work(docs.sparkSession, "kd-shards")
    meta = work.save(metadata(docs), "metadata")
    total, rows = meta.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    shards = shards or max(1, -(-total // target_bytes))
    placed = _grow(work, meta, shards, dims) if rows else meta.withColumn("node", F.lit(0))
    parts = max(16, rows // (shards * 500_000) + 1)  # so a task numbers half a million rows or so
    placed = placed.select("doc_id", "size", "text_crc32", F.col("node").cast("int").alias("shard"), F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(parts)).cast("int").alias("part"))
    counts = placed.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    nth = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size"))
    return placed.withColumn("nth", nth).join(F.broadcast(starts) if shards * parts <= 100_000 else starts, ["shard", "part"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("start") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
