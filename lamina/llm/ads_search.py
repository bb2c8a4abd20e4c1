"""Nearest neighbours by adaptive dimension scan.

Inner products become distances: with one more component that brings all vectors to one length, the nearest is the one of
largest inner product. Vectors are turned by a random rotation and dealt to the lists of a coarse quantiser. A probed list
is scanned in blocks of columns: after d of D columns, what a random rotation leaves of the distance is known up to a factor
1 + eps / sqrt(d), so candidates whose partial distance already speaks against them, given the query's current k-th best,
are abandoned. What survives is scored exactly, on the original vectors, and tightens the k-th best for what follows. How
many lists a query probes is read off the fit sample: as many as hold WANT of the sample's own nearest neighbours.

Equal vectors are one entry with its smallest ids: no more of them than a query can return matter. Lists are cut into
blocks of bounded size, and so are the queries that probe one, so neither a common vector nor a hot list meets in a task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Work

SAMPLE, MAX_LISTS, WANT, JUDGES, MIN_PROBES, BLOCK_ROWS, ASKS, SOME, COLUMNS, EPS, SEED, ROUNDS = 20_000, 4096, 0.97, 256, 16, 4096, 256, 512, 16, 2.1, 3, 12


def _kmeans(x: np.ndarray, lists: int, seed: int = SEED) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)].copy()
    for _ in range(ROUNDS):
        near = np.argmin((c**2).sum(1) - 2 * x @ c.T, axis=1)
        n = np.bincount(near, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def _probes(x: np.ndarray, asks: np.ndarray, centres: np.ndarray, k: int, want: float = WANT) -> int:
    """The lists that a query has to probe: so many that they hold want of the k nearest of the sample x (lifted), for some of its own vectors as queries (asks, lifted)."""
    far = lambda a, b: (b**2).sum(1) - 2 * a @ b.T
    step = max(1, len(asks) // JUDGES)
    chosen = np.arange(0, len(asks), step)[:JUDGES]
    at = np.concatenate([np.argmin(far(x[i : i + 4096], centres), axis=1) for i in range(0, len(x), 4096)])
    rank = np.argsort(np.argsort(far(asks[chosen], centres), axis=1, kind="stable"), axis=1)
    near = far(asks[chosen], x)
    near[np.arange(len(chosen)), chosen] = np.inf
    nearest = np.argsort(near, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    needed = np.sort(np.take_along_axis(rank, at[nearest], axis=1).ravel())
    return int(needed[min(len(needed) - 1, int(want * len(needed)))]) + 1 if len(needed) else len(centres)


def search(vectors: DataFrame, every: int = 20, k: int = 20, probe_share: float | None = None, eps: float = EPS, lists: int | None = None, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score: for each row whose id is divisible by every, the k rows of largest inner product found.

    Ties go to the smaller id; a query's own id is never its answer. Vectors that are null, zero, of another length than
    most (ties: the shorter), or that hold null or non-finite components take no part, as query or candidate; nor do null
    ids. Repeated rows (id and vector) count once; an id that stands by several vectors asks with each, and is an answer
    with its best score. An empty table gives no rows; other columns are ignored. The quantiser and, unless probe_share
    says which share of the lists to probe, the number of probes are fit on at most SAMPLE vectors; every vector is indexed.
    """
    spark = vectors.sparkSession
    work = Work(spark, "ads-search")
    e = F.col(vector_col).cast("array<double>")
    fine = F.forall(e, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(e, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), e.alias("e")).filter(F.col("id").isNotNull() & F.col("e").isNotNull() & fine)
    sizes = sorted(rows.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).collect(), key=lambda r: (-r["n"], r["d"]))
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not sizes:
        return empty
    dim = sizes[0]["d"]
    rows = rows.filter(F.size("e") == dim)
    asked = rows.filter(F.col("id") % every == 0).select("id", "e").distinct()
    # Of each vector its k + 1 smallest ids, cut before and after the shuffle; rows that repeat an id have one rank.
    nth = F.dense_rank().over(Window.partitionBy("e").orderBy("id"))
    few = rows.withColumn("nth", nth).filter(F.col("nth") <= k + 1).groupBy("e").agg(F.array_sort(F.collect_set("id")).alias("ids"))
    queries = rows.filter(F.col("id") % every == 0).groupBy("e").agg(F.lit(True).alias("asks"))
    entries = work.save(few.join(queries, "e", "left").select(F.monotonically_increasing_id().alias("g"), "e", "ids", F.coalesce("asks", F.lit(False)).alias("asks")), "entries")
    n, longest = entries.agg(F.count("*"), F.max(F.aggregate("e", F.lit(0.0), lambda a, v: a + v * v))).first()
    lists = lists or min(MAX_LISTS, max(1, round(math.sqrt(n))))
    sample = np.array([r["e"] for r in entries.orderBy(F.xxhash64("g"), "g").select("e").limit(SAMPLE).collect()])
    turn = np.linalg.qr(np.random.default_rng(SEED).normal(size=(dim + 1, dim + 1)))[0]

    def lift(x: np.ndarray, query: bool) -> np.ndarray:
        extra = np.zeros(len(x)) if query else np.sqrt(np.maximum(longest - (x**2).sum(1), 0))
        return np.hstack([x, extra[:, None]]) @ turn

    centres = _kmeans(lift(sample, False), lists)
    probes = math.ceil(probe_share * len(centres)) if probe_share else _probes(lift(sample, False), lift(sample, True), centres, k)
    probes = min(len(centres), max(MIN_PROBES, probes))
    shared = spark.sparkContext.broadcast(centres)  # at most MAX_LISTS rows

    def nearest(x: np.ndarray, m: int) -> np.ndarray:
        c = shared.value
        d = (c**2).sum(1) - 2 * x @ c.T
        return np.argsort(d, axis=1, kind="stable")[:, :m] if m < len(c) else np.argsort(d, axis=1, kind="stable")

    def stack(col: pa.Array) -> np.ndarray:
        return col.flatten().to_numpy(zero_copy_only=False).reshape(len(col), dim)

    def place(batches):
        for b in batches:
            if b.num_rows:
                at = nearest(lift(stack(b.column(1)), False), 1)[:, 0]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(at.astype(np.int32)), b.column(1), b.column(2)], names=["g", "list", "e", "ids"])

    placed = work.save(entries.select("g", "e", "ids").mapInArrow(place, "g long, list int, e array<double>, ids array<long>"), "placed")
    counts = {r["list"]: r["count"] for r in placed.groupBy("list").count().collect()}  # at most MAX_LISTS rows
    reach = np.array([counts.get(i, 0) for i in range(len(centres))])

    def probe(batches):
        for b in batches:
            if not b.num_rows:
                continue
            order = nearest(lift(stack(b.column(1)), True), len(reach))
            held = np.cumsum(reach[order], axis=1) - reach[order]
            take = (np.arange(len(reach)) < probes) | (held <= 4 * k)  # more lists where the first hold few
            q, j = np.nonzero(take)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(q)), b.column(1).take(pa.array(q)), pa.array(order[q, j].astype(np.int32)), pa.array((j == 0).astype(bool))], names=["g", "e", "list", "first"])

    probing = entries.filter("asks").select("g", "e").mapInArrow(probe, "g long, e array<double>, list int, first boolean")
    probing = work.save(probing, "probes")
    load = {r["list"]: r["count"] for r in probing.groupBy("list").count().collect()}
    plan = [(i, max(1, math.ceil(counts.get(i, 0) / BLOCK_ROWS)), max(1, math.ceil(load.get(i, 0) / BLOCK_ROWS))) for i in range(len(centres))]
    cuts = F.broadcast(spark.createDataFrame(plan, "list int, xs int, qs int"))  # at most MAX_LISTS rows
    blocks = placed.join(cuts, "list").withColumn("x", F.pmod(F.xxhash64("g"), "xs").cast("int")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
    asking = probing.join(cuts, "list").withColumn("q", F.pmod(F.xxhash64("g"), "qs").cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), F.col("xs") - 1)))
    bounds = [(i, min(i + COLUMNS, dim + 1)) for i in range(0, dim + 1, COLUMNS)]

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = [(np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))]
        if len(left) and len(right):
            x = np.vstack(right["e"])
            turned = lift(x, False)
            a, b = bounds[0]
            head = (turned[:, a:b] ** 2).sum(1)
            for at in range(0, len(left), ASKS):
                some = left.iloc[at : at + ASKS]
                gs, q = some["g"].to_numpy(), np.vstack(some["e"])
                now, worst = lift(q, True), some["worst"].to_numpy()
                own = (now[:, a:b] ** 2).sum(1)
                # The least of the k + 1 best scores so far, as a distance; none yet: any distance will do.
                tops, least = np.full((len(q), k + 1), -np.inf), np.where(np.isnan(worst), -np.inf, worst)
                base, held = (q * q).sum(1) + longest, []
                for m in range(0, len(x), SOME):
                    limit = base - 2 * least
                    part = own[:, None] + head[None, m : m + SOME] - 2 * now[:, a:b] @ turned[m : m + SOME, a:b].T
                    qi, xi = np.nonzero(part * ((dim + 1) / b) <= limit[:, None] * (1 + eps / math.sqrt(b) * (b <= dim)) ** 2 + 1e-9)
                    part = part[qi, xi]
                    xi += m
                    for c, d in bounds[1:]:
                        part += ((turned[xi, c:d] - now[qi, c:d]) ** 2).sum(1)
                        keep = part * ((dim + 1) / d) <= limit[qi] * (1 + eps / math.sqrt(d) * (d <= dim)) ** 2 + 1e-9
                        qi, xi, part = qi[keep], xi[keep], part[keep]
                    score = (x[xi] * q[qi]).sum(1)
                    held.append((qi, xi, score))
                    found = np.full((len(q), min(SOME, len(x) - m)), -np.inf)
                    found[qi, xi - m] = score
                    both = np.hstack([tops, found])
                    tops = np.partition(both, both.shape[1] - k - 1, axis=1)[:, -k - 1 :]
                    least = np.maximum(least, tops[:, 0])
                qi, xi, score = map(np.concatenate, zip(*held))
                keep = score >= least[qi]
                out.append((gs[qi[keep]], score[keep], xi[keep]))
        g, score, xi = map(np.concatenate, zip(*out))
        ids = right["ids"].to_numpy()
        return pd.DataFrame({"g": g, "score": score, "ids": pd.Series([ids[i] for i in xi], dtype=object)})

    keys, kind = ["list", "x", "q"], "g long, score double, ids array<long>"
    blocks = blocks.select(*keys, "e", "ids")

    def scanned(asks: DataFrame) -> DataFrame:
        return asks.select(*keys, "g", "e", "worst").groupBy(*keys).cogroup(blocks.groupBy(*keys)).applyInPandas(scan, kind)

    def best(found: DataFrame) -> DataFrame:
        each = found.select("g", "score", F.explode("ids").alias("id"))
        order = Window.partitionBy("g").orderBy(F.desc("score"), "id")
        return each.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1)

    start = work.save(scanned(asking.filter("first").withColumn("worst", F.lit(float("nan")))), "first")
    worst = best(start).groupBy("g").agg(F.when(F.count("*") > k, F.min("score")).otherwise(float("nan")).alias("worst"))
    # A first list without vectors gives no row in worst, so no limit.
    more = work.save(scanned(asking.filter("not first").join(worst, "g", "left")), "more")
    found = best(start.union(more)).select("g", "score", F.col("id").alias("vec_id"))
    mine = asked.join(entries.select("g", "e"), "e").select(F.col("id").alias("query_id"), "g")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    hits = mine.join(found, "g").filter("query_id <> vec_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return hits.select("query_id", "rank", "vec_id", "score")
