"""Near copies by SimHash and multi-index hashing: every pair of texts whose word shingles have a Jaccard similarity of least or
more, then one of each group. Texts of one set are one node.

A text's fingerprint has BITS bits: a bit is set if it is in over half of the salted hashes of the text's set of shingles. Two
sets of similarity 0.8 differ in 15 % of the bits, unlike ones in half. An index holds each fingerprint by many segments of a
few bits, drawn at random; nodes that agree in a segment meet, those that differ in FAR of BITS or more (by the first CHECKED)
part, and of the others the sets themselves are compared. No segment is sure to agree, so there are as many as make a pair of
similarity 0.8 miss all of them once in 10,000 by calculation (texts of eight or nine words more often: ties make their bits
less alike), and a more similar pair less often. Segments have more bits the more nodes there are, and are indexed STEP at a
time. Index entries cross the network once, packed and sorted by task, segment and range of values.

Pairs within a component that is known need no comparison. So each node is first compared with the NEAREST nodes that it meets,
by their bits, and then the pairs of different components are. Of a segment value that more than HOT nodes share, only nodes
side by side meet at first; then those of all components but its largest are held against all others by their bits, and only nodes
that have a close one of another component are a crowd. Of a crowd, too, those outside its largest component are compared
with all: blocks of about BLOCK nodes meet in tasks of their own, which compare the sets as matrices and return the edges of
a spanning forest. These comparisons grow with a crowd's size times the nodes that are not linked yet.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import FEW_ROWS, Work, raw_texts, row_join
from .components import components

SEED, BITS, FAR, CHECKED, MISS, STEP, HOT, BLOCK, COLUMNS, PACK, NEAREST = 42, 2048, 640, 256, 1e-4, 128, 32, 512, 8192, 1 << 16, 8
_SALT = np.random.default_rng(9).integers(0, 1 << 63, BITS // 64, np.uint64)
_MIX, _MORE = np.uint64(0xD6E8FEB86659FD93), np.uint64(0x9E3779B97F4A7C15)


def shingles(text: bytes, width: int) -> list[bytes]:
    """The XXH64 of each run of width words (of all words, if they are fewer), repeats included; no words give none."""
    words = text.lower().split()  # bytes: A to Z, and the six ASCII white spaces
    if not words:
        return []
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    last = min(width, len(words)) - 1
    return [digest(joined[s:e], SEED) for s, e in zip(starts[: len(words) - last].tolist(), ends[last:].tolist())]


def shingle_set(text: bytes, width: int) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(shingles(text, width)), np.uint64))


def _key(own: np.ndarray) -> int:
    return int(np.array(xxhash.xxh3_64_intdigest(own.tobytes()), np.uint64).view(np.int64))


def _ones(rows: np.ndarray) -> np.ndarray:
    """In how many rows (of 64-bit words, one at least) each bit is set, by carry-save addition of whole words."""
    out, k = np.zeros(rows.shape[1] * 64, np.int64), 0
    while len(rows):
        carry = []
        while len(rows) > 2:
            third = len(rows) // 3
            a, b, c = rows[:third], rows[third : 2 * third], rows[2 * third : 3 * third]
            carry.append((a & b) | ((a ^ b) & c))
            rows = np.concatenate((a ^ b ^ c, rows[3 * third :]))
        if len(rows) == 2:
            carry.append(rows[:1] & rows[1:])
            rows = rows[:1] ^ rows[1:]
        out += np.unpackbits(rows[0].view(np.uint8)).astype(np.int64) << k
        rows, k = np.concatenate(carry) if carry else rows[:0], k + 1
    return out


def fingerprint(own: np.ndarray) -> bytes:
    """A set's SimHash of BITS bits; the empty set has none."""
    ones = np.zeros(BITS, np.int64)
    for k in range(0, len(own), 2048):  # memory stays bounded for very long texts
        x = (own[k : k + 2048, None] ^ _SALT) * _MIX
        x ^= x >> np.uint64(32)
        x *= _MORE
        x ^= x >> np.uint64(29)
        ones += _ones(x)
    return np.packbits(2 * ones > len(own)).tobytes()


def segments(nodes: int) -> np.ndarray:
    """The places of the bits of each segment, a row each, for a table of so many nodes."""
    size, p = max(12, math.ceil(math.log2(max(nodes, 1))) + 4), math.acos(8 / 9) / math.pi
    d = np.arange(BITS // 2)
    logs = np.cumsum(np.log(np.arange(1, BITS + 1)))
    choose = logs[-1] - np.concatenate(([0], logs[: len(d) - 1])) - logs[BITS - 1 - d]
    chance = np.exp(choose + d * math.log(p) + (BITS - d) * math.log(1 - p))
    agree = np.prod([(BITS - d - i) / (BITS - i) for i in range(size)], axis=0)
    many = 64
    while (chance * (1 - agree) ** many).sum() > MISS:
        many += 8
    rng = np.random.default_rng(10)
    return np.array([rng.choice(BITS, size, replace=False) for _ in range(many)])


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, th (hash of the text), key (hash of the set), n (shingles in the set), print, for each row; null texts are empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, prints = [], [], []
            for t in batch.column(2):
                own = shingle_set(t.as_py(), width)
                keys.append(_key(own))
                sizes.append(len(own))
                prints.append(fingerprint(own))
            kinds = (pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, (keys, sizes, prints), kinds)], names=["doc_id", "th", "key", "n", "print"])

    keyed = raw_texts(docs).select("doc_id", F.xxhash64("text").alias("th"), "text")
    return keyed.mapInArrow(run, "doc_id long, th long, key long, n int, print binary")


def _numbered(work: Work, rows: DataFrame) -> DataFrame:
    """key, n, th, print, least (doc_id) and node, a number without gaps, of each distinct key."""
    each = rows.groupBy("key").agg(F.first("n").alias("n"), F.min("th").alias("th"), F.first("print").alias("print"), F.min("doc_id").alias("least"))
    placed = work.save(each.withColumn("place", F.monotonically_increasing_id()), "nodes")
    part, starts, total = F.shiftright("place", 33), [(-1, 0)], 0
    for r in placed.groupBy(part.alias("part")).count().orderBy("part").collect():
        starts.append((r["part"], total - (r["part"] << 33)))
        total += r["count"]
    if total >= 1 << 32:
        raise ValueError("index entries hold node numbers of 32 bits")
    shifts = rows.sparkSession.createDataFrame(starts, "part long, shift long")
    return placed.join(F.broadcast(shifts), part == F.col("part")).withColumn("node", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node and its set (sorted, as bytes), of wanted (node, distinct)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [shingle_set(t.as_py(), width) for t in batch.column(2)]
            same = pa.array([_key(s) == k for s, k in zip(own, batch.column(1).to_pylist())], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in own], pa.binary())], names=["node", "own"]).filter(same)

    some = nodes.join(wanted, "node", "left_semi").select("th", "node", "key")
    some = F.broadcast(some) if wanted.count() <= FEW_ROWS else some
    found = raw_texts(docs).select(F.xxhash64("text").alias("th"), "text").join(some, "th").select("node", "key", "text")
    return found.mapInArrow(run, "node long, own binary").groupBy("node").agg(F.first("own").alias("own"))


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) and j, the Jaccard similarity of their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            j = []
            for x, y in zip(batch.column(0), batch.column(1)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                j.append(both / max(len(x) + len(y) - both, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(j, pa.float64())], names=["a", "b", "j"])

    left, right = sets.toDF("a", "x"), sets.toDF("b", "y")
    joined = pairs.join(left, "a").join(right, "b").select("x", "y", "a", "b")
    return joined.mapInArrow(run, "a long, b long, j double")


def _shared(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of the left shares with each of the right."""
    x, y = np.concatenate([*left, np.zeros(0, np.uint64)]), np.concatenate([*right, np.zeros(0, np.uint64)])
    columns = np.intersect1d(x, y)
    out = np.zeros((len(left), len(right)), np.int64)
    if not len(columns):
        return out
    places = []
    for own, sets in ((x, left), (y, right)):
        rows = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(columns, own), len(columns) - 1)
        held = columns[at] == own
        order = np.argsort(at[held], kind="stable")
        places.append((rows[held][order], at[held][order]))
    for k in range(0, len(columns), COLUMNS):
        parts = []
        for (rows, at), n in zip(places, out.shape):
            to = slice(*np.searchsorted(at, [k, k + COLUMNS]))
            part = np.zeros((n, min(COLUMNS, len(columns) - k)), np.float32)
            part[rows[to], at[to] - k] = 1
            parts.append(part)
        out += np.rint(parts[0] @ parts[1].T).astype(np.int64)
    return out


def _forest(near: np.ndarray) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the graph of this boolean matrix, left to right."""
    seen, out = np.zeros(near.shape[0], bool), []
    fresh = np.ones(near.shape[1], bool)
    for first in range(near.shape[0]):
        todo = [] if seen[first] else [first]
        seen[first] = True
        while todo:
            i = todo.pop()
            for j in np.flatnonzero(near[i] & fresh).tolist():
                fresh[j] = False
                out.append((i, j))
                more = np.flatnonzero(near[:, j] & ~seen).tolist()
                seen[more] = True
                out += [(m, j) for m in more]
                todo += more
    return out


def _crowds(work: Work, hot: DataFrame, sets: DataFrame, least: float, block: int = BLOCK) -> DataFrame:
    """a, b: edges whose components, with root, are those of the pairs of similarity least or more among nodes that share a hot val (val, node, root)."""
    shared = hot.select("val", "root").distinct()
    joined = shared.join(hot.groupBy("val").agg(F.min("root").alias("b")), "val").select(F.col("root").alias("a"), "b").filter("a <> b").distinct()
    crowds = components(work, work.save(joined, "crowd-links")).toDF("root", "crowd")
    members = work.save(hot.select("node", "root").distinct().join(crowds, "root", "left").withColumn("crowd", F.coalesce("crowd", "root")), "crowds")
    sizes = members.groupBy("crowd", "root").agg(F.count("*").alias("size")).groupBy("crowd").agg(F.max(F.struct("size", "root")).alias("most"), F.sum("size").alias("size"))
    blocks = [F.ceil(x / block).cast("int").alias(n) for x, n in ((F.col("size") - F.col("most.size"), "lefts"), (F.col("size"), "rights"))]
    dealt = members.join(sizes.select("crowd", F.col("most.root").alias("most"), *blocks), "crowd")
    left, right = (F.pmod(F.xxhash64("node"), n).cast("int") for n in ("lefts", "rights"))
    few = dealt.filter("root <> most").select("node", "crowd", left.alias("i"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("j"), F.lit(True).alias("left"))
    meets = few.union(dealt.filter("lefts > 0").select("node", "crowd", F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"), right.alias("j"), F.lit(False).alias("left")))

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        sides = [group[group["left"]], group[~group["left"]]]
        (a, x), (b, y) = [(g["node"].to_numpy(), [np.frombuffer(s, np.uint64) for s in g["own"]]) for g in sides]
        if not len(a) or not len(b):
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        both = _shared(x, y)
        every = np.array([len(s) for s in x])[:, None] + np.array([len(s) for s in y]) - both
        edges = np.array(_forest(both / np.maximum(every, 1) >= least), np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": a[edges[:, 0]], "b": b[edges[:, 1]]})

    return meets.join(sets, "node").groupBy("crowd", "i", "j").applyInPandas(compare, "a long, b long").filter("a <> b")


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all elements, then the second ones, and so on: like ones side by side, for compression."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _whole(x: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(8, -1).T).view(np.uint64).ravel()


def _met(nodes: DataFrame, places: np.ndarray, first: int, many: int, hot: int, least: float) -> DataFrame:
    """a, b, val, for segments first and on of an index of many nodes (node, n, print): a > b are nodes that agree in a
    segment value and are not too unlike in n (val -1), or a is one of the more than hot nodes of val (b -1). Of so many only
    those side by side are pairs."""
    size = places.shape[1]
    high = max(0, math.ceil(math.log2(max(many, 1))) - 18)  # by its first bits a segment is cut into parts of about 262,144 entries
    low, apart = size - high, int(8 * math.log2(1 / max(least, 2**-31))) + 1

    def packed(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        node, n = (np.concatenate([h[k] for h in held]).astype(np.uint64) for k in (0, 1))
        tail = node << np.uint64(8) | np.floor(8 * np.log2(n)).astype(np.uint64)
        buckets, codes = [], []
        for k, val in enumerate(np.concatenate([h[2] for h in held], axis=1), first):
            part = (val >> np.uint64(low)).astype(np.uint16)
            order = np.argsort(part, kind="stable")
            code = ((val & np.uint64((1 << low) - 1)) << np.uint64(40) | tail)[order]
            cuts = np.searchsorted(part[order], np.arange((1 << high) + 1))
            for p in np.flatnonzero(np.diff(cuts)).tolist():
                buckets.append(k << high | p)
                codes.append(_planes(np.sort(code[cuts[p] : cuts[p + 1]])))
        return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int64()), pa.array(codes, pa.binary())], names=["bucket", "codes"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in (b.slice(k, 2048) for b in batches for k in range(0, b.num_rows, 2048)):
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, BITS // 8), axis=1).T.copy()
            val = np.zeros((len(places), batch.num_rows), np.uint64)
            for at in places.T:
                val <<= np.uint64(1)
                val |= bits[at]
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy(), val))
            rows += batch.num_rows
            if rows >= PACK:
                yield packed(held)
                held, rows = [], 0
        if held:
            yield packed(held)

    def meet(group: pd.DataFrame) -> pd.DataFrame:
        code = np.sort(np.concatenate([_whole(c) for c in group["codes"]]))
        val, node, n = code >> np.uint64(40), (code >> np.uint64(8) & np.uint64(0xFFFFFFFF)).astype(np.int64), (code & np.uint64(255)).astype(np.int16)
        starts = np.flatnonzero(np.concatenate(([True], val[1:] != val[:-1])))
        runs = np.diff(np.append(starts, len(val)))
        length = np.repeat(runs, runs)
        full = length > hot
        out = [(node[full], np.full(int(full.sum()), -1), (int(group["bucket"].iloc[0]) << low) + val[full].astype(np.int64))]
        for k in range(1, hot):
            at = np.flatnonzero((val[k:] == val[:-k]) & ~full[k:]) if k > 1 else np.flatnonzero(val[1:] == val[:-1])
            if not len(at):
                break
            at = at[np.abs(n[at + k] - n[at]) <= apart]
            out.append((node[at + k], node[at], np.full(len(at), -1)))
        return pd.DataFrame({x: np.concatenate([o[k] for o in out]) for k, x in enumerate("abv")}).rename(columns={"v": "val"})

    dealt = nodes.select("node", "n", "print").mapInArrow(deal, "bucket long, codes binary")
    return dealt.repartition(max(16, len(places) << high >> 3), "bucket").groupBy("bucket").applyInPandas(meet, "a long, b long, val long")


def _words(side: str = "") -> list[Column]:
    """The first CHECKED bits of print, as longs."""
    return [F.conv(F.hex(F.substring("print", 8 * k + 1, 8)), 16, -10).cast("long").alias(f"{side}p{k}") for k in range(CHECKED // 64)]


def _not_far(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose fingerprints and sizes are not too unlike for similarity least, and d, how many bits differ."""
    left, right = (nodes.select(F.col("node").alias(x), F.col("n").alias(f"{x}n"), *_words(x)) for x in "ab")
    differ = sum((F.bit_count(F.col(f"ap{k}").bitwiseXOR(F.col(f"bp{k}"))) for k in range(CHECKED // 64)), F.lit(0))
    alike = F.least("an", "bn") >= least * F.greatest("an", "bn")
    return pairs.join(left, "a").join(right, "b").filter(alike & (differ < FAR * CHECKED // BITS)).select("a", "b", differ.alias("d"))


def _open(full: DataFrame, roots: DataFrame, nodes: DataFrame) -> DataFrame:
    """val, node and root of full (val, node) that have, at their val, a node of another component whose fingerprint is not far."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        root, size = np.unique(group["root"].to_numpy(), return_inverse=True, return_counts=True)[1:]
        bits, found = group[[f"p{k}" for k in range(CHECKED // 64)]].to_numpy().view(np.uint64), np.zeros(len(group), bool)
        few = np.flatnonzero(root != np.argmax(size))
        step = max(1, (1 << 20) // len(group))
        for k in range(0, len(few), step):
            own = few[k : k + step]
            differ = sum(np.bitwise_count(bits[own, None, j] ^ bits[:, j]).astype(np.int16) for j in range(bits.shape[1]))
            near = (differ < FAR * CHECKED // BITS) & (root[own, None] != root)
            found[own] |= near.any(axis=1)
            found |= near.any(axis=0)
        return group.loc[found, ["val", "node", "root"]]

    named = full.join(roots, "node", "left").select("val", "node", F.coalesce("root", "node").alias("root"))
    several = named.groupBy("val").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x <> y").select("val")
    held = named.join(several, "val").join(nodes.select("node", *_words()), "node")
    return held.repartition(4 * held.sparkSession.sparkContext.defaultParallelism, "val").groupBy("val").applyInPandas(run, "val long, node long, root long")


def links(work: Work, docs: DataFrame, nodes: DataFrame, width: int, least: float, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """a, b: edges between nodes (node, key, n, th, print) whose components are those of the pairs of similarity least or more."""
    some = nodes.filter("n > 0")
    many, met = nodes.count(), None
    places = segments(many)
    for k in range(0, len(places), STEP):
        table = work.save(_met(some, places[k : k + STEP], k, many, hot, least), f"met-{k}")
        met = table if met is None else met.union(table)
        work.forget()
    pairs = work.save(_not_far(met.filter("val < 0").select("a", "b").distinct(), some, least), "pairs")
    full = met.filter("val >= 0").select("val", F.col("a").alias("node"))
    sides = pairs.select("a", "b", "d", F.explode(F.array("a", "b")).alias("node"))
    nearest = sides.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("d", "a", "b"))).filter(F.col("r") <= NEAREST)
    firsts = work.save(nearest.select("a", "b").distinct(), "firsts")
    sets = work.save(_sets(docs, nodes, sides.select("node").distinct(), width), "sets")
    near = work.save(_compared(firsts, sets).filter(F.col("j") >= least).select("a", "b"), "near-firsts")
    roots = work.save(components(work, near), "roots")
    left, right = roots.toDF("a", "ra"), roots.toDF("b", "rb")
    apart = pairs.join(left, "a", "left").join(right, "b", "left").filter(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b")
    apart = apart.join(firsts, ["a", "b"], "left_anti")
    edges = roots.toDF("a", "b").union(work.save(_compared(apart, sets).filter(F.col("j") >= least).select("a", "b"), "near"))
    if full.isEmpty():
        return edges
    roots = work.save(components(work, edges), "more-roots")
    still = work.save(_open(full, roots, some), "open")
    edges = roots.toDF("a", "b")
    if still.isEmpty():
        return edges
    return edges.union(_crowds(work, still, work.save(_sets(docs, nodes, still.select("node").distinct(), width), "open-sets"), least, block))


def near_copies(docs: DataFrame, width: int = 5, least: float = 0.8, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """One row per row of docs: doc_id, th (hash of the text), component_id.

    component_id is the smallest doc_id among documents that steps of similarity least or more link. Null and empty texts
    are alike, and like no other; null doc_ids take part, and are an id only where a component has no other. Repeated rows
    each return; no rows give none; other columns are ignored.
    """
    work = Work(docs.sparkSession, "near-copies")
    rows = work.save(sketches(docs, width), "sketches")
    nodes = _numbered(work, rows)
    roots = components(work, links(work, docs, nodes, width, least, hot, block))
    rooted = work.save(nodes.join(roots, "node", "left").select("key", "least", F.coalesce("root", "node").alias("root")), "rooted")
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("key", "component_id")
    return rows.select("doc_id", "th", "key").join(named, "key").select("doc_id", "th", "component_id")


def keep_one(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """docs with one document (the smallest doc_id) of each group of near copies; all columns stay, null doc_ids too."""
    gone = near_copies(docs, width, least).filter("doc_id <> component_id").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    return row_join(docs, Work(docs.sparkSession, "keep-one").save(gone, "gone"), "left_anti")
