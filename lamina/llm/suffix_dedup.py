"""Repeated passages by a logarithmic family of (sampled) suffix arrays.

A passage counts if WINDOW bytes of it start anywhere else too. A suffix array over every byte would take over ten times
the disk of the input, so suffixes are sampled by content: each window of WINDOW bytes stands by its anchor, the GRAM
leading bytes of least hash that begin in it. Equal windows have equal anchors at the same place, so no repeat is lost.
Windows that follow one another and share an anchor form a run; the suffix that begins at the anchor stands for them.

Documents come in batches. A batch's suffixes, ordered by their leading GRAM bytes, are its suffix array, a level of size
one. The array is scanned, then merge-scanned with each level, in the order of the bytes: neighbours that share GRAM bytes
are suffixes that a long match may hold. Levels of equal size merge, so an entry is rewritten a logarithmic number of times.

Among suffixes alike, those whose runs have one digest (128 bits of the whole stretch, the anchor's place included) lie
side by side: such a run is a repeat throughout. Of the others, at the ends of passages, the bytes are fetched, and each
window is looked up among the windows of the runs that begin alike, one run of each digest: a group of runs after the
other, or, where more than CROWD different runs begin alike, window by window through the cluster.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, raw_texts

WINDOW, GRAM, BATCHES, BLOCK, CROWD = 400, 64, 2, 1 << 19, 50_000
_RNG = np.random.default_rng(20)
_BYTE = _RNG.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_MIX = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The base's powers and their inverses modulo 2 ** 64, n at least."""
    size = 1 << max(14, (n - 1).bit_length())
    if size not in _powers:
        inverse = np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        base = np.full(size, _BASE, np.uint64)
        base[0] = inverse[0] = 1
        _powers[size] = np.multiply.accumulate(base), np.multiply.accumulate(inverse)
    return _powers[size]


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    up, down = _power(len(raw) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[raw] * up[: len(raw)])))
    h = (sums[gram:] - sums[:-gram]) * down[: len(raw) - gram + 1]
    h ^= h >> np.uint64(32)
    h *= _MIX
    h ^= h >> np.uint64(29)
    return h


def runs(text: bytes, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first and last window start of each run of windows that share an anchor."""
    anchors, firsts, lasts = [], [], []
    raw, mask = np.frombuffer(text, np.uint8), np.uint64((1 << 21) - 1)
    for at in range(0, len(raw) - window + 1, block):
        part = raw[at : at + block + window - 1]
        h = _gram_hashes(part, gram)
        low = (h & ~mask) | np.arange(len(h), dtype=np.uint64)
        size, want = 1, window - gram + 1
        while 2 * size <= want:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < want:
            low = np.minimum(low[: len(low) - (want - size)], low[want - size :])
        anchor = (low & mask).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(anchor[1:] != anchor[:-1]) + 1))
        anchors.append(anchor[first] + at)
        firsts.append(first + at)
        lasts.append(np.concatenate((first[1:] - 1, [len(anchor) - 1])) + at)
    if not anchors:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(anchors), np.concatenate(firsts), np.concatenate(lasts)


ENTRY = "p binary, d1 long, d2 long, doc_id long, th long, pos int, first int, last int"
ALIKE = "ph long, doc_id long, th long, pos int, first int, last int, whole boolean, lead boolean"


def suffixes(keyed: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """An entry for each run of keyed (doc_id, th, text): p (the suffix's leading bytes), d1, d2 (digest of the run), doc_id, th, pos (of the anchor), first, last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lead, digests, rows = [], [], ([], [], [], [])
            for i, t in enumerate(batch.column(2)):
                text = t.as_py()
                pos, first, last = runs(text, window, gram)
                if len(pos):
                    places = list(zip(pos.tolist(), first.tolist(), last.tolist()))
                    lead += [text[p : p + gram] for p, _, _ in places]
                    digests += [xxhash.xxh3_128_digest(text[a : b + window], seed=p - a) for p, a, b in places]
                    for to, x in zip(rows, (np.full(len(pos), i), pos, first, last)):
                        to.append(x)
            if lead:
                i, pos, first, last = map(np.concatenate, rows)
                own, d = pa.array(i), np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(lead, pa.binary()), pa.array(d[:, 0]), pa.array(d[:, 1]), batch.column(0).take(own), batch.column(1).take(own), *(pa.array(x.astype(np.int32)) for x in (pos, first, last))], names=["p", "d1", "d2", "doc_id", "th", "pos", "first", "last"])

    return keyed.select("doc_id", "th", "text").mapInArrow(run, ENTRY)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of entries in the order of p and digest, those whose neighbour has the same p: ph (hash of p), their places, whether
    a neighbour has the same digest too (whole), and whether they are the first of their digest (lead).

    The first and last entry of a part always pass, for the part beside it may go on. A task may read several parts.
    """

    def next_to(column: pa.Array, how=pc.equal) -> np.ndarray:
        n = len(column)
        same = how(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False).astype(bool)
        return np.concatenate(([False], same, [False]))

    def out(rows: pa.RecordBatch, pick: np.ndarray, whole: np.ndarray, lead: np.ndarray) -> pa.RecordBatch:
        own = rows.filter(pa.array(pick))
        ph = np.array([xxhash.xxh3_64_intdigest(p) for p in own.column(0).to_pylist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array(ph), *own.columns[3:8], pa.array(whole[pick]), pa.array(lead[pick])], names=["ph", *own.schema.names[3:8], "whole", "lead"])

    held, before = None, (True, False, True)  # whether the held entry is alike, whole, first of its digest, seen from what precedes
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        edge = next_to(rows.column(8), pc.not_equal) | next_to(rows.column(0), pc.less)
        p = next_to(rows.column(0)) & ~edge
        d = p & next_to(rows.column(1)) & next_to(rows.column(2))
        alike, whole, lead = p[:-1] | p[1:] | edge[:-1] | edge[1:], d[:-1] | d[1:], ~d[:-1]
        alike[0] |= before[0]
        whole[0] |= before[1]
        lead[0] = before[2]
        pick = alike.copy()
        pick[-1] = False
        yield out(rows, pick, whole, lead)
        held, before = rows.slice(rows.num_rows - 1), (bool(alike[-1]), bool(whole[-1]), bool(lead[-1]))
    if held is not None:
        yield out(held, np.ones(1, bool), np.array([before[1]]), np.array([before[2]]))


class SuffixIndex:
    """Suffix arrays in levels whose sizes (in batches) are powers of two, the largest first; each batch is inserted once."""

    def __init__(self, work: Work, window: int = WINDOW, gram: int = GRAM):
        self.work, self.window, self.gram = work, window, gram
        self.levels: list[tuple[int, str, DataFrame]] = []
        self.made = 0

    def _name(self, kind: str) -> str:
        self.made += 1
        return f"{kind}-{self.made}"

    @staticmethod
    def _ordered(entries: DataFrame) -> DataFrame:
        """In the order of the suffixes' bytes, dealt by ranges; digest, th and first split the range of a p that many share."""
        key = ["p", "d1", "d2", "th", "first"]
        return entries.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("part", F.spark_partition_id())

    def _array(self, entries: DataFrame) -> tuple[str, DataFrame]:
        name = self._name("level")
        return name, self.work.save(self._ordered(entries), name)

    def _alike(self, ordered: DataFrame) -> DataFrame:
        return self.work.save(ordered.mapInArrow(_scan, ALIKE), self._name("alike"))

    def insert(self, keyed: DataFrame) -> DataFrame:
        """Adds a batch (doc_id, th, text); returns the entries, of it and of the levels, that begin like another one.

        An entry may return again after a later batch. A part's edges may let a few entries pass that are like no other.
        """
        raw = self._name("suffixes")
        entries = self.work.save(suffixes(keyed, self.window, self.gram), raw)
        name, array = self._array(entries)
        self.work.drop(raw)
        found, size, below = [], 1, list(self.levels)
        while below and below[-1][0] == size:  # levels of equal size merge, and the merged array is scanned as it is written
            _, old, level = below.pop()
            merged, both = self._array(array.unionByName(level).drop("part"))
            found.append(self._alike(both))
            self.work.drop(name)
            self.work.drop(old)
            self.work.forget()
            name, array, size = merged, both, 2 * size
        for _, _, level in below:  # larger levels stay as they are
            found.append(self._alike(self._ordered(array.unionByName(level).drop("part"))))
        if not found:
            found.append(self._alike(array))
        self.levels = [*below, (size, name, array)]
        alike = found[0]
        for more in found[1:]:
            alike = alike.unionByName(more)
        self.work.forget()
        return alike


REGION = "ph long, own binary, at int, n int, doc_id long, th long, first int, last int"


def _regions(joined: DataFrame, window: int) -> DataFrame:
    """The bytes (own) of the runs to be compared, with ph, at (the anchor's place in own), n (2: the whole run occurs twice), doc_id, th, first, last."""
    kinds = (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
    names = [c.split()[0] for c in REGION.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, th, t, todo in zip(*(batch.column(k) for k in range(4))):
                text, i, th = t.as_py(), i.as_py(), th.as_py()
                for r in todo.as_py():
                    rows.append((r["ph"], text[r["first"] : r["last"] + window], r["pos"] - r["first"], 1 + r["whole"], i, th, r["first"], r["last"]))
                if len(rows) > 5000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows), kinds)], names=names)

    return joined.select("doc_id", "th", "text", "todo").mapInArrow(run, REGION)


def _repeated(rows: list[dict], window: int) -> Iterator[tuple]:
    """doc_id, th, first, last of the repeated windows of the runs that occur once, among runs that begin alike.

    Equal windows hold the anchor at the same place: place by place, those that lie there are counted.
    """
    for a in range(min(r["at"] - (r["last"] - r["first"]) for r in rows), max(r["at"] for r in rows) + 1):
        here = [r for r in rows if 0 <= r["at"] - a <= r["last"] - r["first"]]
        if len(here) < 2:
            continue
        own = [r["own"][r["at"] - a : r["at"] - a + window] for r in here]
        places: dict[bytes, int] = {}
        for r, w in zip(here, own):
            places[w] = places.get(w, 0) + r["n"]
        for r, w in zip(here, own):
            if r["n"] == 1 and places[w] > 1:
                yield r["doc_id"], r["th"], r["first"] + r["at"] - a, r["first"] + r["at"] - a


def _compared(kinds: DataFrame, window: int) -> DataFrame:
    """Repeated windows, group by group of equal ph: rows come sorted by it, and one group at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(found: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*found)) or [[]] * 4
            types = (pa.int64(), pa.int64(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, types)], names=["doc_id", "th", "first", "last"])

        held, found, p = [], [], None
        for batch in batches:
            for r in batch.to_pylist():
                if r["ph"] != p:
                    if len(held) > 1:
                        found += _repeated(held, window)
                    held, p = [], r["ph"]
                if not held or any(r[c] != held[-1][c] for c in ("doc_id", "th", "first")):  # rows that repeat a doc_id and text send their runs again
                    held.append(r)
            if len(found) > 50_000:
                yield out(found)
                found = []
        if len(held) > 1:
            found += _repeated(held, window)
        yield out(found)

    return kinds.mapInArrow(run, "doc_id long, th long, first int, last int")


def _windows(kinds: DataFrame, window: int) -> DataFrame:
    """A row for each window of kinds: w (its bytes), x (the anchor's place in it), n, doc_id, th, start."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in (row for k in range(batch.num_rows) for row in batch.slice(k, 1).to_pylist()):
                many = range(r["last"] - r["first"] + 1)
                cols = [[r["own"][k : k + window] for k in many], [r["at"] - k for k in many], [r["n"]] * len(many), [r["doc_id"]] * len(many), [r["th"]] * len(many), [r["first"] + k for k in many]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32()))], names=["w", "x", "n", "doc_id", "th", "start"])

    return kinds.mapInArrow(run, "w binary, x int, n int, doc_id long, th long, start int")


def repeats(work: Work, keyed: DataFrame, alike: DataFrame, window: int = WINDOW, crowd: int = CROWD) -> DataFrame:
    """doc_id, th, first, last: the repeated window starts among the runs of entries found alike.

    Rows that repeat a doc_id and text (of one th) are one place here: whoever asks adds them.
    """
    place = ["doc_id", "th", "first", "last"]
    # What one scan says of an entry, or of one of two rows of a doc_id and text, holds.
    seen = work.save(alike.groupBy("ph", "pos", *place).agg(F.max("whole").alias("whole"), F.max("lead").alias("lead")), "seen")
    whole = seen.filter("whole").select(*place)
    open_ = seen.filter("lead").groupBy("ph").agg(F.min("whole").alias("closed"), F.count("*").alias("m")).filter("not closed and m > 1").select("ph", (F.col("m") > crowd).alias("crowded"))
    open_ = work.save(open_, "open")  # read anew, so that the join deals both sides and can split a hot one
    todo = seen.filter("lead").join(open_, "ph", "left_semi").groupBy("doc_id", "th").agg(F.collect_list(F.struct("ph", "pos", "first", "last", F.col("whole").cast("int").alias("whole"))).alias("todo"))
    todo = work.save(todo, "todo")
    work.forget()
    joined = keyed.join(todo, _same(keyed, todo)).select(keyed["doc_id"], keyed["th"], "text", "todo")
    regions = work.save(_regions(joined, window), "regions")
    work.forget()
    order = ["ph", "th", "first", "doc_id"]
    if open_.filter("crowded").isEmpty():
        return whole.union(_compared(regions.repartition("ph").sortWithinPartitions(*order), window))
    marked = regions.join(open_, "ph")
    edge = _compared(marked.filter("not crowded").drop("crowded").repartition("ph").sortWithinPartitions(*order), window)
    parts = work.save(_windows(marked.filter("crowded").drop("crowded").distinct(), window), "windows")
    again = parts.groupBy("w", "x").agg(F.sum("n").alias("places")).filter("places > 1").select("w", "x")
    return whole.union(edge).union(parts.filter("n = 1").join(again, ["w", "x"], "left_semi").select("doc_id", "th", F.col("start").alias("first"), F.col("start").alias("last")))


def _same(a: DataFrame, b: DataFrame):
    return (a["th"] == b["th"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def spans(first: np.ndarray, last: np.ndarray, window: int) -> list[tuple[int, int]]:
    """The maximal runs of bytes that windows starting from first to last cover."""
    out: list[list[int]] = []
    for k in np.argsort(first, kind="stable").tolist():
        a, b = int(first[k]), int(last[k]) + window
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, batches: int = BATCHES, text: bool = False, crowd: int = CROWD) -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept (bytes left), has_repeat, and the kept bytes if asked for.

    Every byte goes that a string of window bytes covers which starts anywhere else too, in this document or another;
    windows may overlap, and are judged on the input. Null texts are empty, texts shorter than a window lose nothing.
    Rows that repeat a doc_id and text are places of their own, and so lose all if a window fits in. Null doc_ids are allowed; an empty table gives no rows;
    other columns are ignored. The documents enter the index in as many batches as asked for, dealt by their texts' hash.
    """
    work = Work(docs.sparkSession, "suffix-dedup")
    keyed = raw_texts(docs).select("doc_id", F.xxhash64("text").alias("th"), "text")
    index, alike = SuffixIndex(work, window, gram), None
    for b in range(batches):
        more = index.insert(keyed.filter(F.pmod(F.xxhash64("th"), F.lit(batches)) == b))
        alike = more if alike is None else alike.unionByName(more)
    for _, name, _ in index.levels:
        work.drop(name)
    places = repeats(work, keyed, alike, window, crowd)
    twice = keyed.select("doc_id", "th", F.octet_length("text").alias("size")).groupBy("doc_id", "th").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    twice = twice.filter((F.col("n") > 1) & (F.col("size") >= window)).select("doc_id", "th", F.lit(0).alias("first"), (F.col("size") - window).alias("last"))
    cut = work.save(places.union(twice).groupBy("doc_id", "th").agg(F.collect_set(F.struct("first", "last")).alias("cuts")), "cuts")
    work.forget()

    def finish(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_:
            rows: list[list] = [[], [], [], [], [], [], []]
            for t, cuts in zip(batch.column(1), batch.column(2)):
                raw, kept, at, gone, n = t.as_py(), [], 0, 0, 0
                if cuts.is_valid:
                    f = cuts.values
                    for a, b in spans(f.field("first").to_numpy(), f.field("last").to_numpy(), window):
                        kept.append(raw[at:a])
                        at, gone, n = b, gone + b - a, n + 1
                kept.append(raw[at:])
                left = b"".join(kept)
                for to, x in zip(rows, (len(raw), gone, n, hashlib.sha256(left).hexdigest(), len(left), gone > 0, left if text else None)):
                    to.append(x)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip(rows, kinds))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_kept", "has_repeat", "kept"])

    joined = keyed.join(cut, _same(keyed, cut), "left").select(keyed["doc_id"], "text", "cuts")
    done = joined.mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_kept long, has_repeat boolean, kept binary")
    return done if text else done.drop("kept")
