"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

The statistics of every whole text are taken once. A Gaussian kernel over them is approximated by random Fourier features;
each partition sums its part of the normal equations, the sums are added, and the ridge weights solved. Scores become
probabilities by isotonic regression on labelled rows that the ridge fit did not see.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Work, crc_mod, raw_texts, row_join

FEATURES, RIDGE, SEED, GRID = 256, 1e-3, 7, 4096
_KIND = np.full(256, 5, np.uint8)  # 0 lower, 1 upper, 2 digit, 3 white, 4 ASCII mark, 5 other
for _chars, _k in ((b"abcdefghijklmnopqrstuvwxyz", 0), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 1), (b"0123456789", 2), (b" \t\n\r\f\v", 3), (b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~", 4)):
    _KIND[np.frombuffer(_chars, np.uint8)] = _k
MARKS = b"!#$%&*|<>{}.,:=/"
STATISTICS = 12 + len(MARKS) + 9


def statistics(text: bytes) -> np.ndarray:
    """Shares and logarithms of what a text holds; all zero but the constants for an empty one."""
    out = np.zeros(STATISTICS)
    n = len(text)
    raw = np.frombuffer(text, np.uint8)
    counts = np.bincount(raw, minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=6)
    words, lines = text.split(), text.split(b"\n")
    m = len(words)
    out[0:6] = np.sqrt(kinds / max(n, 1))
    out[6:12] = np.log1p(n), np.log1p(m), np.log1p(len(lines)), n / max(m, 1) / 10, kinds[1] / max(kinds[0] + kinds[1], 1), kinds[4] / max(m, 1)
    out[12 : 12 + len(MARKS)] = np.sqrt(counts[np.frombuffer(MARKS, np.uint8)] / max(m, 1))
    if m:
        seen, rows = Counter(words), Counter(lines)
        same = sum(a == b for a, b in zip(words, words[1:]))
        ends = Counter(w[-1] for w in words)
        marked = sum(c for e, c in ends.items() if _KIND[e] == 4)
        lone = sum(c for w, c in seen.items() if len(w) == 1 and _KIND[w[0]] == 4)
        p = np.fromiter(seen.values(), float, len(seen)) / m
        twice = sum(c for r, c in rows.items() if c > 1 and r)
        out[12 + len(MARKS) :] = same / m, len(seen) / m, -(p @ np.log(p)) / np.log(m + 1), p.max(), marked / m, lone / m, sum(map(bytes.isupper, words)) / m, twice / len(lines), len({e for e in ends if _KIND[e] == 4}) / 8
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, the statistics of each whole text (null: empty), and its hash th."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            stats = [statistics(t.as_py()).astype(np.float32) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(stats, pa.list_(pa.float32())), batch.column(2)], names=["doc_id", "stats", "th"])

    return raw_texts(docs).withColumn("th", F.xxhash64("text")).mapInArrow(run, "doc_id long, stats array<float>, th long")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


class Kernel:
    """Random Fourier features for a Gaussian kernel over standardised statistics."""

    def __init__(self, mean: np.ndarray, std: np.ndarray, features: int = FEATURES, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, 1 / np.where(std > 1e-9, std, 1)
        d = len(mean)
        self.w = rng.normal(size=(d, features)) / np.sqrt(2 * d)
        self.b = rng.uniform(0, 2 * np.pi, features)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) * self.scale, -8, 8)
        return np.hstack([np.cos(z @ self.w + self.b) * np.sqrt(2 / len(self.b)), z, np.ones((len(z), 1))])


def _sum_rows(df: DataFrame, part, width: int) -> np.ndarray:
    """Adds up, by row number, the matrices that part makes of each partition's batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                more = part(batch)
                total = more if total is None else total + more
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["k", "row"])

    def add(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [rows["k"].iloc[0]], "row": [np.sum(np.vstack(rows["row"]), axis=0)]})

    sums = df.mapInArrow(run, "k int, row array<double>").groupBy("k").applyInPandas(add, "k int, row array<double>").collect()
    out = np.zeros((max((r["k"] for r in sums), default=-1) + 1, width))
    for r in sums:
        out[r["k"]] = r["row"]
    return out


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators over x in rising order: the blocks' mean x and mean y, to interpolate between."""
    blocks: list[list[float]] = []
    for a, b, c in zip(x, y, w):
        blocks.append([a * c, b * c, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [p + q for p, q in zip(blocks[-1], last)]
    return np.array([b[0] / b[2] for b in blocks]), np.array([b[1] / b[2] for b in blocks])


def quality_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, out_fold: int = 1, features: int = FEATURES, ridge: float = RIDGE, keyed: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score (0 to 1), predicted, and the text's hash th if keyed.

    Labels of the held-out fold (crc32 of the doc_id's text mod folds) are never read. A tenth of the others calibrates,
    the rest fits. Null texts are empty texts, null labels and doc_ids without a document are left out, a label given
    twice counts twice; with no label at all every score is 0.5. A null doc_id is scored, and not held out. Repeated rows
    each return; an empty table gives no rows; other columns are ignored.
    """
    work = Work(docs.sparkSession, "quality")
    stats = work.save(document_statistics(docs), "statistics")
    out = F.coalesce(crc_mod(F.col("doc_id"), folds) == out_fold, F.lit(False))
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("y")).filter(F.col("y").isNotNull() & F.col("doc_id").isNotNull() & ~out)
    seen = work.save(stats.join(marks, "doc_id").withColumn("calibrates", F.pmod(F.xxhash64("doc_id"), F.lit(10)) == 0), "labelled")
    names = ["y", "calibrates", "stats"]

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = _matrix(batch.column(0))
        return np.vstack([x.sum(0), (x**2).sum(0), np.full(x.shape[1], len(x))])

    sums = _sum_rows(seen.select("stats"), moments, STATISTICS)
    if not len(sums):
        return stats.select("doc_id", out.alias("held_out"), F.lit(0.5).alias("score"), F.lit(1).alias("predicted"), *["th"] * keyed)
    mean = sums[0] / sums[2]
    kernel = Kernel(mean, np.sqrt(np.maximum(sums[1] / sums[2] - mean**2, 0)), features)
    width = features + STATISTICS + 1

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        phi, y = kernel(_matrix(batch.column(2))), batch.column(0).to_numpy()
        return np.vstack([phi.T @ phi, y @ phi])

    fit = seen.filter(~F.col("calibrates"))
    eq = _sum_rows((fit if not fit.isEmpty() else seen).select(*names), normal, width)
    weights = np.linalg.solve(eq[:-1] + ridge * max(eq[width - 1, width - 1], 1) * np.eye(width), eq[-1])

    def raw(x: np.ndarray) -> np.ndarray:
        return np.clip(kernel(x) @ weights, -1, 2)

    def binned(batch: pa.RecordBatch) -> np.ndarray:
        r, y = raw(_matrix(batch.column(2))), batch.column(0).to_numpy()
        k = np.rint((r + 1) / 3 * GRID).astype(int)
        return np.vstack([np.bincount(k, weights=v, minlength=GRID + 1) for v in (r, y, np.ones(len(r)))])

    held = seen.filter("calibrates")
    grid = _sum_rows((held if not held.isEmpty() else seen).select(*names), binned, GRID + 1)
    at = grid[2] > 0
    xs, ys = isotonic(grid[0, at] / grid[2, at], grid[1, at] / grid[2, at], grid[2, at])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                p = np.clip(np.interp(raw(_matrix(batch.column(1))), xs, ys), 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p), pa.array((p >= 0.5).astype(np.int32)), batch.column(2)], names=["doc_id", "score", "predicted", "th"])

    return stats.mapInArrow(score, "doc_id long, score double, predicted int, th long").select("doc_id", out.alias("held_out"), "score", "predicted", *["th"] * keyed)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows scored below one half; all columns stay. Rows of one doc_id, or of none, are judged each by its text."""
    bad = quality_scores(docs, labels, keyed=True).filter("predicted = 0").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th")).distinct()
    return row_join(docs, Work(docs.sparkSession, "keep-good").save(bad, "bad"), "left_anti")
