"""Mixing sources to target weights with soft membership.

A classifier, fit on a table of labelled documents, predicts how far each document belongs to each domain. Nonnegative
rates per document then minimise the squares of what the domains' expected tokens miss their targets by (as a share of
what each has), and, lightly, of how far rates move from one, by projected gradient. At the minimum a document's rate is
max(0, 1 - posteriors . residuals / pull): it depends on one number a domain. So the descent goes over those numbers (a
gradient step projected on nonnegative rates is a step for them): a round sums a few numbers per partition and sends back
that many, and no state needs to be kept for a document. It goes on until the residuals that the rates leave are those the rates came from; what the totals then miss of their targets stands in the result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Work, row_join, texts
from .quality import STATISTICS, statistics

SAMPLE, WORDS, TELLING, STEPS, ROUNDS, PULL, STILL, SURE = 8_000, 64, 20.0, 1000, 40, 1e-3, 1e-6, 0.9


def _words(text: bytes) -> list[bytes]:
    return re.findall(rb"(?:[a-z]|[\x80-\xff])+", text.lower())


def _features(text: bytes, index: dict[bytes, int], of: np.ndarray, domains: int) -> tuple[int, np.ndarray]:
    """Tokens; statistics, how often each telling word occurs, and how often those of each domain do, as logarithms."""
    counts = np.zeros(len(index))
    hits = [k for w in _words(text) if (k := index.get(w)) is not None]
    if hits:
        np.add.at(counts, hits, 1)
    return len(text.split()), np.concatenate([statistics(text), np.log1p(counts), np.log1p(np.bincount(of, weights=counts, minlength=domains))])


def _telling_words(sample: DataFrame, domains: list[str], words: int) -> dict[bytes, int]:
    """For each domain, the words that occur more in it and tell most of it by the chi-square statistic; counted in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w, d = [], []
            for t, domain in zip(b.column(0), b.column(1)):
                own = set(_words(t.as_py()))
                w += own
                d += [domain.as_py()] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.binary()), pa.array(d, pa.string())], names=["w", "d"])

    n = {r["domain"]: r["count"] for r in sample.groupBy("domain").count().collect()}
    total = sum(n.values())
    each = [F.sum(F.when(F.col("d") == d, 1).otherwise(0)).alias(f"n{k}") for k, d in enumerate(domains)]
    counts = sample.select("text", "domain").mapInArrow(run, "w binary, d string").groupBy("w").agg(F.count("*").alias("n"), *each).filter("n >= 5")
    out: dict[bytes, int] = {}
    for k, d in enumerate(domains):
        a, b = F.col(f"n{k}"), F.col("n")
        miss = (a * total - b * n.get(d, 0)).cast("double")
        chi = miss * miss / (b * (total - b + 1.0) * max(1, n.get(d, 0)) * max(1, total - n.get(d, 0)))
        for r in counts.filter((miss > 0) & (chi * total >= TELLING)).orderBy(F.desc(chi), "w").limit(words).collect():
            out.setdefault(bytes(r["w"]), k)
    return out


class Softmax:
    """Multinomial logistic regression over standardised features, by accelerated gradient descent."""

    def __init__(self, x: np.ndarray, y: np.ndarray, domains: int, steps: int = STEPS, ridge: float = 1e-5):
        self.mean, std = x.mean(0), x.std(0)
        self.scale = 1 / np.where(std > 1e-9, std, 1)
        z, hot = self._z(x), np.eye(domains)[y]
        w = v = np.zeros((z.shape[1], domains))
        step = 2 / max(np.linalg.norm(z.T @ z / len(z), 2), 1e-9)
        for k in range(steps):
            p = self._soft(z @ v)
            was, w = w, v - step * (z.T @ (p - hot) / len(z) + ridge * v)
            v = w + k / (k + 3) * (w - was)
        self.w = w

    def _z(self, x: np.ndarray) -> np.ndarray:
        return np.hstack([np.clip((x - self.mean) * self.scale, -8, 8), np.ones((len(x), 1))])

    @staticmethod
    def _soft(a: np.ndarray) -> np.ndarray:
        a = np.exp(a - a.max(1, keepdims=True))
        return a / a.sum(1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._soft(self._z(x) @ self.w)


def posteriors(docs: DataFrame, labelled: DataFrame, domains: list[str], sample: int = SAMPLE, words: int = WORDS) -> DataFrame:
    """doc_id, n_tokens, p (array, in the order of domains), th (hash of the text). labelled: doc_id, domain; at most sample of its rows fit the model.

    Null texts are empty. Labels that are null, of no document or of another domain are left out; without any, every
    domain is as likely. Rows in, rows out, repeated and null doc_ids too.
    """
    base = texts(docs).select("doc_id", F.col("text").cast("binary").alias("text")).withColumn("th", F.xxhash64("text"))
    marks = labelled.filter(F.col("domain").isin(domains)).select(F.col("doc_id").cast("long").alias("doc_id"), "domain")
    chosen = marks.orderBy(F.xxhash64("doc_id"), "doc_id", "domain").limit(sample)
    work = Work(docs.sparkSession, "posteriors")
    chosen = work.save(chosen, "chosen")  # sample rows at most: a broadcast of bounded size, so no text is shuffled to find them
    fit = work.save(base.join(F.broadcast(chosen), "doc_id").select("text", "domain"), "sample")
    if fit.isEmpty():
        even = F.array(*[F.lit(1 / len(domains)) for _ in domains])
        n = F.size(F.filter(F.split(F.col("text").cast("string"), r"[ \t-\r]+"), lambda w: w != "")).cast("long")
        return base.select("doc_id", n.alias("n_tokens"), even.alias("p"), "th")
    telling = _telling_words(fit, domains, words)
    index, of = {w: k for k, w in enumerate(telling)}, np.array(list(telling.values()), np.int64)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = [_features(t.as_py(), index, of, len(domains))[1].astype(np.float32) for t in b.column(0)]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(x, pa.list_(pa.float32()))], names=["domain", "x"])

    rows = fit.mapInArrow(vectors, "domain string, x array<float>").toArrow()
    x = np.vstack([c.flatten().to_numpy().reshape(len(c), -1) for c in rows["x"].chunks if len(c)]).astype(np.float64)
    model = Softmax(x, np.array([domains.index(d) for d in rows["domain"].to_pylist()]), len(domains))

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for k in range(0, b.num_rows, 1000):
                part = b.slice(k, 1000)
                n, x = zip(*[_features(t.as_py(), index, of, len(domains)) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(list(model(np.array(x))), pa.list_(pa.float64())), part.column(2)], names=["doc_id", "n_tokens", "p", "th"])

    return base.mapInArrow(predict, "doc_id long, n_tokens long, p array<double>, th long")


def rates_from(p: np.ndarray, g: np.ndarray, pull: float = PULL) -> np.ndarray:
    """The best rates of documents with posteriors p if g is what their domains miss."""
    return np.maximum(0, 1 - p @ g / pull)


def settle(totals, has: np.ndarray, aim: np.ndarray, pull: float = PULL, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, float]:
    """g whose rates leave the residuals g, what those rates achieve, and how far from g the residuals still are.

    totals(g): expected tokens of each domain, and their derivatives by g, at rates_from(p, g). The problem's dual is
    concave in g with a known curvature: Newton steps, halved until the dual doesn't fall, settle in a few rounds.
    """
    scale = np.maximum(has, 1e-9)
    live = has > 0
    g = np.zeros(len(has))
    now, slope, value = totals(g)
    miss = np.inf
    for _ in range(rounds):
        lack = np.where(live, (now - aim) / scale - g, 0)
        miss = float(np.abs(lack).max())
        if miss <= STILL:
            break
        step = np.linalg.solve(np.eye(len(g)) - np.where(live[:, None], slope / scale[:, None], 0), lack)
        # The dual's value: to be raised. Its gradient is scale * lack.
        dual = lambda v, x: v - aim @ x - 0.5 * scale @ x**2
        was, size = dual(value, g), 1.0
        while True:
            there = totals(g + size * step)
            if dual(there[2], g + size * step) >= was - 1e-12 * abs(was) or size < 1e-6:
                break
            size /= 2
        g, (now, slope, value) = g + size * step, there
    return g, now, miss


def mixing_rates(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float | str | None = None, pull: float = PULL, keyed: bool = False) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, posteriors (in the order of targets), rate (0 or more), missed (what the
    rates' expected tokens miss of each domain's aim, as a share of the aims' sum), and the text's hash th if keyed.

    targets: the weight of each domain. budget: the expected tokens of the mix; a domain's name stands for the budget at
    which that domain's target is what it has, None for as many tokens as there are. Empty texts have no tokens and the
    rate that their posteriors give; a domain without tokens can't be raised and is left alone. Where the posteriors don't
    allow the targets, the rates are those of the least squares, and missed is not zero. An empty table gives no rows;
    other columns are ignored.
    """
    domains = list(targets)
    work = Work(docs.sparkSession, "mixing")
    known = work.save(posteriors(docs, labelled, domains), "posteriors")
    m = len(domains)

    def totals(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(m + m * m + 1)
            for b in batches:
                if b.num_rows:
                    p, n = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1), b.column(0).to_numpy()
                    r = rates_from(p, g, pull)
                    some = p * (n * (r > 0))[:, None]
                    out += np.concatenate([(n * r) @ p, -(some.T @ p).ravel() / pull, [n @ ((p @ g) * r + 0.5 * pull * (r - 1) ** 2)]])
            yield pa.RecordBatch.from_arrays([pa.array(range(len(out)), pa.int32()), pa.array(out)], names=["k", "s"])

        got = {r["k"]: r["s"] for r in known.select("n_tokens", "p").mapInArrow(run, "k int, s double").groupBy("k").agg(F.sum("s").alias("s")).collect()}
        out = np.array([got.get(k, 0.0) for k in range(m + m * m + 1)])
        return out[:m], out[m:-1].reshape(m, m), float(out[-1])

    has = totals(np.zeros(m))[0]
    share = np.array([targets[d] for d in domains]) / sum(targets.values())
    if isinstance(budget, str):
        budget = has[domains.index(budget)] / share[domains.index(budget)]
    aim = share * (has.sum() if budget is None else budget)
    g, now, left = settle(totals, has, aim, pull) if has.sum() else (np.zeros(m), has, 0.0)
    if left > 1e-3:
        raise RuntimeError(f"the rates did not settle: residuals differ by {left:g}")
    missed = F.array(*[F.lit(float(x)) for x in (now - aim) / max(aim.sum(), 1e-9)])

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                r = rates_from(b.column(2).flatten().to_numpy().reshape(b.num_rows, -1), g, pull)
                yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(r), b.column(3)], names=["doc_id", "n_tokens", "posteriors", "rate", "th"])

    rated = known.mapInArrow(rate, "doc_id long, n_tokens long, posteriors array<double>, rate double, th long")
    shown = rated.withColumn("missed", missed)
    return shown if keyed else shown.drop("th")


def copies(rate: Column, least: Column | int = 0, *key: Column) -> Column:
    """A rate as whole copies, least at least. The fraction is the share of keys (by their hash) that get one copy more."""
    part = F.pmod(F.xxhash64(F.lit("mix"), *key), F.lit(1 << 30)) / (1 << 30)
    return F.greatest(F.floor(rate + part).cast("int"), F.lit(least) if isinstance(least, int) else least)


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], budget: float | str | None = None) -> DataFrame:
    """docs with each row as many times as its rate says, fractions by chance of the row's hash; all columns stay.

    Rows of one doc_id, or of none, are rated each by its text. Where budget names a domain, which is to keep what it has,
    the rows that belong to it by SURE or more stay once at least.
    """
    least = F.lit(0) if not isinstance(budget, str) else (F.element_at("posteriors", list(targets).index(budget) + 1) >= SURE).cast("int")
    key = [F.col("doc_id").alias("__id"), F.col("th").alias("__th")]
    number = copies(F.col("rate"), least, F.col("doc_id"), F.col("th"))
    rates = mixing_rates(docs, labelled, targets, budget, keyed=True).groupBy(*key).agg(F.max(number).alias("__n")).filter("__n <> 1")
    joined = row_join(docs, Work(docs.sparkSession, "mix").save(rates, "copies"), "left").withColumn("__n", F.coalesce("__n", F.lit(1))).filter("__n > 0")
    return joined.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("__n")))).drop("__id", "__th", "__n", "__k")
