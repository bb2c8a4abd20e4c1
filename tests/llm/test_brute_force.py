"""The shards' tree, the quality scores and the pipeline's stages against plain programs over all rows."""

import hashlib
import math
import random
import zlib

import numpy as np
import tiktoken
import xxhash
from pyspark.sql import functions as F
from test_near_copies import parts

import corpus_pipeline
import public_tokenizers
from lamina.llm import bpe, kd_shards, mixing, quality

SF = "/root/testdata/sf0.001"


def spark_hash(*values):
    """XXH64 as Spark chains it over columns, signed; nulls are passed over."""
    h = 42
    for v in values:
        if v is not None:
            h = xxhash.xxh64_intdigest(v if isinstance(v, bytes) else (v & (1 << 64) - 1).to_bytes(8, "little"), h)
    return h - (1 << 64) if h >> 63 else h


def test_shards_are_a_tree_of_weighted_medians(spark):
    rnd = random.Random(8)
    rows = [(i, "".join(rnd.choice("abcé中") for _ in range(rnd.randrange(1, 900)))) for i in range(1500)] + [(2000 + i, rnd.choice("xyz") * 40) for i in range(60)]
    shard = {r["doc_id"]: r["shard"] for r in kd_shards.kd_shards(spark.createDataFrame(rows, "doc_id long, text string"), 9).collect()}
    of = {}
    for i, t in rows:
        raw = t.encode()
        of[i] = {"size": len(raw) + 16, "log_size": math.floor(math.log(len(raw) + 16) * 1e6), "chars_share": math.floor(len(t) / len(raw) * 1e6), "text_crc32": zlib.crc32(raw), "id_key": i}
    width = lambda ids, d: max(of[i][d] for i in ids) - min(of[i][d] for i in ids)

    def check(first, last):
        ids = [i for i in shard if first <= shard[i] < last]
        if last - first < 2:
            return
        widest = max(kd_shards.DIMENSIONS, key=lambda d: width(ids, d) / width(shard, d))
        key = lambda i: tuple(of[i][c] for c in (widest, *(c for c in kd_shards.TIES if c != widest)))
        mid, total = first + (last - first) // 2, sum(of[i]["size"] for i in ids)
        low = [i for i in ids if shard[i] < mid]
        assert max(map(key, low)) < min(key(i) for i in ids if shard[i] >= mid)
        want = total * (mid - first) / (last - first)
        slack = max(kd_shards.WHOLE * total / (last - first), max(of[i]["size"] for i in ids))
        assert abs(sum(of[i]["size"] for i in low) - want) <= slack
        check(first, mid)
        check(mid, last)

    check(0, 9)


def rising(x, y, w):
    """Isotonic regression by its definition: the greatest, over starts, of the least mean of stretches that hold a place."""
    n = len(y)
    sums, weights = np.append(0, np.cumsum(y * w)), np.append(0, np.cumsum(w))
    mean = lambda a, b: (sums[b] - sums[a]) / (weights[b] - weights[a])
    fit = np.array([max(min(mean(a, b) for b in range(i + 1, n + 1)) for a in range(i + 1)) for i in range(n)])
    block = np.append(0, np.cumsum(np.diff(fit) > 1e-12))
    return np.array([np.average(x[block == k], weights=w[block == k]) for k in range(block[-1] + 1)]), np.array([fit[block == k][0] for k in range(block[-1] + 1)])


def test_quality_is_the_dense_fit(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    rows = docs.collect()
    stats = {r["doc_id"]: quality.statistics((r["text"] or "").encode()).astype(np.float32).astype(float) for r in rows}
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    seen = [(i, float(q)) for i, q in labels.select("doc_id", "quality").collect() if q is not None and i in stats and not held(i)]
    x, y = np.array([stats[i] for i, _ in seen]), np.array([q for _, q in seen])
    late = np.array([spark_hash(i) % 10 == 0 for i, _ in seen])
    assert late.any() and not late.all()
    kernel = quality.Kernel(x.mean(0), x.std(0))
    phi = kernel(x[~late])
    weights = np.linalg.solve(phi.T @ phi + quality.RIDGE * len(phi) * np.eye(phi.shape[1]), phi.T @ y[~late])
    raw = lambda s: np.clip(kernel(np.atleast_2d(s)) @ weights, -1, 2)
    r = raw(x[late])
    cell = np.rint((r + 1) / 3 * quality.GRID)
    cells = np.unique(cell)
    xs, ys = rising(*(np.array([f(cell == c) for c in cells]) for f in (lambda at: r[at].mean(), lambda at: y[late][at].mean(), lambda at: float(at.sum()))))
    want = {i: float(np.clip(np.interp(raw(s)[0], xs, ys), 0, 1)) for i, s in stats.items()}
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == len(rows)
    for g in got:
        assert g["held_out"] == held(g["doc_id"]) and abs(g["score"] - want[g["doc_id"]]) < 1e-5
    kept = {r["doc_id"] for r in corpus_pipeline.quality(spark, docs, SF).select("doc_id").collect()}
    assert kept == {g["doc_id"] for g in got if g["score"] >= 0.5}


def test_stages_keep_what_plain_programs_keep(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    least, roots = {}, parts(rows)
    for (i, _), g in zip(rows, roots):
        least[g] = min(i, least.get(g, i))
    kept = corpus_pipeline.near(spark, docs, SF).select("doc_id").collect()
    assert sorted(r["doc_id"] for r in kept) == sorted(least.values()) and len(kept) < len(rows)

    marks = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean").alias("domain"))
    want = []
    for r in mixing.mixing_rates(docs, marks, corpus_pipeline.TARGETS, budget="clean", keyed=True).collect():
        part = spark_hash(b"mix", r["doc_id"], r["th"]) % (1 << 30) / (1 << 30)
        want += [r["doc_id"]] * max(int(r["rate"] + part), int(r["posteriors"][0] >= mixing.SURE))
    assert sorted(r["doc_id"] for r in corpus_pipeline.mixing(spark, docs, SF).select("doc_id").collect()) == sorted(want)

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    plain = tiktoken.Encoding("plain", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    told = []
    for i, t in rows:
        ids = plain.encode_ordinary(t or "")
        told.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, corpus_pipeline.tokens(spark, docs, SF).select(*names).collect())) == sorted(told)
