"""Each operator against a brute-force version, on documents with nulls, empty and long texts, ties, repeats and clashing names."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from lamina.llm import ads_search, bpe, brown_lm, exact_dedup, kd_shards, license_scan, mixing, quality, simhash, suffix_dedup

SCHEMA = "doc_id long, text string, h long, row int, recipe string, k string, node int, tail string"


def make(seed=1, n=120):
    rnd = random.Random(seed)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(1, 8))) for _ in range(300)]
    texts = [" ".join(rnd.choice(vocab) for _ in range(rnd.randrange(1, 400))) for _ in range(n)]
    shared = " ".join(rnd.choice(vocab) for _ in range(150))
    rows = [(i, t) for i, t in enumerate(texts)]
    rows += [(200 + i, texts[3].replace(" ", "\n\t", 2) if i % 2 else texts[3]) for i in range(6)]
    rows += [(300 + i, f"{texts[i][:200]} {shared} {texts[i][-100:]}") for i in range(5)]
    rows += [(400, None), (401, ""), (402, " \n"), (403, "one"), (404, "Ünïcode Wörds 中文 🙂 ok"), (None, "no id"), (None, None), (7, texts[7]), (500, " ".join(texts[:60])), (501, "ab " * 5000)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return make()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, 2, "r", "k", 3, "t") for i, t in rows], SCHEMA).repartition(5)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def sort(rows):
    return sorted(map(tuple, rows), key=str)


def test_exact_groups(docs, rows, none):
    norm = [(i, re.sub(r"[\x20\x09-\x0d]+", " ", t or "")) for i, t in rows]
    groups = collections.defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    keep = {t: min((i for i in ids if i is not None), default=None) for t, ids in groups.items()}
    want = [(i, keep[t], len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm]
    for digest in (F.xxhash64, lambda c: F.pmod(F.xxhash64(c), F.lit(3))):
        out = exact_dedup.exact_groups(docs, digest=digest).collect()
        assert sort((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in out) == sort(want)
        kept = [r for r in out if r["kept"]]
        assert len(kept) == len(groups) and all(r["doc_id"] == r["keep_id"] for r in kept)
    assert exact_dedup.keep_first(docs).count() == len(groups) and exact_dedup.keep_first(docs).columns == docs.columns
    assert exact_dedup.exact_groups(none).count() == 0 == exact_dedup.keep_first(none).count()


def slow_fingerprint(text, width):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + width]), 42) for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_near_groups(docs, rows, none):
    fps = [(i, slow_fingerprint(t, 3)) for i, t in rows]
    root = {f: f for _, f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in root:
        for b in root:
            if (a ^ b).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    want = sort((i, f"{f:016x}", least.get(find(f))) for i, f in fps)
    for hot in (32, 0):
        assert sort(simhash.near_groups(docs, 3, hot=hot).collect()) == want
    assert simhash.near_groups(none).count() == 0
    assert simhash.keep_one(docs).columns == docs.columns


def test_links_of_crowded_segments(spark):
    rnd = random.Random(3)
    base = [rnd.getrandbits(64) for _ in range(4)]
    fps = set(base)
    for _ in range(300):
        f = rnd.choice(list(fps))
        for b in rnd.sample(range(64), rnd.choice([1, 2, 3])):
            f ^= 1 << b
        fps.add(f)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")

    def parts(edges):
        root = {f: f for f in signed}

        def find(f):
            while root[f] != f:
                f = root[f]
            return f

        for a, b in edges:
            root[find(a)] = find(b)
        return {f: find(f) for f in signed}

    def same(x, y):
        return len(set(zip(x.values(), y.values()))) == len(set(x.values())) == len(set(y.values()))

    for radius in (1, 2):
        true = parts([(a, b) for a in signed for b in signed if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= radius])
        for hot in (0, 3, 1000):
            assert same(true, parts(map(tuple, simhash.links(simhash.Work(spark, "t"), df, radius, hot).collect()))), (radius, hot)


def test_bpe(docs, rows, none):
    import public_tokenizers as P
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rnd = random.Random(2)
    bits = ["  ", "\n", " ", "'", "re", "'ll", "'s", "the", "ing", "1", "é", "ß", "中", "!", "***", "\t", " ", "\x1d", "²", "🙂", "abcabcabcabcabcabcabcabcabc", "STRENGTH", "-" * 90]
    odd = ["".join(rnd.choice(bits) for _ in range(rnd.randrange(80))) for _ in range(500)]
    for chars, leaf in ((1, 1), (5, 3), (2048, 24)):
        b = bpe.Bpe(ranks, P.PATTERN, chars, leaf)
        for t in odd:
            code = b.encode(t)
            assert code == np.array(enc.encode_ordinary(t), "<u4").tobytes() and b.decode(code) == t.encode()
    import time

    b, start = bpe.Bpe(ranks, P.PATTERN), time.perf_counter()
    for t in ("-" * 20_001, "x" * 50_001, " " * 30_000 + "y", "ab" * 100_000, "é" * 9_999, "".join(rnd.choice("abcdefgh") for _ in range(60_000))):
        assert b.encode(t) == np.array(enc.encode_ordinary(t), "<u4").tobytes()
    assert time.perf_counter() - start < 20
    want = []
    for i, t in rows:
        ids = enc.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sort(bpe.encode_decode(docs, path, P.PATTERN).collect()) == sort(want)
    assert bpe.encode_decode(none, path, P.PATTERN).count() == 0


def test_remove_repeats(docs, rows, none):
    window = 60
    enc = [(i, (t or "").encode()) for i, t in rows]
    seen = collections.Counter(b[s : s + window] for _, b in enc for s in range(len(b) - window + 1))
    want = []
    for i, b in enc:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - window + 1):
            if seen[b[s : s + window]] > 1:
                gone[s : s + window] = True
        edges = np.diff(np.concatenate(([0], gone.astype(int))))
        want.append((i, len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest(), int((~gone).sum()), bool(gone.any())))
    for crowd, batches in ((50_000, 5), (2, 1)):
        assert sort(suffix_dedup.remove_repeats(docs, window, 16, batches, crowd=crowd).collect()) == sort(want)
    assert suffix_dedup.remove_repeats(none).count() == 0


def test_scan_of_parts_read_in_any_order():
    import pyarrow as pa

    names = ["p", "d1", "d2", "doc_id", "th", "pos", "first", "last", "part"]
    rows = [(b"c", 1, 1, 5, 0, 0, 0, 0, 1), (b"d", 1, 1, 6, 0, 0, 0, 0, 1), (b"e", 1, 1, 7, 0, 0, 0, 0, 1), (b"a", 1, 1, 1, 0, 0, 0, 0, 0), (b"b", 1, 1, 2, 0, 0, 0, 0, 0), (b"b", 2, 1, 3, 0, 0, 0, 0, 0), (b"b", 2, 1, 9, 0, 0, 0, 0, 0), (b"c", 1, 1, 4, 0, 0, 0, 0, 0)]
    for size in (1, 3, 8):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows[k : k + size])], names=names) for k in range(0, len(rows), size)]
        out = [r for b in suffix_dedup._scan(iter(batches)) for r in b.to_pylist()]
        assert [r["doc_id"] for r in out] == [5, 7, 1, 2, 3, 9, 4]
        assert [r["whole"] for r in out] == [False] * 4 + [True] * 1 + [True, False] and [r["lead"] for r in out] == [True] * 5 + [False, True]


def test_runs_cover_every_window_once():
    text = bytes(random.Random(4).choices(b"abc", k=5000))
    for block in (1 << 19, 700):
        _, first, last = suffix_dedup.runs(text, 50, 8, block)
        assert [s for a, b in zip(first, last) for s in range(a, b + 1)] == list(range(len(text) - 49))


def test_lm_scores(docs, rows, none):
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    out_of = lambda i: i is not None and zlib.crc32(str(i).encode()) % 10 == 0
    c = collections.Counter(w for i, t in rows if not out_of(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    want = sort((i, out_of(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in tok(t)), 4)) for i, t in rows)
    for head, swapped in ((100_000, 8192), (100_000, 40), (50, 30), (0, 30)):
        scored, lexicon = brown_lm.brown_lm(docs, head=head, classes=12, shapes=2, swapped=swapped)
        out = scored.collect()
        assert sort((*r[:5], round(r["base_score"], 4)) for r in out) == want
        # The class model's score by its definition, from the classes that the model gave the words.
        of = {bytes(r["w"]): (r["c"], r["class"]) for r in lexicon.collect()}
        assert {w: k for w, (k, _) in of.items()} == {w: k for w, k in c.items() if w is not None}
        assert all(g == brown_lm.shape(w, 12, 2) for w, (k, g) in of.items() if k == 1) and all(0 < g < 12 for _, g in of.values())
        kind = lambda w: 0 if w is None else of[w][1] if w in of else brown_lm.shape(w, 12, 2)
        moves, size, types = np.zeros((12, 12)), np.zeros(12), np.zeros(12)
        for i, t in rows:
            if not out_of(i):
                seq = [0, *map(kind, tok(t))]
                np.add.at(moves, (seq[:-1], seq[1:]), 1)
        for w, m in c.items():
            size[kind(w)] += m
            types[kind(w)] += 1
        prior = (moves.sum(0) + 1) / (moves.sum() + 12)

        def score(t):
            p, at = 0.0, 0
            for w in tok(t):
                g = kind(w)
                p += math.log10((moves[at, g] + brown_lm.PRIOR * prior[g]) / (moves[at].sum() + brown_lm.PRIOR))
                p += math.log10((c[w] + 0.1) / (size[g] + 0.1 * (types[g] + 1)))
                at = g
            return p

        assert sort((str(r["doc_id"]), round(r["score"], 4)) for r in out) == sort((str(i), round(score(t), 4)) for i, t in rows)
    assert brown_lm.lm_scores(none).count() == 0


def test_exchange_finds_the_classes_and_no_single_move_is_better(spark):
    rng = np.random.default_rng(1)
    words, classes = 40, 5
    kind = rng.integers(0, 3, words)
    follow = (kind + 1) % 3
    pairs = rng.poisson(np.where(follow[:, None] == kind[None], 40, 1)).astype(int)
    rows = [(a, b, True, int(pairs[a, b])) for a in range(words) for b in range(words) if pairs[a, b]]
    rows += [(b, a, False, n) for a, b, _, n in rows] + [(a, words, True, 1) for a in range(words)] + [(a, words, False, 1) for a in range(words)]
    table = spark.createDataFrame([(w, 2 * o + after, n) for w, o, after, n in rows], "w int, x int, n long").repartition(3, "w").sortWithinPartitions("w")
    of, n = brown_lm.exchange(brown_lm.Work(spark, "t"), table, words, classes, 1, 30)
    whole = np.ones((words + 1, words + 1))
    whole[:words, :words], whole[words, words] = pairs, 0
    hot = np.eye(classes)[of]
    assert (n == hot.T @ whole @ hot).all() and of[-1] == 0 and set(of[:-1]) <= {1, 2, 3}
    assert len(set(zip(kind, of))) == 3
    for u in range(words):
        for k in (1, 2, 3):
            moved = of.copy()
            moved[u] = k
            assert brown_lm.likelihood(np.eye(classes)[moved].T @ whole @ np.eye(classes)[moved]) <= brown_lm.likelihood(n) + 1e-6


def test_kd_shards(docs, rows, none):
    for shards in (1, 7):
        out = kd_shards.kd_shards(docs, shards).collect()
        assert sort((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == sort((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t in rows)
        by = collections.defaultdict(list)
        for r in out:
            by[r["shard"]].append(r)
            assert r["law"] == "bytes" and r["grown_shard"] is None
        assert set(by) <= set(range(shards)) and all(sorted(r["slot"] for r in g) == list(range(len(g))) for g in by.values())
    assert kd_shards.kd_shards(none, 4).count() == 0


def test_kd_shards_are_even_and_cut_hot_groups(spark):
    rows = [(i, "same text over and over " * 5) for i in range(600)] + [(1000 + i, "x" * random.Random(i).randrange(1, 300)) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = [r["s"] for r in kd_shards.kd_shards(df, 8).groupBy("shard").agg(F.sum("size").alias("s")).collect()]
    assert len(sizes) == 8 and max(sizes) < 1.05 * min(sizes)
    assert kd_shards.kd_shards(df, target_bytes=sum(sizes) // 4).select("shard").distinct().count() in (4, 5)


def test_quality(spark, none):
    rnd = random.Random(6)
    good = [" ".join("".join(rnd.choice("abcdefghijklmnop") for _ in range(rnd.randrange(2, 9))) for _ in range(rnd.randrange(20, 200))).capitalize() + "." for _ in range(300)]
    rows = [(i, t if i % 3 else " ".join(w.upper() + "!!" for w in t.split())) for i, t in enumerate(good)] + [(900, None), (901, ""), (None, "words")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0) if i % 7 else None) for i in range(300)] + [(None, 1), (12345, 0)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality.quality_scores(df, labels).collect()}
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in out.values())
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(out[i]["held_out"] == (i in held) for i in range(300))
    assert np.mean([out[i]["predicted"] == (i % 3 > 0) for i in held]) > 0.95
    other = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert sort(quality.quality_scores(df, other).collect()) == sort(out.values())
    assert quality.quality_scores(none, labels).count() == 0
    assert {r["score"] for r in quality.quality_scores(df, labels.limit(0)).collect()} == {0.5}


def test_isotonic_is_the_least_squares_rise():
    x, y = np.arange(6.0), np.array([0, 1, 0, 1, 0.5, 1])
    bx, by = quality.isotonic(x, y, np.ones(6))
    assert list(by) == [0, 0.5, 0.75, 1] and list(bx) == [0, 1.5, 3.5, 5]


def test_mixing(spark, none):
    rnd = random.Random(8)
    words = lambda v, n: " ".join(rnd.choice(v) for _ in range(n))
    plain, bad = [f"w{chr(97 + i)}" for i in range(26)], ["awful", "nasty"]
    rows = [(i, words(plain, 60) + (" " + words(bad, 4) if i % 4 == 0 else "")) for i in range(400)] + [(700, None), (701, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, "bad" if i % 4 == 0 else "fine") for i in range(0, 400, 2)] + [(3, None), (999, "bad")], "doc_id long, domain string")
    out = mixing.mixing_rates(df, marks, {"fine": 0.95, "bad": 0.05}).collect()
    assert len(out) == len(rows) and all(r["rate"] >= 0 and abs(sum(r["posteriors"]) - 1) < 1e-9 for r in out)
    got = sum(r["n_tokens"] * r["rate"] * np.array(r["posteriors"]) for r in out)
    total = sum(r["n_tokens"] for r in out)
    assert np.allclose(got / total, [0.95, 0.05], atol=1e-3)
    assert all(r["n_tokens"] == len((dict(rows)[r["doc_id"]] or "").split()) for r in out)
    mixed = mixing.mix(df, marks, {"fine": 0.999, "bad": 0.001}, budget="fine")
    left = [r["doc_id"] for r in mixed.collect()]
    assert mixed.columns == df.columns and sum(i % 4 == 0 for i in left if i < 400) < 10 and sum(i % 4 > 0 for i in set(left) if i < 400) > 290
    assert mixing.mixing_rates(none, marks, {"fine": 0.9, "bad": 0.1}).count() == 0


def test_rates_are_the_minimum_of_a_dense_solver(spark):
    rng = np.random.default_rng(4)
    p = rng.dirichlet([0.4, 0.3, 0.2], 150)
    n = rng.integers(0, 300, 150).astype(float)
    has = n @ p
    for share in ([0.6, 0.3, 0.1], [0.98, 0.01, 0.01], [0.999, 0.001, 0.0]):
        aim, pull = np.array(share) * has.sum(), mixing.PULL

        def totals(g):
            r = mixing.rates_from(p, g)
            return (n * r) @ p, -((p * (n * (r > 0))[:, None]).T @ p) / pull, n @ ((p @ g) * r + 0.5 * pull * (r - 1) ** 2)

        g, now, left = mixing.settle(totals, has, aim)
        r = mixing.rates_from(p, g)
        # Projected gradient on the rates themselves, long enough.
        slow = fast = np.ones(150)
        for k in range(40000):
            was, slow = slow, np.maximum(0, fast - (p @ (((n * fast) @ p - aim) / has) + pull * (fast - 1)) / (1 + pull))
            fast = slow + k / (k + 3) * (slow - was)
        cost = lambda x: ((((n * x) @ p - aim) ** 2) / has).sum() + pull * (n * (x - 1) ** 2).sum()
        assert left < 1e-5 and cost(r) <= cost(slow) * (1 + 1e-6) + 1e-9 and np.allclose(r[n > 0], slow[n > 0], atol=2e-2)


def test_license_scan(spark, docs, rows, none):
    mit = license_scan.TEMPLATES["MIT"]
    words = mit.split()
    cases = [(1, "some code\n" + mit), (2, " ".join(w for k, w in enumerate(words) if k % 10)), (3, "Released under the MIT License.\nx\nReleased under the MIT License."), (4, "the software the rights the copies of"), (5, None), (6, mit.upper().replace(" ", "\n# "))]
    out = {r["doc_id"]: r for r in license_scan.license_scan(spark.createDataFrame(cases, "doc_id long, text string")).collect()}
    assert out[1]["license"] == out[6]["license"] == "MIT" and out[1]["coverage"] == 1.0 and out[1]["first_word"] == 2
    assert out[2]["license"] == "MIT" and 0.85 < out[2]["coverage"] < 0.95
    assert out[3]["license"] == "MIT (line)" and out[4]["license"] is None and out[5]["coverage"] == 0.0
    assert out[3]["places"] == 2
    assert license_scan.license_scan(docs).count() == len(rows) and license_scan.license_scan(none).count() == 0


def test_licenses_with_foreign_words_and_several_copies():
    rnd = random.Random(11)
    scan = license_scan.Scanner(license_scan.TEMPLATES)
    noise = lambda n: [f"x{rnd.randrange(999)}" for _ in range(n)]
    for name in ("MIT", "BSD-2-Clause", "ISC", "GPL-3.0 (line)"):
        t = license_scan.words_of(license_scan.TEMPLATES[name].encode())
        for n in (0, 5, 12, 40, 100, 200):
            n = min(n, 3 * len(t) - 1)
            for scattered in (False, True):
                out = list(t)
                cuts = [rnd.randrange(1, len(t)) for _ in range(n)] if scattered else [len(t) // 2] * n
                for c in sorted(cuts, reverse=True):
                    out[c:c] = noise(1)
                text = noise(30) + out + noise(30)
                found = {f[0]: f for f in scan(" ".join(x if isinstance(x, str) else x.decode() for x in text).encode())}
                assert found[name][1] == 1.0 and found[name][2] == 1, (name, n, scattered)
        for copies in (2, 5):
            text = " ".join(" ".join(w.decode() for w in t) for _ in range(copies))
            assert {f[0]: f for f in scan(text.encode())}[name][2] == copies
            gapped = f" {' '.join(noise(50))} ".join(" ".join(w.decode() for w in t) for _ in range(copies))
            assert {f[0]: f for f in scan(gapped.encode())}[name][2] == copies
    # Coverage held against the longest common subsequence of every stretch.
    small = license_scan.Scanner({"t": "a b c d e a b f g h"}, 0.8, 6)
    t = license_scan.words_of(b"a b c d e a b f g h")
    for _ in range(300):
        w = [rnd.choice(t + [b"z"]) for _ in range(rnd.randrange(30))]
        best = max([license_scan._rows(w[i : i + 16], t)[-1] for i in range(len(w))], default=0)
        assert bool(small(b" ".join(w))) == (best >= 8)


def test_alignment_is_a_common_subsequence():
    rnd = random.Random(9)
    for _ in range(200):
        a, b = ([rnd.choice(b"abcdefghijklmnop") for _ in range(rnd.randrange(30))] for _ in range(2))
        a, b = ([bytes([x]) for x in y] for y in (a, b))
        pairs = license_scan.align(a, b)
        assert all(a[i] == b[j] for i, j in pairs) and all(p[0] < q[0] and p[1] < q[1] for p, q in zip(sorted(pairs), sorted(pairs)[1:]))


def test_search(spark, none):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 16)).astype(np.float32)
    x[100:300] = x[5]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] * 16), (1060, [1.0]), (1080, [None] * 16), (None, x[0].tolist()), (0, x[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    X = x.astype(float)
    out = ads_search.search(df, 20, 20, probe_share=1.0, eps=50.0, lists=9).collect()
    for q in range(0, 600, 20):
        s = X @ X[q]
        order = [i for i in sorted(range(600), key=lambda i: (-round(s[i], 9), i)) if i != q][:20]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == q)
        assert [m[1] for m in mine] == order and np.allclose([m[2] for m in mine], s[order])
    assert len(out) == 600
    few = ads_search.search(df, 20, 20).collect()
    found = {(r["query_id"], r["vec_id"]) for r in few}
    assert len(found & {(r["query_id"], r["vec_id"]) for r in out}) >= 0.9 * len(out)
    assert ads_search.search(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0]), (20, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert sort(r[:3] for r in ads_search.search(one).collect()) == [(0, 1, 20), (20, 1, 0)]


def test_search_with_repeated_rows_and_clashing_columns(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 8))
    x[:40] = x[0]
    rows = [(i, v.tolist(), 1, "e", 0.5, 7) for i, v in enumerate(x)] + [(1, x[1].tolist(), 1, "e", 0.5, 7)] * 200
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, g int, e string, score double, list int").repartition(5)
    out = sorted(ads_search.search(df, 20, 20, probe_share=1.0, eps=50.0, lists=3).collect(), key=lambda r: (r["query_id"], r["rank"]))
    for q in (0, 20, 40):
        s = x @ x[q]
        want = [i for i in sorted(range(60), key=lambda i: (-round(s[i], 9), i)) if i != q][:20]
        assert [r["vec_id"] for r in out if r["query_id"] == q] == want
    two = spark.createDataFrame([(0, [1.0, 0.0]), (0, [0.0, 1.0]), (1, [2.0, 0.0]), (1, [0.0, 3.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<double>")
    assert sort(ads_search.search(two).collect()) == [(0, 1, 1, 3.0), (0, 2, 2, 1.0)]


def test_recall_on_vectors_without_clusters(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    ids, x = np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float)
    found = collections.defaultdict(set)
    for r in ads_search.search(df).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -np.inf
        hits.append(len(found[ids[q]] & set(ids[np.argsort(-s)[:20]].tolist())) / 20)
    assert np.mean(hits) >= 0.9
