"""Stages of the pipeline judge rows, not ids: rows without an id, or of one id, keep their own texts' verdicts."""

import random

from pyspark.sql import functions as F

from lamina.llm import mixing, quality


def tables(spark):
    rnd = random.Random(3)
    good = lambda: " ".join(rnd.choice(["alpha", "beta", "gamma", "delta", "epsilon", "omega", "sigma"]) for _ in range(80)) + "."
    junk = lambda: "".join(rnd.choice("!#$%&*|<>{}=/ ") for _ in range(300))
    rows = [(i, good() if i % 2 else junk()) for i in range(300)]
    odd = [(None, good()), (None, junk()), (None, good()), (-1, good()), (5, junk()), (6, good())]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(7, 300)], "doc_id long, quality int")
    return docs, labels, rows + odd


def test_keep_good_decides_row_by_row(spark):
    docs, labels, rows = tables(spark)
    want = sorted([(str(i), t) for i, t in rows if "a" in t])
    assert sorted((str(r["doc_id"]), r["text"]) for r in quality.keep_good(docs, labels).collect()) == want


def test_mix_rates_row_by_row(spark):
    docs, labels, rows = tables(spark)
    marks = labels.select("doc_id", F.when(F.col("quality") == 1, "fine").otherwise("bad").alias("domain"))
    mixed = mixing.mix(docs, marks, {"fine": 0.999, "bad": 0.001}, budget="fine").collect()
    assert {(r["doc_id"], r["text"]) for r in mixed} >= {(i, t) for i, t in rows if "a" in t}
    assert (None, rows[301][1]) not in {(r["doc_id"], r["text"]) for r in mixed}


def test_copies_keep_the_fitted_fraction(spark):
    df = spark.range(20000).withColumn("th", F.xxhash64("id"))
    for rate in (0.3, 0.7, 1.4, 2.0):
        n = df.select(mixing.copies(F.lit(rate), 0, F.col("id"), F.col("th")).alias("n"))
        mean, low, high = n.agg(F.avg("n"), F.min("n"), F.max("n")).first()
        assert abs(mean - rate) < 0.02 and low == int(rate) and high <= int(rate) + 1
    assert df.select(mixing.copies(F.lit(0.2), 1, F.col("id")).alias("n")).agg(F.min("n")).first()[0] == 1


def test_columns_of_clashing_names_stay(spark):
    from lamina.llm import exact_dedup, near_copies

    docs, labels, rows = tables(spark)
    names = ["th", "score", "rate", "n", "node", "bands", "p", "kept", "missed", "stats", "domain", "quality", "y"]
    wide = docs.withColumns({c: F.lit(c) for c in names})
    marks = labels.withColumns({"text": F.lit("t"), "th": F.lit(1), "domain": F.when(F.col("quality") == 1, "fine").otherwise("bad")})
    for out in (quality.keep_good(wide, marks), exact_dedup.keep_first(wide), near_copies.keep_one(wide), mixing.mix(wide, marks, {"fine": 0.99, "bad": 0.01}, budget="fine")):
        assert out.columns == wide.columns and out.count() > 100 and all(out.first()[c] == c for c in names)
    assert quality.quality_scores(wide, marks).count() == mixing.mixing_rates(wide, marks, {"fine": 0.9, "bad": 0.1}).count() == len(rows)
