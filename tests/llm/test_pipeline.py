"""The pipeline, stage by stage, against what a plain program keeps."""

import re

import pytest

import corpus_pipeline
from lamina.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [r.asDict() for r in docs.collect()]
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        after = [r.asDict() for r in docs.collect()]
        ids = {r["doc_id"] for r in after}
        if name != "tokens":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert all(r in before for r in after)
        if name == "quality":
            known = [i for i in labels if labels[i]["quality"] is not None]
            assert sum((i in ids) == (labels[i]["quality"] == 1) for i in known) > 0.9 * len(known)
        if name == "exact dedup":
            least = {}
            for r in before:
                t = re.sub(r"[\x20\x09-\x0d]+", " ", r["text"])
                least[t] = min(r["doc_id"], least.get(t, r["doc_id"]))
            assert ids == set(least.values()) and len(after) == len(ids)
        if name == "near dedup":
            assert ids <= {r["doc_id"] for r in before} and len(after) == len(ids)
        if name == "mixing":
            assert len(ids) > 0.7 * len({r["doc_id"] for r in before})
        if name == "tokens":
            assert len(after) == len(before) and all(r["n_tokens"] >= 0 for r in after)


def test_nulls_and_repeats_pass_through(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (None, "some words here", None, "src0", 1), (900001, "", "en", None, 0), (900001, "", "en", None, 0), (900002, "word " * 30000, "en", "src0", 150000)], base.schema)
    docs = base.limit(30).unionByName(odd)
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() > 0
        assert stage(spark, docs.limit(0), SF).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(queries.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[rel.columns.index(c)] for c in cols) for r in rel.fetchall())


def test_the_mix_takes_toxic_tokens_down(spark):
    """On so few labels the target of 0.5 % is missed (0.8 % of expected tokens): the rates say so, and toxic documents go."""
    from pyspark.sql import functions as F

    from lamina.llm.mixing import mixing_rates

    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    marks = labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("toxic") == 0, "clean").alias("domain"))
    rated = mixing_rates(docs, marks, corpus_pipeline.TARGETS, budget="clean").collect()
    before, after = ([sum(r["n_tokens"] * w(r) * r["posteriors"][k] for r in rated) for k in (0, 1)] for w in (lambda r: 1, lambda r: r["rate"]))
    aim = before[0] / corpus_pipeline.TARGETS["clean"]
    missed = [(after[0] - before[0]) / aim, after[1] / aim - corpus_pipeline.TARGETS["toxic"]]
    assert all(abs(x - y) < 1e-6 for x, y in zip(missed, rated[0]["missed"])) and abs(missed[0]) < 1e-3
    assert after[1] < 0.01 * sum(after) < 0.2 * before[1]
    toxic = {r["doc_id"] for r in labels.filter("toxic = 1").collect()}
    kept = {r["doc_id"] for r in corpus_pipeline.mixing(spark, docs, "/root/testdata/sf0.01").select("doc_id").collect()}
    assert len(toxic & kept) < 0.1 * len(toxic)
