"""Every query with SQL beside it, in both engines."""

import glob
import os

import duckdb
import pytest

from lamina.plans import catalogue

SF = "/root/testdata/sf0.001"


def norm(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(path).split('.')[0]} as select * from '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=str)
    rel = con.sql(catalogue.ORACLE_SQL[name])
    assert sorted(rel.columns) == cols
    assert got == sorted((tuple(norm(r[rel.columns.index(c)]) for c in cols) for r in rel.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


def test_upsert_stream(spark, tmp_path):
    from lamina.operators.latest import live
    from lamina.streaming.upsert import upsert_view

    ops = catalogue.events_ops(spark, SF)
    ops.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = upsert_view(stream).writeStream.outputMode("update").format("memory").queryName("upserts").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = live(spark.table("upserts")).collect()
    assert sorted(got) == sorted(live(ops).collect())
