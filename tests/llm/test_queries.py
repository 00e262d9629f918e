"""Queries against their SQL on the smallest tables, and the pipeline stage by stage."""

import os

import duckdb
import pytest

from lumiray.llm import queries

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not there")


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for view in ("documents", "labels"):
        con.execute(f"CREATE VIEW {view} AS SELECT * FROM '{FOLDER}/{view}.parquet'")
    df = queries.QUERIES[name](spark, FOLDER)
    cursor = con.execute(queries.ORACLES[name])
    at = [[d[0] for d in cursor.description].index(c) for c in df.columns]
    assert sorted(map(tuple, df.collect())) == sorted(tuple(r[k] for k in at) for r in cursor.fetchall())


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLES)))
def test_query_returns_its_rows(spark, name):
    table = {"op5_chat": "conversations", "op10_neighbours": "embeddings"}.get(name, "documents")
    n = spark.read.parquet(f"{FOLDER}/{table}.parquet")
    found = queries.QUERIES[name](spark, FOLDER).collect()
    if name == "op5_chat":
        assert len(found) == n.select("conv_id").distinct().count() + 1
    elif name == "op10_neighbours":
        assert len(found) == 10 * n.filter("vec_id % 100 = 0").count()
    else:
        assert len({r["doc_id"] for r in found}) == n.count()


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.cut_lineage(stage(spark, docs, FOLDER))
        if name != "packing":
            assert docs.columns == columns
            sizes.append(docs.count())
    assert 0 < sizes[3] <= sizes[2] <= sizes[1] <= sizes[0]
    assert docs.filter("octet_length(ids) <> 4 * length").count() == 0 and docs.count() > 0
