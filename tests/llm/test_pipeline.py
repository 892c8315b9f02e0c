"""The stages one after another, and the registered queries."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from assaybook.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no sample tables here")


def near_copies(spark, docs):
    """Copies of a clean document with other line breaks: no line is the same, every word is."""
    kept = corpus_pipeline.STAGES[0][1](spark, docs, SF).filter("length(text) < 6000").orderBy(F.length("text").desc(), "doc_id").first()
    words = kept["text"].split()
    rows = [{**kept.asDict(), "doc_id": 10**6 + k, "text": "\n".join(" ".join(words[i : i + k]) for i in range(0, len(words), k))} for k in (7, 8, 9)]
    return spark.createDataFrame([tuple(r[c] for c in docs.columns) for r in rows], docs.schema)


def test_stages_keep_the_columns_and_take_effect(spark):
    from assaybook.session import stage

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs = stage(docs.unionByName(near_copies(spark, docs)), "documents")
    rows = [docs.count()]
    for name, step in corpus_pipeline.STAGES[:-1]:
        out = stage(step(spark, docs, SF), "stage")
        assert out.columns == docs.columns, name
        docs = out
        rows.append(docs.count())
    assert rows[0] > rows[1] >= rows[2] > rows[3] and rows[4] != rows[3]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert last.count() == rows[4] and last.filter("n_tokens <> array_size(ids)").isEmpty()


def test_every_operator_is_registered():
    names = set(entry.queries())
    assert "pipeline" in names and {f"op{n}" for n in range(1, 14)} == {n.split("_")[0] for n in queries.QUERIES}
    assert set(queries.ORACLES) <= set(queries.QUERIES) <= names


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_agree_with_their_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "labels"):
        con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    found = con.execute(queries.ORACLES[name])
    columns = sorted(d[0] for d in found.description)
    want = sorted(tuple(r) for r in con.execute(f"select {', '.join(columns)} from ({queries.ORACLES[name]})").fetchall())
    df = queries.QUERIES[name](spark, SF)
    assert sorted(df.columns) == columns
    assert sorted(tuple(r) for r in df.select(*columns).collect()) == want
