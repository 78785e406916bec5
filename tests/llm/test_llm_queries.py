"""The registered queries of the subpackage and the pipeline at the smallest scale."""

import os
import sys

import duckdb
import pytest

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))

import __spark_entry__ as entry
import corpus_pipeline
from compare import TABLES, rows_of
from voicegrain.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables are not here")


def test_registered():
    assert {int(q[2:].split("_")[0]) for q in QUERIES} == set(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", list(ORACLES))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for table in TABLES.split():
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df, result = QUERIES[name](spark, FOLDER), db.sql(ORACLES[name])
    assert rows_of(df.columns, [tuple(r) for r in df.collect()]) == rows_of(result.columns, result.fetchall())


@pytest.mark.parametrize("name", [q for q in QUERIES if q not in ORACLES])
def test_query_has_a_row_for_each_input_row(spark, name):
    table = "pages" if name.startswith("op1_") else "documents"
    assert QUERIES[name](spark, FOLDER).count() == spark.read.parquet(f"{FOLDER}/{table}.parquet").count()


def test_pipeline(spark):
    raw = spark.read.parquet(f"{FOLDER}/documents.parquet")
    docs, left = raw, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.stored(stage(spark, docs, FOLDER))
        assert docs.columns == raw.columns
        left.append(docs.count())
    assert raw.count() > left[0] > left[1] >= left[2]
    assert corpus_pipeline.run(spark, FOLDER).count() == left[3]
