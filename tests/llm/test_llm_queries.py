"""The queries against their SQL, and the pipeline against plain computations."""

import re

import pytest

import corpus_pipeline
from checks.compare import difference, oracle_connection
from fleetmeter.llm.oracle import ORACLE
from fleetmeter.llm.queries import QUERIES
from tests.conftest import FOLDER


@pytest.fixture(scope="module")
def connection():
    return oracle_connection(FOLDER)


@pytest.mark.parametrize("name", ORACLE)
def test_query_and_sql(spark, connection, name):
    assert difference(QUERIES[name](spark, FOLDER), connection, ORACLE[name]) is None


@pytest.mark.parametrize("name", QUERIES)
def test_query_has_a_row_for_each_row(spark, name):
    found = QUERIES[name](spark, FOLDER)
    if name.startswith("op7"):
        assert found.columns[:4] == ["query_id", "rank", "vec_id", "score"]
    else:
        source = "pages" if name.startswith("op6") else "documents"
        assert found.count() == spark.read.parquet(f"{FOLDER}/{source}.parquet").count()


@pytest.mark.parametrize("name", ["op1_license_scan", "op4_line_dedup"])
def test_native_plans(spark, name):
    plan = QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for word in ["Python", "Pandas", "Arrow", "CartesianProduct", "BroadcastNestedLoopJoin"]:
        assert word not in plan


def test_pipeline_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, FOLDER)
        assert after.columns == names and after.dtypes == docs.dtypes, name
        assert {r[0] for r in after.select("doc_id").collect()} <= {r[0] for r in docs.select("doc_id").collect()}
        docs = spark.createDataFrame(after.collect(), after.schema)
    assert 0 < docs.count() < before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER)
    assert last.count() == docs.count()
    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = set()
    for row in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect():
        own = word.findall(row["text"].lower())
        windows.update(" ".join(own[i:i + 10]) for i in range(max(1, len(own) - 9)))
    for row in docs.collect():
        own = word.findall((row["text"] or "").lower())
        assert not any(" ".join(own[i:i + 10]) in windows for i in range(len(own) - 9))


def test_pipeline_of_odd_documents(spark):
    schema = spark.read.parquet(f"{FOLDER}/documents.parquet").schema
    rows = [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "z" * 50_000, "en", "s", 50_000)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
    assert docs.count() == 4
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, FOLDER)
    assert empty.count() == 0
