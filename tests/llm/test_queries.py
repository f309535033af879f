"""The subpackage's queries against DuckDB, and on whole small tables."""

import os

import __spark_entry__ as entry
import pytest
from prismlake.llm import queries

from tests.oracle import SF_DIR, assert_same

needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


def test_registered():
    names = sorted((n for n in queries.queries()), key=lambda n: int(n[2:].split("_")[0]))
    assert [n.split("_")[0] for n in names] == [f"op{i}" for i in range(1, 14)]
    assert {*names, "pipeline"} <= set(entry.queries())


@needs_data
@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    assert_same(queries.queries()[name](spark, SF_DIR), queries.oracle_sql()[name])


@needs_data
@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(queries.oracle_sql())))
def test_query_runs(spark, name):
    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet").count()
    rows = queries.queries()[name](spark, SF_DIR).count()
    assert rows >= documents if name.startswith("op10") else rows == documents
