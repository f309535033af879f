"""The registered queries against DuckDB, and the shape of the driver's contract."""

import os

import __spark_entry__ as entry
import pytest
from prismlake import registry as queries

from tests.oracle import SF_DIR, assert_same

needs_data = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables here")


def test_contract():
    known = entry.queries()
    assert set(queries.QUERIES) <= set(known) and set(entry.oracle_sql()) <= set(known)
    assert {n for n in queries.QUERIES if n not in queries.SQL} == {"bpe_tokens"}


@needs_data
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    assert_same(queries.QUERIES[name](spark, SF_DIR), queries.SQL[name])


@needs_data
@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_runs(spark, name):
    assert queries.QUERIES[name](spark, SF_DIR).count() > 0


@needs_data
def test_flagship(spark):
    assert entry.entry(spark).count() == 20


def plan_of(frame):
    return frame._jdf.queryExecution().explainString(frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


@needs_data
def test_plans(spark):
    """Filters and columns reach the scan, top k is a heap, and the vector column isn't read where it isn't scored."""
    topk = plan_of(queries.QUERIES["vector_topk_filtered"](spark, SF_DIR))
    assert "TakeOrderedAndProject" in topk and "ReadSchema" in topk
    text_only = plan_of(queries.QUERIES["ocr_newest_topk"](spark, SF_DIR))
    assert not any("ReadSchema" in line and "embedding:" in line for line in text_only.splitlines())
    for name in ("gated_upsert", "index_plan_changed", "album_catalog", "valid_faces"):
        assert "CartesianProduct" not in plan_of(queries.QUERIES[name](spark, SF_DIR))
