"""Every registered query against its DuckDB oracle (the correctness gate), at sf0.001."""

import pytest

import __spark_entry__ as entry
from lectern.plans import check

from conftest import SF_SMALL

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return check.duck(SF_SMALL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    res = check.compare(spark, con, name, QUERIES[name], ORACLES.get(name), SF_SMALL)
    assert res["status"] in ("ok", "rows-only"), res


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert df.columns == ["query_id", "rank", "doc_id", "chunk_id", "score"]
