"""Every registered query against its DuckDB twin on sf0.001 (values compared exactly)."""

import pytest

import __spark_entry__ as entry
from tabscore.plans import catalogue
from tools.oracle_check import compare, duck

from tests.conftest import SF0001

NAMES = sorted(catalogue.QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF0001)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    res = compare(spark, con, name, entry.queries()[name], entry.oracle_sql().get(name), SF0001)
    if entry.oracle_sql().get(name) is None:
        assert res["rows"] > 0
    else:
        assert res["cols_match"], res
        assert res["rows"] == res["oracle_rows"], res
        assert res["exact"], res


def test_entry_smoke(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert df.columns == ["doc_id", "prediction", "probability"]
    assert len(rows) == spark.read.parquet(f"{SF0001}/documents.parquet").count()
