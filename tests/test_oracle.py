"""Every registered query against its DuckDB SQL at sf0.001."""

import pytest

import __spark_entry__ as E
from cardflow.plans import catalog
from tests.conftest import SF001
from tests.oracle import compare, duck

SQLS = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF001)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_matches_oracle(spark, con, name):
    build = E.queries()[name]
    if name not in SQLS:
        assert build(spark, SF001).count() >= 0
        return
    r = compare(spark, SF001, name, build, SQLS[name], con)
    assert r["ok"], r


def test_entry_smoke(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) == 5
    assert df.columns == ["merchantId", "authorized", "held", "settled", "total"]
