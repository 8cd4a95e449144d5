"""Every registered query against its SQL statement."""

import pytest

import __spark_entry__ as contract
from tests.compare import assert_same, multiset, spark_rows
from tests.conftest import data_dir

NAMES = set(contract._on_tables())
QUERIES = {name: query for name, query in contract.queries().items() if name in NAMES}
ORACLE = {name: sql for name, sql in contract.oracle_sql().items() if name in NAMES}
KINDS = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "string": "VARCHAR",
    "double": "DOUBLE",
    "boolean": "BOOLEAN",
    "date": "DATE",
    "timestamp_ntz": "TIMESTAMP",
}


def test_every_query_has_a_statement():
    assert set(ORACLE) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLE) == set()


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_same_rows_and_types(spark, duck, name, sf):
    df = QUERIES[name](spark, data_dir(sf))
    result = duck(data_dir(sf)).execute(ORACLE[name])
    columns = [c[0] for c in result.description]
    assert sorted(df.columns) == sorted(columns)
    types = {c[0]: str(c[1]) for c in result.description}
    assert {c: KINDS[k] for c, k in df.dtypes} == types
    assert_same(spark_rows(df), multiset(columns, result.fetchall()), name)
