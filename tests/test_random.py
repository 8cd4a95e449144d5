"""Every query on awkward rows."""

import duckdb
import pytest

import __spark_entry__ as contract
from oracle.statements import statements
from tests.compare import assert_same, multiset, spark_rows
from tests.random_ehr import load

RARE = {
    "bed_death",
    "census_now",
    "census_now_cc",
    "cc_census",
    "noncensus_in",
    "noncensus_out",
    "out_of_hours",
}
#: They write tables or run a stream: one seed is enough.
SLOW = {"occupancy_by_date", "occupancy_stream", "generations"}
seen = set()
BUILDERS = contract._on_tables()
STATEMENTS = statements(bridged=False)


@pytest.mark.parametrize("seed", [1, 2, 3, 4])
def test_all_queries(spark, seed):
    duck = duckdb.connect()
    t = load(spark, duck, seed)
    problems, empty = [], []
    for name, build in BUILDERS.items():
        if name in SLOW and seed > 1:
            continue
        result = duck.execute(STATEMENTS[name])
        columns = [c[0] for c in result.description]
        rows = result.fetchall()
        expected = multiset(columns, rows)
        if not rows:
            empty.append(name)
        if name == "census_cc":
            seen.update(
                column
                for column in RARE
                if any(row[columns.index(column)] for row in rows)
            )
        try:
            assert_same(spark_rows(build(t)), expected, name)
        except AssertionError as error:
            problems.append(str(error)[:1500])
    assert not problems, "\n".join(problems)
    assert not empty, empty


def test_rare_flags_were_met():
    assert seen == RARE
