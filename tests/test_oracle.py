"""Every registered query against its DuckDB oracle on the driver's sf0.001 tables."""

import pytest

import __spark_entry__ as entry
from acqlens.plans.registry import OPERATORS
from oracle_check import compare, duck

SF = "/root/testdata/sf0.001"
QUERIES = {name: run for name, run in entry.queries().items() if name in OPERATORS}
SQL = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_an_oracle():
    assert sorted(QUERIES) == sorted(OPERATORS) and set(QUERIES) <= set(SQL)


def test_every_statement_is_a_view_without_date_objects(con):
    for name, sql in SQL.items():
        con.execute(f"CREATE OR REPLACE VIEW checked AS {sql}")
        desc = con.execute(f"SELECT * FROM ({sql}) __q LIMIT 0").description
        assert not [d[0] for d in desc if str(d[1]) in ("DATE", "TIMESTAMP")], name


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_oracle(spark, con, name):
    result = compare(spark, con, name, SF, QUERIES[name], SQL.get(name))
    assert result["ok"], result


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() == 5  # one row per channel
    assert "recommendation" in df.columns
