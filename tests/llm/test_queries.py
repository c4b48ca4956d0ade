import pathlib
import re

import duckdb
import pytest

import __spark_entry__ as entry_points
from memberlens.llm import queries
from memberlens.plans.registry import TABLE_NAMES
from tools.check_oracle import rows_of

ROOT = pathlib.Path(__file__).resolve().parents[2]


def test_one_query_per_operator_and_the_pipeline():
    names = entry_points.queries()
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14)) and "pipeline" in names
    assert set(queries.QUERIES) <= set(names) and set(queries.ORACLES) <= set(entry_points.oracle_sql())


def test_the_rest_does_not_import_the_subpackage():
    for path in ROOT.glob("memberlens/**/*.py"):
        if "llm" not in path.parts:
            assert "memberlens.llm" not in path.read_text(), path


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, small_data, name):
    con = duckdb.connect()
    for t in TABLE_NAMES:
        con.execute(f"create view {t} as select * from read_parquet('{small_data}/{t}.parquet')")
    df = queries.QUERIES[name](spark, small_data)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(c[0] for c in cur.description)
    assert got and got == rows_of([c[0] for c in cur.description], cur.fetchall())
