"""Every query with a SQL twin against DuckDB on the small tables."""

import math

import duckdb
import pytest

from skycat.llm import queries as Q

SF = "/root/testdata/sf0.001"


def _rows(table):
    columns = sorted(table.column_names)
    data = [table.column(c).to_pylist() for c in columns]
    clean = lambda v: "nan" if isinstance(v, float) and math.isnan(v) else v
    return columns, sorted((tuple(map(clean, r)) for r in zip(*data)), key=repr)


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for name_ in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name_} AS SELECT * FROM read_parquet('{SF}/{name_}.parquet')")
    want = con.sql(Q.SQL[name]).to_arrow_table()
    got = Q.QUERIES[name](spark, SF).toArrow()
    assert {f.name: str(f.type) for f in got.schema} == {f.name: str(f.type) for f in want.schema}
    assert _rows(got) == _rows(want)
