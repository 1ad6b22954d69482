"""The corpus queries against their SQL on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from townhall.llm import queries as corpus

DATA = "/root/testdata/sf0.001"


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in found), key=str)


@pytest.mark.parametrize("name", sorted(corpus.oracle_sql()))
def test_query_agrees_with_its_sql(spark, name):
    db = duckdb.connect()
    for p in Path(DATA).iterdir():
        db.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    got, want = corpus.queries()[name](spark, DATA), db.sql(corpus.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())
