"""The driver contract."""

import subprocess
import sys
from pathlib import Path

import duckdb

import __spark_entry__ as entry
from townhall import queries as library

ROOT = Path(__file__).resolve().parents[1]
DATA = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cell = lambda v: None if v is None or v != v else round(float(v), 6) if isinstance(v, float) else v
    return sorted((tuple(cell(r[i]) for i in order) for r in rows), key=str)


def test_the_library_agrees_with_sql(spark):
    """Every query of the library that has SQL, on the smallest tables."""
    db = duckdb.connect()
    for p in Path(DATA).iterdir():
        db.sql(f"create view {p.stem} as select * from read_parquet('{p}')")
    for name, sql in library.SQL.items():
        got, want = library.QUERIES[name](spark, DATA), db.sql(sql)
        assert sorted(got.columns) == sorted(want.columns), name
        assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(want.columns, want.fetchall()), name


def test_the_library_stands_without_the_corpus_operators(tmp_path):
    for f in ROOT.rglob("*.py"):
        at = f.relative_to(ROOT)
        if "llm" not in at.parts and at.name != "corpus_pipeline.py" and not any(p.startswith(".") for p in at.parts):
            (tmp_path / at).parent.mkdir(parents=True, exist_ok=True)
            (tmp_path / at).write_bytes(f.read_bytes())
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and not any(n.startswith('op') for n in e.queries()); assert 'pipeline' not in e.queries()"
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, env={"PATH": "/usr/bin:/bin"}).returncode == 0
