"""Every query that has SQL, run by both engines over the same tables."""

from __future__ import annotations

import datetime
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from pressmill.plans import registry

ROOT = Path(__file__).resolve().parent.parent


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM read_parquet('{sf_dir}/{name}')")
    return con


def _value(x):
    if isinstance(x, float):
        return round(x, 9) if x == x else None
    return x.isoformat() if isinstance(x, datetime.date) else x


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(([_value(r[i]) for i in order] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_is_its_sql(spark, duck, sf_dir, name):
    frame = registry.QUERIES[name](spark, sf_dir)
    found = _rows(frame.columns, [tuple(r) for r in frame.collect()])
    want = duck.execute(registry.ORACLES[name])
    assert found == _rows([c[0] for c in want.description], want.fetchall())
    assert found[1]


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_query_without_sql_gives_rows(spark, sf_dir, name):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_all_is_there_without_the_corpus_operators(tmp_path):
    code = "import __spark_entry__ as e; q = e.queries(); assert 'url_valid' in q and 'pipeline' not in q and not any(n.startswith('op1_') for n in q); assert set(e.oracle_sql()) <= set(q)"
    for p in ("__spark_entry__.py", "pressmill"):
        os.system(f"cp -r {ROOT / p} {tmp_path}/")
    os.system(f"rm -rf {tmp_path}/pressmill/llm")
    subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_nothing_else_uses_the_corpus_operators():
    for p in (ROOT / "pressmill").rglob("*.py"):
        assert p.parent.name == "llm" or "pressmill.llm" not in p.read_text()
