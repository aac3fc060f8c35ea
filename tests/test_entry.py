"""Every registered query against its SQL, on the smallest tables."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from codeperil.plans import queries

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="test tables are not here")


def canonical(rows):
    def cell(v):
        if v is None or str(v) in ("nan", "<NA>", "NaT"):
            return "NULL"
        if isinstance(v, bool) or type(v).__name__ == "bool":
            return str(bool(v))
        return repr(round(float(v), 8)) if isinstance(v, (int, float)) or hasattr(v, "__float__") and not isinstance(v, str) else str(v)

    return sorted(tuple(map(cell, r)) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_matches_sql(spark, duck, name):
    out = queries.QUERIES[name](spark, D)
    want = duck.sql(queries.ORACLE[name])
    columns = sorted(out.columns)
    assert columns == sorted(want.columns)
    assert canonical(out.select(*columns).collect()) == canonical(want.select(*[f'"{c}"' for c in columns]).fetchall())


def test_entry_has_rows(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 200
    assert set(e.oracle_sql()) <= set(e.queries())


def test_the_rest_works_without_the_optional_part(tmp_path):
    root = Path(__file__).resolve().parents[1]
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    shutil.copytree(root / "codeperil", tmp_path / "codeperil", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = "import __spark_entry__ as e, codeperil.cli, codeperil.render; names = set(e.queries()); assert 'verdicts' in names and set(e.oracle_sql()) <= names and not any(n.startswith('op') or n == 'pipeline' for n in names); print(len(names))"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path)}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert int(done.stdout) == len(queries.QUERIES)
