"""Every query of the catalogue runs; those with SQL give the same rows as DuckDB."""

import pytest

from rillmark import queries as q


@pytest.mark.parametrize("name", sorted(q.QUERIES))
def test_query(name, spark, sf_dir, same_as_sql):
    if name in q.ORACLES:
        same_as_sql(q.QUERIES[name], q.ORACLES[name], sf_dir)
    else:
        assert q.QUERIES[name](spark, sf_dir).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).resolve().parent.parent)
