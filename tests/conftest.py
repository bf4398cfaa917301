import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))


@pytest.fixture(scope="session")
def spark():
    from rillmark.session import get_session

    return get_session("tests", 4, **{"spark.driver.memory": "3g", "spark.sql.shuffle.partitions": "4"})


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


def duck(sf_dir):
    """A DuckDB connection with the tables as views."""
    import duckdb

    con = duckdb.connect()
    for path in Path(sf_dir).glob("*.parquet"):
        con.sql(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}{'/*' if path.is_dir() else ''}')")
    return con


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = lambda x: "null" if x is None else repr(float(x)) if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def same_as_sql(spark):
    """Compares a query with its SQL over one folder of tables."""

    def check(query, sql, folder):
        df = query(spark, folder)
        rel = duck(folder).sql(sql)
        assert canonical(df.collect(), df.columns) == canonical(rel.fetchall(), rel.columns)

    return check
