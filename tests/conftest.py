"""A session for all tests, and a comparison of Spark rows with DuckDB's."""

from __future__ import annotations

import math
import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}".rstrip(":")
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
#: Whole test tables; a test that needs them is left out where they aren't.
DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="session")
def spark():
    from lodestar.sources.session import session

    out = session("local[4]", **{"spark_sql_shuffle_partitions": "8", "spark_ui_enabled": "false", "spark_driver_memory": "4g"})
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()


@pytest.fixture(scope="session")
def sf_dir() -> str:
    if not DATA.is_dir():
        pytest.skip("no test tables here")
    return str(DATA)


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    return con


def plain(value):
    """A value that sorts and compares alike from either engine."""
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    return f"{value:.9g}" if isinstance(value, float) else str(value)


def sorted_rows(columns, rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="session")
def same_as_sql(duck):
    def check(df, sql: str) -> None:
        answer = duck.execute(sql)
        columns = [c[0] for c in answer.description]
        assert sorted(df.columns) == sorted(columns)
        assert sorted_rows(df.columns, [tuple(r) for r in df.collect()]) == sorted_rows(columns, answer.fetchall())

    return check
