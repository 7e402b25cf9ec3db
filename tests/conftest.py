from __future__ import annotations

import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    tmp = tempfile.mkdtemp(prefix="spark-")
    s = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "6g").config("spark.sql.session.timeZone", "UTC")
        .config("spark.local.dir", tmp).config("spark.checkpoint.dir", f"file://{tmp}/shared").config("spark.sql.warehouse.dir", f"{tmp}/warehouse").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf() -> str:
    return SF


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in os.listdir(sf):
        con.sql(f"CREATE VIEW {t.split('.')[0]} AS FROM '{sf}/{t}'")
    return con


def norm(v) -> str:
    if v is None or v != v:
        return "~"
    return f"{float(v):.6g}" if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


def same_rows(df, con, sql: str) -> None:
    """The rows of df are those of the SQL, by column name, in any order."""
    q = con.sql(sql)
    cols = sorted(df.columns)
    assert sorted(q.columns) == cols
    at = [q.columns.index(c) for c in cols]
    want = sorted(tuple(norm(r[i]) for i in at) for r in q.fetchall())
    got = sorted(tuple(norm(r[c]) for c in cols) for r in df.collect())
    assert got == want
