import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
# workers import the package by name
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    folder = "/root/testdata/sf0.001"
    if not os.path.isdir(folder):
        pytest.skip("no test tables here")
    return folder


@pytest.fixture(scope="session")
def duck(sf):
    import duckdb

    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def _plain(x):
    if x is None:
        return None
    if isinstance(x, float):
        return None if x != x else round(x, 9)
    if isinstance(x, bool):
        return x
    return x if isinstance(x, (int, str)) else str(x)


@pytest.fixture(scope="session")
def same_rows(duck):
    """Asserts that a DataFrame has the rows of a DuckDB query."""

    def check(df, sql):
        names = sorted(df.columns)
        got = [tuple(_plain(r[c]) for c in names) for r in df.collect()]
        rel = duck.execute(sql)
        theirs = [d[0] for d in rel.description]
        assert sorted(theirs) == names
        want = [tuple(_plain(r[theirs.index(c)]) for c in names) for r in rel.fetchall()]
        assert sorted(map(repr, got)) == sorted(map(repr, want))

    return check
