import os
import sys
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, [os.environ.get("PYTHONPATH")])])

TINY, SMALL = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").appName("tests")
        .config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "4g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tiny():
    return TINY


@pytest.fixture(scope="session")
def oracle():
    """Run SQL over the tables of a folder in DuckDB."""
    duckdb = pytest.importorskip("duckdb")

    def run(sql: str, folder: str = TINY):
        con = duckdb.connect()
        con.sql("set timezone = 'UTC'")
        for p in Path(folder).glob("*.parquet"):
            con.sql(f"create view {p.stem} as select * from '{p}'")
        return con.sql(sql).df()

    return run


def rows_of(frame, columns):
    """Rows of a pandas frame, sorted, in a form that both engines share."""
    def plain(v):
        if hasattr(v, "tolist"):
            v = v.tolist()
        if v is None or str(v) in ("nan", "<NA>", "NaT"):
            return "<null>"
        return repr(round(float(v), 9)) if isinstance(v, int | float) and not isinstance(v, bool) else str(v)

    return sorted(tuple(plain(v) for v in row) for row in frame[columns].itertuples(index=False))


@pytest.fixture(scope="session")
def same_rows():
    def check(left, right):
        assert sorted(left.columns) == sorted(right.columns)
        columns = sorted(left.columns)
        assert rows_of(left, columns) == rows_of(right, columns)

    return check
