import os
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
os.environ["PYTHONPATH"] = f"{Path(__file__).resolve().parent.parent}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for p in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


@pytest.fixture(scope="session")
def same(spark, duck, sf_dir):
    """Whether a query and its SQL give the same rows, columns by name and rows in any order."""

    def plain(x):
        if isinstance(x, (list, tuple)) or type(x).__name__ == "ndarray":
            return tuple(plain(y) for y in x)
        if isinstance(x, float) or type(x).__name__.startswith("float"):
            return None if x != x else round(float(x), 6)
        if x is None or type(x).__name__ in ("NaTType", "NAType"):
            return None
        return bool(x) if type(x).__name__ in ("bool", "bool_") else int(x) if type(x).__name__.startswith(("int", "uint")) else str(x)

    def check(query, sql):
        a, b = query(spark, sf_dir).toPandas(), duck.execute(sql).df()
        assert sorted(a.columns) == sorted(b.columns)
        rows = [sorted((tuple(plain(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False)), key=repr) for df in (a, b)]
        assert rows[0] == rows[1]

    return check
