from __future__ import annotations

import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"
os.environ.setdefault("OMP_NUM_THREADS", "1")
DATA = Path("/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.driver.memory", "4g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def rows_of(frame, columns):
    """Rows of a pandas frame in a form that both engines share, sorted."""
    import pandas as pd

    def plain(x):
        if x is None or x is pd.NA or (isinstance(x, float) and x != x):
            return None
        if isinstance(x, str | bytes):
            return x
        if hasattr(x, "__int__") and float(x) == int(x):
            return int(x)
        return round(float(x), 9) if hasattr(x, "__float__") else str(x)

    return sorted((tuple(map(plain, r)) for r in frame[columns].astype(object).itertuples(index=False)), key=repr)


def same_as_oracle(spark, duck, query, sql):
    got = query(spark, str(DATA))
    columns = sorted(got.columns)
    expected = duck.execute(sql).fetch_df()
    assert columns == sorted(expected.columns)
    assert rows_of(got.select(*columns).toPandas(), columns) == rows_of(expected, columns)
