import os
import sys

import pandas as pd
import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    place = tmp_path_factory.mktemp("spark")
    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").config("spark.sql.warehouse.dir", f"file://{place}/warehouse").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf():
    return DATA


def duck(sf_dir):
    """The sample tables as views of a DuckDB connection."""
    import glob

    import duckdb

    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def rows_of(df):
    """Rows as comparable tuples by sorted column name; floats to six digits, NaN as null."""
    cols = sorted(df.columns)

    def plain(v):
        if pd.isna(v) is True:
            return "null"
        return f"{v:.6f}" if isinstance(v, float) and v % 1 else str(int(v) if isinstance(v, float) and abs(v) < 1e15 else v)

    return cols, sorted(tuple(plain(v) for v in r) for r in df[cols].itertuples(index=False))
