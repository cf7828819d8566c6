import os
import sys

import pytest

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, REPO)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [REPO, os.environ.get("PYTHONPATH")]))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "6g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def sf_dir():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def duck(sf_dir):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _cell(x):
    if x is None:
        return None
    if isinstance(x, (bool, str, bytes)):
        return x
    if isinstance(x, (int, float)):
        return round(float(x), 6)
    return str(x)


def same_rows(spark_df, duck_result):
    """Both results as sorted tuples by column name, for one assert."""
    names = sorted(spark_df.columns)
    got = sorted((tuple(_cell(r[c]) for c in names) for r in spark_df.collect()), key=repr)
    columns = [d[0] for d in duck_result.description]
    assert sorted(columns) == names
    want = sorted((tuple(_cell(row[columns.index(c)]) for c in names) for row in duck_result.fetchall()), key=repr)
    return got, want
