import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "4")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables here")
    return SF


def compare(spark, sf, query, sql):
    """Rows of a query and of its SQL equivalent, columns by name, without order."""
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{sf}/{f}'")
    clean = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    df = query(spark, sf)
    names = sorted(df.columns)
    made = sorted((tuple(map(clean, r)) for r in df.select(*[f"`{c}`" for c in names]).collect()), key=repr)
    cols = ", ".join(f'"{c}"' for c in names)
    there = sorted((tuple(map(clean, r)) for r in con.execute(f"SELECT {cols} FROM ({sql})").fetchall()), key=repr)
    assert made == there
    return made
