import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
os.environ.setdefault("PYTHONPATH", sys.path[0])

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    made = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.driver.memory", "4g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", f"file://{tmp_path_factory.mktemp('checkpoints')}")
        .getOrCreate()
    )
    made.sparkContext.setLogLevel("ERROR")
    yield made
    made.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(SMALL):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{SMALL}/{name}'")
    return con


def plain(rows, columns):
    """Rows as sorted texts, doubles rounded."""

    def cell(x):
        if x is None or x != x:
            return None
        return round(float(x), 6) if isinstance(x, float) else str(x)

    return sorted(repr([cell(r[c]) for c in columns]) for r in rows)


@pytest.fixture(scope="session")
def same_rows(spark, duck):
    def check(query, sql):
        frame = query(spark, SMALL)
        columns = sorted(frame.columns)
        result = duck.sql(sql)
        assert columns == sorted(result.columns)
        assert plain([r.asDict() for r in frame.collect()], columns) == plain([dict(zip(result.columns, r, strict=True)) for r in result.fetchall()], columns)

    return check
