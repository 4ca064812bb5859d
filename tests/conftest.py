import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from pressroll.session import configure

    s = (SparkSession.builder.master("local[4]")
         .appName("pressroll-tests")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.driver.memory", "6g")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    configure(s)
    yield s


def one(df):
    """The single row of a one-row result as a dict."""
    rows = df.collect()
    assert len(rows) == 1, rows
    return rows[0].asDict(recursive=True)


def col_values(df, name):
    return [r[name] for r in df.collect()]
