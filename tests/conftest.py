import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g").config("spark.sql.session.timeZone", "UTC").config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared"))).getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def duck():
    import duckdb

    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def normal(pdf):
    """Rows as sorted tuples of text, columns by name."""
    import numpy as np
    import pandas as pd

    def one(v):
        if v is None or v is pd.NA or (isinstance(v, float) and v != v):
            return "~"
        if isinstance(v, (bool, np.bool_, int, float, np.integer, np.floating)):
            return f"{float(v) + 0.0:.9g}"
        return str(v)

    cols = sorted(pdf.columns)
    return cols, sorted(tuple(one(v) for v in row) for row in pdf[cols].astype(object).itertuples(index=False, name=None))
