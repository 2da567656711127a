"""Rolling quantiles and ranks by blocks against pandas over whole series."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark.operators.order_stats import rolling_order


def frame(spark, n, keys=("a", "b"), seed=1):
    rng = np.random.default_rng(seed)
    parts = []
    for k in keys:
        x = np.round(rng.normal(size=n), 1)  # ties
        x[rng.random(n) < 0.1] = np.nan
        parts.append(pd.DataFrame({"symbol": k, "s": np.arange(n) * 60 + 5, "x": x, "q": "own column"}))
    pdf = pd.concat(parts)
    return pdf, spark.createDataFrame(pdf.sample(frac=1, random_state=2)).withColumn("ts", F.timestamp_seconds("s")).repartition(3)


@pytest.mark.parametrize(("k", "block_rows"), [(1, 64), (5, 64), (100, 64), (1000, 64), (100, 10_000)])
def test_blocks_match_pandas(spark, k, block_rows):
    pdf, df = frame(spark, 700)
    least = max(1, k // 3)
    got = rolling_order(df, "x", k, key=["symbol"], quantiles={"lo": 0.1, "med": 0.5}, rank="r", least=least, block_rows=block_rows).toPandas().sort_values(["symbol", "s"])
    assert len(got) == len(pdf) and set(got["q"]) == {"own column"}
    for symbol, own in pdf.groupby("symbol"):
        w = own["x"].rolling(k, min_periods=least)
        mine = got[got["symbol"] == symbol]
        for c, want in (("lo", w.quantile(0.1)), ("med", w.quantile(0.5)), ("r", w.rank(pct=True))):
            np.testing.assert_allclose(mine[c].to_numpy(float), want.to_numpy(), rtol=1e-12, atol=1e-12)


def test_empty_and_full_window_by_default(spark):
    _, df = frame(spark, 10)
    assert rolling_order(df.limit(0), "x", 3, key=["symbol"], rank="r").count() == 0
    assert rolling_order(df.fillna(0.0, ["x"]), "x", 3, key=["symbol"], rank="r").where("r IS NULL").count() == 4


def test_time_hardly_grows_with_the_window(spark):
    _, df = frame(spark, 90_000, keys=("a",))
    df = df.cache()
    df.count()
    took = {}
    for k in (432, 432, 43_200):
        began = time.time()
        rolling_order(df, "x", k, key=["symbol"], quantiles={"med": 0.5}, least=10).agg(F.sum("med")).collect()
        took[k] = time.time() - began
    assert took[43_200] < 4 * took[432] + 2
