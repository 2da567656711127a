"""Vectorised recurrences against loops and pandas; exchanges of a recipe counted."""

import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from conftest import SF
from tidemark.operators import scans
from tidemark.operators.recurrences import Derived, Mean, _MeanState, affine, recurrences
from tidemark.plans import registry


def test_affine_matches_a_loop():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 31, 33, 1000):
        a, b, y, want = rng.random(n), rng.normal(size=n), 0.7, []
        for i in range(n):
            y = a[i] * y + b[i]
            want.append(y)
        np.testing.assert_allclose(affine(a, b, 0.7), want, rtol=1e-12, atol=1e-12)
    a = np.full(100, 0.5)
    a[50] = 0.0
    b = np.ones(100)
    b[10] = np.nan  # spoils its own run only
    assert np.isnan(affine(a, b)[10:50]).all() and not np.isnan(affine(a, b)[50:]).any()


def test_means_over_cut_batches_match_pandas():
    rng = np.random.default_rng(1)
    for _ in range(100):
        n = int(rng.integers(1, 80))
        x = np.where(rng.random(n) < 0.3, np.nan, rng.normal(size=n))
        alpha, least = float(rng.choice([0.1, 0.5, 1 / 14])), int(rng.integers(1, 6))
        state, cuts = _MeanState(Mean("o", "x", alpha, least)), sorted(rng.integers(0, n + 1, 2))
        got = np.concatenate([state(x[: cuts[0]]), state(x[cuts[0] : cuts[1]]), state(x[cuts[1] :])])
        np.testing.assert_allclose(got, pd.Series(x).ewm(alpha=alpha, adjust=False, min_periods=least).mean().to_numpy(), rtol=1e-11, atol=1e-12)


def frame(spark, n=3000):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame({"symbol": np.repeat(["a", "b", "c"], n), "i": np.tile(np.arange(n), 3), "x": np.where(rng.random(3 * n) < 0.1, np.nan, rng.normal(size=3 * n))})
    pdf.loc[pdf["symbol"] == "c", "x"] = np.nan
    return pdf, spark.createDataFrame(pdf.sample(frac=1, random_state=3)).withColumn("x", F.when(~F.isnan("x"), F.col("x")))


def test_chained_recurrences_in_one_stage(spark):
    pdf, df = frame(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "700")  # a key spans batches
    try:
        steps = [Mean("fast", "x", 0.3), Mean("slow", "x", 0.05, 20), Derived("gap", lambda f, s: f - s, ("fast", "slow")), Mean("signal", "gap", 0.2)]
        found = recurrences(df, steps, key=["symbol"], ts="i", drop=("slow",))
        assert found.columns == ["symbol", "i", "x", "fast", "gap", "signal"]
        got = found.toPandas().sort_values(["symbol", "i"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for symbol, own in pdf.groupby("symbol"):
        fast, slow = own["x"].ewm(alpha=0.3, adjust=False).mean(), own["x"].ewm(alpha=0.05, adjust=False, min_periods=20).mean()
        mine = got[got["symbol"] == symbol]
        for c, want in (("fast", fast), ("gap", fast - slow), ("signal", (fast - slow).ewm(alpha=0.2, adjust=False).mean())):
            np.testing.assert_allclose(mine[c].to_numpy(float), want.to_numpy(), rtol=1e-9, atol=1e-11)


@pytest.mark.parametrize("block", [None, 7, 1000])
def test_affine_scan_of_many_keys(spark, block):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"k": rng.integers(0, 40, 4000), "i": np.arange(4000), "a": rng.random(4000), "b": rng.normal(size=4000)})
    got = scans.affine_scan(spark.createDataFrame(pdf).repartition(5), "a", "b", "y", key=["k"], ts="i", block=block).toPandas().sort_values("i")
    last, want = {}, []
    for k, a, b in zip(pdf["k"], pdf["a"], pdf["b"]):
        last[k] = a * last.get(k, 0.0) + b
        want.append(last[k])
    np.testing.assert_allclose(got["y"].to_numpy(), want, rtol=1e-9, atol=1e-11)


def test_a_recipe_of_many_smoothings_has_four_exchanges_and_two_python_stages(spark):
    plan = registry.queries()["recipe_camarilla_break"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"Exchange hashpartitioning", plan)) <= 4
    assert len(re.findall(r"InArrow|InPandas|ArrowEvalPython", plan)) == 2


def test_order_holds_after_a_window_with_a_finer_key(spark):
    """Spark moves the window that numbers the rows under the finer one; rows must still come in order."""
    pdf, df = frame(spark, 400)
    finer = df.withColumn("part", F.col("i") % 7).withColumn("m", F.max("i").over(Window.partitionBy("symbol", "part").orderBy(F.desc("i"))))
    got = recurrences(finer, [Mean("y", "x", 0.3)], key=["symbol"], ts="i").toPandas().sort_values(["symbol", "i"])
    for symbol, own in pdf.groupby("symbol"):
        np.testing.assert_allclose(got[got["symbol"] == symbol]["y"].to_numpy(float), own["x"].ewm(alpha=0.3, adjust=False).mean().to_numpy(), rtol=1e-9, atol=1e-11)
    assert got["m"].notna().all()
