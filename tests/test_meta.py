"""Models on data where the right answer is known: separable labels, steps in time, blobs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import meta


def separable(spark, n=400):
    rng = np.random.default_rng(6)
    x = rng.normal(size=n)
    rows = [(i, float(v) if i % 20 else None, float(rng.normal()), int((v if i % 20 else 0.0) > 0)) for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "i int, x double, noise double, y int")


@pytest.mark.parametrize("trees", [False, True])
def test_meta_labels_of_separable_data_are_found(spark, trees):
    df = separable(spark)
    model = meta.fit_meta(df.where("i < 300"), ["x", "noise"], trees=trees)
    scored = meta.predict(model, df.where("i >= 300"))
    assert scored.columns == ["i", "x", "noise", "y", "p"]
    wrong = scored.where("abs(x) > 0.2 AND (p >= 0.5) <> (y = 1)").count()
    assert wrong == 0 and scored.where("p < 0 OR p > 1 OR p IS NULL").count() == 0
    r = meta.precision_recall(scored.where("abs(x) > 0.2"), "p", "y").first()
    assert (r.precision, r.recall) == (1.0, 1.0)


def test_small_or_one_sided_samples_fit_nothing(spark):
    df = separable(spark)
    assert meta.fit_meta(df.limit(40), ["x"]) is None
    assert meta.fit_meta(df.withColumn("y", (F.col("i") < 5).cast("int")), ["x"]) is None


def test_forest_learns_from_the_past_alone(spark):
    rng = np.random.default_rng(2)
    f = rng.integers(0, 2, 500)
    rows = [(i, float(v), 1.0 if v else -1.0) for i, v in enumerate(f)]
    df = spark.createDataFrame(rows, "t int, f double, y double").withColumn("ts", F.timestamp_seconds(F.col("t") * 3600))
    got = {r.t: (r.slice, r.score) for r in meta.expanding_forest(df, ["f"], "y", order="ts").collect()}
    first = min(got)
    assert 150 < first < 250 and sorted(got) == list(range(first, 500))  # the first 40 % only train
    assert all(abs(score - rows[t][2]) < 1e-6 for t, (_, score) in got.items())
    # other targets in the last slice leave the scores of all slices as they are: it is never trained on
    last = max(s for s, _ in got.values())
    start = min(t for t, (s, _) in got.items() if s == last)
    other = df.withColumn("y", F.when(F.col("t") >= start, -F.col("y")).otherwise(F.col("y")))
    again = {r.t: (r.slice, r.score) for r in meta.expanding_forest(other, ["f"], "y", order="ts").collect()}
    assert again == got


def test_clusters_find_blobs_whatever_the_scale(spark):
    rng = np.random.default_rng(3)
    centres = [(0, 0, 0), (8, 0, 1000), (0, 9, -1000), (9, 9, 0)]
    rows = [(f"s{i}", i % 4, *[float(c + rng.normal() * s) for c, s in zip(centres[i % 4], (0.2, 0.2, 20))]) for i in range(120)]
    df = spark.createDataFrame(rows, "symbol string, truth int, a double, b double, c double")
    got = meta.behaviour_clusters(df, ["a", "b", "c"], 4).groupBy("truth").agg(F.countDistinct("cluster").alias("n"), F.first("cluster").alias("c")).collect()
    assert [r.n for r in got] == [1] * 4 and len({r.c for r in got}) == 4
