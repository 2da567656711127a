"""Statistics against numbers written out, and against formulas in numpy on the same draws."""

import math
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import folds, inference, levels, meta, pairs
from tidemark.plans.base import rounded, tidy

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def timed(spark, values, key="a"):
    return spark.createDataFrame([(key, T0 + timedelta(hours=i), float(v)) for i, v in enumerate(values)], "symbol string, ts timestamp, x double")


def test_unit_root_with_a_constant(spark):
    df = timed(spark, [0.5, -0.2, 0.3, 0.1, -0.4, 0.2, 0.0, -0.1, 0.35, -0.15, 0.05, 0.4])
    r = pairs.dickey_fuller(df, "x", key=["symbol"]).first()
    assert r.n == 11
    assert r.rho == pytest.approx(-1.5041666666666667, abs=1e-12)
    assert r.t == pytest.approx(-5.666012892439149, abs=1e-12)
    assert r.half_life is None


def test_unit_root_with_six_lags(spark):
    rng = np.random.default_rng(4)
    z = np.zeros(80)
    for i in range(1, 80):
        z[i] = 0.8 * z[i - 1] + rng.normal()
    r = pairs.unit_root_lags(timed(spark, z), "x", 6, key=["symbol"]).first()
    assert (r.n, round(r.rho, 10), round(r.t, 10)) == (73, -0.3619992636, -2.3767378834)
    assert 0.14 < r.p < 0.16  # between the tabulated 10 % point (-2.59) and the median (-1.56)
    short = pairs.unit_root_lags(timed(spark, z[:9]), "x", 6, key=["symbol"]).collect()
    assert [(x.rho, x.t, x.p) for x in short] == [(None, None, None)]


def test_unit_root_p_at_tabulated_points(spark):
    df = spark.createDataFrame([(-3.43,), (-2.86,), (-2.57,), (-20.0,), (3.0,)], "t double")
    got = [r.p for r in df.select(pairs.unit_root_p(F.col("t")).alias("p")).collect()]
    assert got == pytest.approx([0.01, 0.05, 0.10, 0.0, 1.0], abs=2e-3)


def test_overfit_logit_is_positive_for_a_best_that_fails(spark):
    train = [1.2, 0.4, 2.5, -0.3, 0.9, 1.7]
    for test, want in (([0.3, 0.8, -0.6, 0.5, 0.1, 0.2], 2.3978952727983707), ([0.3, 0.8, 1.6, 0.5, 0.1, 0.2], -2.3978952727983707)):
        df = spark.createDataFrame(list(zip("abcdef", train, test)), "trial string, a double, b double")
        r = folds.overfit_statistics(df, train="a", test="b", trial="trial").first()
        assert (r.n, r.logit) == (6, pytest.approx(want, abs=1e-12))
    r = folds.overfit_statistics(df.where("trial < 'd'"), train="a", test="b", trial="trial").first()
    assert (r.n, r.logit, r.spearman) == (3, None, None)


def test_spa_masks_match_numpy_on_the_same_draws(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 0.01, (120, 4)) + np.array([0.0015, -0.0005, -0.004, 0.0002])
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(i, names[j], float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], "i int, s string, x double")
    times = spark.createDataFrame([(i, i, 120) for i in range(120)], "i int, __at long, __n long")
    draws = inference.stationary_draws(times, 150, key=[], at="__at", n="__n", seed=1).orderBy("replicate", "p").collect()
    at = np.array([r["at"] for r in draws]).reshape(150, 120)
    mean, root = x.mean(0), math.sqrt(120)
    boot = (x[at].mean(1) - mean) * root
    sd = boot.std(0, ddof=1)
    z, t = boot / sd, mean * root / sd
    fair = t >= -math.sqrt(2 * math.log(max(math.log(120), 1.0)))
    want = [(np.sum(z[:, m].max(1) >= t.max()) + 1) / 151 for m in (np.ones(4, bool), fair, mean >= 0)]
    r = inference.reality_check(df, "s", "x", "i", 150).first()
    assert [r.p_spa_lower, r.p_spa, r.p_spa_upper] == pytest.approx(want, abs=1e-12)
    assert r.p_spa_lower >= r.p_spa >= r.p_spa_upper and r.p_hansen_lower <= r.p_hansen <= r.p_hansen_upper
    none = inference.reality_check(df.withColumn("x", F.col("x") - 0.1), "s", "x", "i", 150).first()
    assert none.p_spa_upper == pytest.approx(1 / 151)


def swings(spark, prices):
    rows = [("a", 5 + i, float(p), True, False) for i, p in enumerate(prices)]
    return spark.createDataFrame(rows, "symbol string, confirmed_idx long, high double, is_high boolean, is_low boolean").withColumn("low", F.col("high") - 1)


def centroid_loop(prices, most):
    z = [[p, 1] for p in sorted(prices)]
    while len(z) > 1:
        gaps = [(z[i + 1][0] / z[i + 1][1] - z[i][0] / z[i][1]) / (z[i][0] / z[i][1]) for i in range(len(z) - 1)]
        j = gaps.index(min(gaps))
        if gaps[j] > most:
            break
        z[j : j + 2] = [[z[j][0] + z[j + 1][0], z[j][1] + z[j + 1][1]]]
    return [(round(s / n, 9), n) for s, n in z]


def test_zones_of_a_chain_of_close_prices(spark):
    chain = [100 * 1.005**i for i in range(10)]
    got = levels.zones(swings(spark, chain), 24, 96, 0.006, 1, key=["symbol"]).where("at = 24").orderBy("level").collect()
    assert [(round(r.level, 9), r.strength) for r in got] == [(round((chain[i] + chain[i + 1]) / 2, 9), 2) for i in range(0, 10, 2)]
    for seed in range(6):
        rng = np.random.default_rng(seed)
        prices = np.round(100 * np.exp(rng.normal(0, 0.02, 14)), 4).tolist() + [101.0, 101.0]
        got = levels.zones(swings(spark, prices), 24, 96, 0.004, 1, key=["symbol"], merge="centroid").where("at = 24").orderBy("level").collect()
        assert [(round(r.level, 9), r.strength) for r in got] == centroid_loop(prices, 0.004)
    one = levels.zones(swings(spark, [50.0]), 24, 96, 0.004, 1, key=["symbol"], merge="centroid").where("at = 24").collect()
    assert [(r.level, r.strength) for r in one] == [(50.0, 1)]


def test_zones_of_prices_of_zero(spark):
    got = levels.zones(swings(spark, [0.0, 0.0, 0.01, 0.01, 5.0, 0.0]), 24, 96, 0.02, 1, key=["symbol"]).where("at = 24").orderBy("level").collect()
    assert [(r.level, r.strength) for r in got] == [(0.0, 3), (0.01, 2), (5.0, 1)]


def test_decimals_are_rounded_as_sql_does(spark, duck):
    tie = 2.4782154333333333 - 2.4730399333333333  # 0.0051754999999999996, whose product with 10^6 is a tie
    rng = np.random.default_rng(3)
    x = [tie, -tie, 0.0, 1e300, 1e305, -1e305, 123456789.0000005, float("inf"), float("nan"), None, *(float(a - b) for a, b in rng.integers(1, 10**7, (3000, 2)) / 9e7)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, x double")
    got = [(r.x, r.y) for r in tidy(df).join(df.select("i", rounded("x", 4).alias("y")), "i").orderBy("i").collect()]
    assert got[0] == (0.005176, 0.0052)
    want = [duck.execute("SELECT round(?::DOUBLE, 6), round(?::DOUBLE, 4)", [v, v]).fetchone() for v in x]
    assert [str(r) for r in got] == [str(r) for r in want]


def test_importance_does_not_depend_on_the_number_of_rows(spark):
    def forecast(d):
        return d.withColumn("p", 1 / (1 + F.exp(-3 * F.col("u"))))

    got = {}
    for n in (200, 5000, 20_000):
        rng = np.random.default_rng(n)
        u = rng.normal(size=n)
        y = (rng.random(n) < 1 / (1 + np.exp(-3 * u))).astype(int)
        df = spark.createDataFrame([(i, float(a), float(b), int(c)) for i, (a, b, c) in enumerate(zip(u, rng.normal(size=n), y))], "id int, u double, v double, y int")
        got[n] = {r.feature: r.importance for r in meta.permutation_importance(forecast, df, ["u", "v"], "y", order=["id"], repeats=3).collect()}
        assert got[n]["v"] == pytest.approx(0.0, abs=1e-9)
    assert got[5000]["u"] == pytest.approx(got[20_000]["u"], rel=0.08)
    assert got[200]["u"] == pytest.approx(got[20_000]["u"], rel=0.35)


def test_a_permutation_moves_every_value_once(spark):
    df = spark.range(0, 9000).select(F.col("id"), F.col("id").cast("double").alias("v"))
    at = meta._shuffled_place(df, "at", 9000, [1], ["id"]).select("at").orderBy("at").collect()
    assert [r.at for r in at] == list(range(9000))
