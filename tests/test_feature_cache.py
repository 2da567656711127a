"""The read-through feature cache: what is there is read, what is missing is computed once."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators import registry, rolling
from tidemark.operators.rolling import last_k

T0 = datetime(2024, 1, 1)
NAMES = ["cache_mean", "cache_gap"]


@registry.feature("cache_mean", lookback=timedelta(days=2))
def _mean(df):
    return df.withColumn("cache_mean", rolling.rolling(F.avg, F.col("close"), last_k(24, ["symbol"]), 24))


@registry.feature("cache_gap", deps=("cache_mean",))
def _gap(df):
    return df.withColumn("cache_gap", F.col("close") - F.col("cache_mean"))


def bars(spark, symbols, days=30):
    rows = [(s, f"{T0 + timedelta(hours=h)}", float((h * 7 + i * 13) % 50)) for i, s in enumerate(symbols) for h in range(24 * days)]
    return spark.createDataFrame(rows, "symbol string, at string, close double").select("symbol", F.col("at").cast("timestamp").alias("ts"), "close")


def values(df):
    return sorted((r.symbol, r.ts, r.cache_mean, r.cache_gap) for r in df.collect())


def test_only_missing_periods_are_computed(spark, tmp_path, monkeypatch):
    root, asked = str(tmp_path / "features"), []
    compute = registry.compute
    monkeypatch.setattr(registry, "compute", lambda b, names, start, end, **k: (asked.append((tuple(sorted(names)), start, end)), compute(b, names, start, end, **k))[1])
    b = bars(spark, ["a", "b"])

    def read(start, end, symbols=b, names=NAMES):
        n = len(asked)
        got = values(registry.read_through(symbols, names, start, end, root, unit="week"))
        assert got == values(compute(symbols, NAMES, start, end, keys=["symbol"]))
        covered = spark.read.parquet(f"{root}/coverage").count()
        return len(asked) - n, covered

    day = lambda n: T0 + timedelta(days=n)
    assert read(day(7), day(14)) == (1, 4)  # one week, two symbols, two features
    assert asked[-1] == (("cache_gap", "cache_mean"), day(7), day(14))
    assert read(day(7), day(14)) == (0, 4)  # nothing
    assert read(day(9), day(12)) == (0, 4)  # a part of it
    assert read(day(7), day(21)) == (1, 8) and asked[-1][1:] == (day(14), day(21))  # one more week
    assert read(day(14), day(24)) == (1, 12) and asked[-1][1:] == (day(21), day(24))  # a week begun
    assert read(day(21), day(26)) == (1, 16)  # and carried on
    three = bars(spark, ["a", "b", "c"])
    assert read(day(7), day(14), three) == (1, 18)  # the new symbol alone
    assert read(day(7), day(26), b) == (0, 18)


def test_a_symbol_without_rows_and_unknown_features(spark, tmp_path):
    b = bars(spark, ["a"], days=3)
    assert registry.read_through(b, NAMES, T0 + timedelta(days=60), T0 + timedelta(days=70), str(tmp_path / "x")).count() == 0
    with pytest.raises(KeyError):
        registry.read_through(b, ["no_such"], T0, T0 + timedelta(days=2), str(tmp_path / "y")).count()
