"""First touches, extremes ahead and chains against plain loops and the streamed machines."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators import chains, events, pairs, scans, touch

KEY = ["symbol"]


def series(spark, seed, n, keys=2, levels=12):
    r = random.Random(seed)
    rows = []
    for k in range(keys):
        p = 50.0
        for i in range(n if k == 0 else n // 3):
            p = max(1.0, p + r.randint(-levels, levels) / 8)
            rows.append((f"k{k}", i, i * 60 + 7 * k, p, p + r.random(), p - r.random(), r.choice([0, 0, 0, 1, -1]), r.choice([0.5, 1.0, 2.0]), r.choice([0.5, 1.5]), r.random() < 0.05))
    return spark.createDataFrame(rows, "symbol string, idx long, s long, close double, high double, low double, sig int, stop double, target double, leave boolean").withColumn("ts", F.timestamp_seconds("s")).coalesce(2)


@pytest.mark.parametrize("horizon", [1, 64, 100, 1440])
def test_first_touch_and_extremes_match_loops(spark, horizon):
    df = series(spark, horizon, 700).cache()
    got = touch.first_touch(df, df, horizon, lambda k, _: (k["hi"] >= F.col("close") + 2 * F.col("target")) | (k["lo"] <= F.col("close") - 2 * F.col("stop")), key=KEY)
    got = touch.extremes_ahead(got, df, horizon, key=KEY)
    rows = {(r.symbol, r.idx): r for r in df.collect()}
    for r in got.collect():
        ahead = [rows[r.symbol, i] for i in range(r.idx + 1, r.idx + horizon + 1) if (r.symbol, i) in rows]
        want = next((b.idx for b in ahead if b.high >= r.close + 2 * r.target or b.low <= r.close - 2 * r.stop), None)
        assert r.touch_idx == want
        assert (r.ahead_high, r.ahead_low) == ((max(b.high for b in ahead), min(b.low for b in ahead)) if ahead else (None, None))


def test_rows_of_a_touch_grow_with_the_logarithm_of_the_horizon(spark):
    """An event is one row of each join, and joins are 2 levels - 1; a range join makes a row for each bar ahead."""
    df = series(spark, 3, 500)
    joins = {}
    for h in (24, 1440, 100_000):
        plan = touch.first_touch(df, df, h, lambda k, _: k["hi"] >= F.col("close") * 2, key=KEY)._jdf.queryExecution().optimizedPlan().toString()
        joins[h] = plan.count("Join LeftOuter")
        assert "Generate explode(sequence" not in plan
    assert joins == {24: 1, 1440: 3, 100_000: 5}


def test_triple_barrier_by_touch_matches_the_path(spark):
    df = series(spark, 5, 400).withColumn("eid", F.concat_ws("-", "symbol", "idx"))
    for side in (None, F.col("sig").cast("double")):
        a = events.triple_barrier(df, df, 90, F.lit(0.05), F.when(F.col("idx") % 7 > 0, 0.04), key=KEY, event_id="eid", side=side)
        b = events.triple_barrier(df, df, 90, F.lit(0.05), F.when(F.col("idx") % 7 > 0, 0.04), key=KEY, event_id="eid", side=side, by_path=True)
        assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


@pytest.mark.parametrize(("trail", "hold"), [(False, 1), (False, 90), (True, 5)])
def test_bracket_chain_equals_the_streamed_latch(spark, trail, hold):
    df = series(spark, hold, 300).withColumn("close", F.when(F.col("idx") % 17 != 3, F.col("close")))
    args = ("sig", "close", "stop", "target", hold)
    want = scans.bracket_latch(df, *args, key=KEY, trail=trail, exit_flag="leave").select("symbol", "idx", "latched")
    got = chains.bracket_chain(df, *args, key=KEY, trail=trail, exit_flag="leave", block_seconds=3600).select("symbol", "idx", "latched")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("gap", [1, 200])
def test_cooldown_chain_equals_the_streamed_one(spark, gap):
    df = series(spark, gap, 300).where("sig = 1").select("symbol", (F.col("s") / 120).cast("long").alias("s"))
    want = scans.cooldown(df, "s", gap / 100, key=KEY)
    got = chains.cooldown_chain(df, "s", gap / 100, key=KEY)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_step_fill_chain_equals_the_streamed_one(spark):
    df = series(spark, 11, 400).select("symbol", "idx", F.when(F.col("idx") % 9 > 0, F.col("close")).alias("close"))
    want = events.price_step_fills(df, 0.02, key=KEY)
    got = chains.step_fill_chain(df, 0.02, key=KEY)
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def scored(spark, seed):
    df = series(spark, seed, 600)
    return df.select("symbol", "ts", ((F.col("close") - 50) / 4).alias("z"), F.col("close").alias("resid"))


def test_pair_trade_chain_equals_the_streamed_one(spark):
    df = scored(spark, 21)
    want = pairs.pair_trades(df, "z", 1.0, 0.25, 4.0, 48, key=KEY).select("symbol", "ts", "trade", "pnl", "held")
    got = chains.pair_trade_chain(df, "z", 1.0, 0.25, 4.0, 48, key=KEY)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("delay", [1, 3])
def test_pair_trades_with_delay_match_a_loop(spark, delay):
    df = scored(spark, 23)
    want = []
    for symbol in ("k0", "k1"):
        rows = [(r.z, r.resid, r.ts) for r in df.where(F.col("symbol") == symbol).orderBy("ts").collect()]
        last, busy, trade = len(rows) - 1, -1, 0
        for call, (z, _, _) in enumerate(rows):
            if call <= busy or not 1.0 <= abs(z) < 4.0:
                continue
            fill, end = min(call + delay, last), min(call + 30, last)
            close = next((t for t in range(fill + 1, end + 1) if abs(rows[t][0]) <= 0.25 or abs(rows[t][0]) >= 4.0), end)
            busy, trade = min(close + delay, last), trade + 1
            want.append((symbol, rows[busy][2], trade, (rows[busy][1] - rows[fill][1]) * (-1 if z > 0 else 1), busy - fill))
    got = chains.pair_trade_chain(df, "z", 1.0, 0.25, 4.0, 30, key=KEY, delay=delay, cross=False, open_end=True)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_chains_of_nothing(spark):
    df = series(spark, 1, 10).where("idx < 0")
    assert chains.cooldown_chain(df.select("symbol", "s"), "s", 5, key=KEY).count() == 0
    assert chains.bracket_chain(df, "sig", "close", "stop", "target", 5, key=KEY).count() == 0
