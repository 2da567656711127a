"""Operators against small literals of their definitions."""

import os
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import book, events, folds, inference, joins, returns, scans
from tidemark.operators.grid import forward_fill
from tidemark.sources import market

T0 = datetime(2024, 1, 1)


def at(h):
    return T0 + timedelta(hours=h)


def test_ewm_matches_pandas_across_nulls_and_blocks(spark):
    xs = [None, 1.0, 2.0, None, None, 4.0, 8.0, None, 3.0]
    df = spark.createDataFrame([("a", at(i), x) for i, x in enumerate(xs)], "symbol string, ts timestamp, x double")
    got = [r["y"] for r in scans.ewm(df, "x", 0.3, "y", key=["symbol"]).orderBy("ts").collect()]
    want = pd.Series(xs, dtype=float).ewm(alpha=0.3, adjust=False).mean()
    assert np.allclose([np.nan if g is None else g for g in got], want, equal_nan=True)
    d = spark.createDataFrame([("a", i, 0.5, float(i)) for i in range(50)], "symbol string, ts int, a double, b double")
    rows = scans.affine_scan(d, "a", "b", "y", key=["symbol"], block=7).orderBy("ts").collect()
    y = 0.0
    for r in rows:
        y = 0.5 * y + r["b"]
        assert abs(r["y"] - y) < 1e-9


def test_asof_keeps_a_null_of_the_matched_row(spark):
    left = spark.createDataFrame([("a", at(1)), ("a", at(30)), ("b", at(1))], "symbol string, ts timestamp")
    right = spark.createDataFrame([("a", at(0), 1.0), ("a", at(29), None)], "symbol string, ts timestamp, v double")
    got = {(r["symbol"], r["ts"]): r["v"] for r in joins.asof_join(left, right, ["v"], key=["symbol"]).collect()}
    assert got == {("a", at(1)): 1.0, ("a", at(30)): None, ("b", at(1)): None}
    assert joins.asof_join(left, right, ["v"], key=["symbol"], how="inner").count() == 2
    assert joins.asof_join(left, right.limit(0), ["v"], key=["symbol"]).count() == 3


def test_asof_carries_over_many_blocks(spark):
    left = spark.createDataFrame([("a", at(24 * d)) for d in range(1, 9)], "symbol string, ts timestamp")
    right = spark.createDataFrame([("a", at(1), 5.0)], "symbol string, ts timestamp, v double")
    got = [r["v"] for r in joins.asof_join(left, right, ["v"], key=["symbol"], block_seconds=3600).collect()]
    assert got == [5.0] * 8


def test_forward_fill_limit(spark):
    df = spark.createDataFrame([("a", at(i), 1.0 if i == 0 else None) for i in range(4)], "symbol string, ts timestamp, x double")
    assert [r["x"] for r in forward_fill(df, ["x"], key=["symbol"], most_rows=2).orderBy("ts").collect()] == [1.0, 1.0, 1.0, None]


def test_interval_algebra_and_folds():
    assert folds.merge_intervals([(1, 3), (2, 5), (7, 8)]) == [(1, 5), (7, 8)]
    assert folds.subtract_intervals([(0, 10)], [(2, 3), (9, 12)]) == [(0, 2), (3, 9)]
    rows = folds.combinatorial_folds(T0, T0 + timedelta(days=6), 6, 2, purge=timedelta(hours=1), embargo=timedelta(hours=2))
    assert len({r[0] for r in rows}) == 15
    for fold in {r[0] for r in rows}:
        test = [(a, b) for f, role, a, b in rows if f == fold and role == "oos"]
        train = [(a, b) for f, role, a, b in rows if f == fold and role == "train"]
        for a, b in train:
            assert all(b <= x - timedelta(hours=1) or a >= y + timedelta(hours=2) for x, y in test)
    with pytest.raises(ValueError):
        folds.train_test(T0, T0 + timedelta(days=1), 0.99, timedelta(days=1))


def test_month_store_round_trip_and_upsert(spark, tmp_path):
    path = str(tmp_path / "bars")
    assert market.scan(spark, path, market.BARS).count() == 0
    rows = [("a", at(24 * d), 1.0, 2.0, 0.5, 1.5, float(d)) for d in (0, 1, 40)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    market.write_months(df, path)
    assert market.scan(spark, path, market.BARS, symbols=["a"], start=at(24), end=at(24 * 40)).count() == 1
    market.upsert_months(spark, path, market.BARS, df.where("volume = 1").withColumn("close", F.lit(9.0)), key=["symbol"])
    got = {r["volume"]: r["close"] for r in market.scan(spark, path, market.BARS).collect()}
    assert got == {0.0: 1.5, 1.0: 9.0, 40.0: 1.5}


def test_book_contract(spark):
    b = book.declare(spark.createDataFrame([(0.1, 0.2)], "liq double, pnl240 double"), {"liq": 0, "pnl240": 240})
    assert book.causal_filter(b, F.col("liq") > 0, ["liq"]).count() == 1
    with pytest.raises(ValueError):
        book.causal_filter(b, F.col("pnl240") > 0, ["pnl240"])
    with pytest.raises(ValueError):
        book.causal_filter(b, F.col("pnl240") > 0, ["liq"])
    assert book.asof(book.add(b, "x", F.col("liq") + F.col("pnl240"), ["liq", "pnl240"]))["x"] == 240


def test_causality_diff_finds_a_peek(spark):
    df = spark.createDataFrame([("a", at(i), float(i)) for i in range(10)], "symbol string, ts timestamp, x double")
    from pyspark.sql import Window

    w = Window.partitionBy("symbol").orderBy("ts")
    peek = lambda d: d.withColumn("y", F.lead("x").over(w))
    fair = lambda d: d.withColumn("y", F.lag("x").over(w))
    args = (df, ["x"], F.lit(str(at(5))).cast("timestamp"), ["y"])
    assert joins.causality_diff(peek, *args, key=["symbol"]).count() == 1
    assert joins.causality_diff(fair, *args, key=["symbol"]).count() == 0


def test_noise_is_not_called_skill(spark):
    rng = np.random.default_rng(3)
    noise = rng.normal(0, 0.01, (250, 4))
    noise[:, 3] += 0.006
    names = ["a", "b", "c", "win"]
    df = spark.createDataFrame([(i, names[j], float(x)) for i, r in enumerate(noise) for j, x in enumerate(r)], "i int, s string, x double")
    got = {r["strategy"]: r for r in inference.reality_check(df, "s", "x", "i", 200).collect()}
    assert got["win"]["p_step"] < 0.05 and got["win"]["p_reality"] < 0.05
    only = {r["strategy"]: r for r in inference.reality_check(df.where("s <> 'win'"), "s", "x", "i", 200).collect()}
    assert min(r["p_step"] for r in only.values()) > 0.05
    assert min(r["p_step"] for r in got.values()) >= 1 / 201
    assert only["a"]["p_hansen_lower"] <= only["a"]["p_hansen"] <= only["a"]["p_hansen_upper"]


def resampled(x, rng):
    """One stationary bootstrap sample, place by place."""
    out, at = [], 0
    for i in range(len(x)):
        at = int(rng.integers(len(x))) if i == 0 or rng.random() < len(x) ** (-1 / 3) else (at + 1) % len(x)
        out.append(x[at])
    return np.array(out)


def sharpe_of(x):
    return x.mean() / x.std(ddof=1) * np.sqrt(365)


def test_bootstrap_of_every_key(spark):
    rng = np.random.default_rng(4)
    rows = [(k, i, float(x)) for k, n, mu in (("a", 300, 0.002), ("b", 120, -0.002), (None, 60, 0.0)) for i, x in enumerate(rng.normal(mu, 0.01, n))] + [("one", 0, 0.5), ("a", 999, None)]
    df = spark.createDataFrame(rows, "symbol string, i int, r double")
    drawn = inference.bootstrap_by_key(df, "r", ["i"], 200, 365.0, key=["symbol"]).cache()
    got = {r["symbol"]: r for r in inference.interval(drawn, "sharpe", key=["symbol"]).collect()}
    assert {k: r["n"] for k, r in got.items()} == {"a": 200, "b": 200, None: 200, "one": 200}
    for k in ("a", "b"):
        x = np.array([r for s, _, r in rows if s == k and r is not None])
        old = np.quantile([sharpe_of(resampled(x, rng)) for _ in range(2000)], [0.025, 0.5, 0.975])
        assert all(abs(got[k][c] - o) < 0.25 * (old[2] - old[0]) for c, o in zip(("lo", "median", "hi"), old))
    shuffled = inference.bootstrap_by_key(df, "r", ["i"], 50, 365.0, key=["symbol"], permute=True)
    spread = shuffled.where("symbol = 'a'").agg((F.max("total_return") - F.min("total_return")).alias("d"), F.countDistinct("max_drawdown").alias("n")).first()
    assert spread["d"] < 1e-9 and spread["n"] > 10
    only = drawn.where("symbol = 'one'").first()
    assert (only["sharpe"], only["max_drawdown"]) == (0.0, 0.0) and abs(only["total_return"] - 0.5) < 1e-12
    assert 0 < drawn.where("symbol = 'b'").agg(F.min("max_drawdown")).first()[0] < 1


def test_round_trips_counts_spells(spark):
    pos = [0, 1, 1, 0, -1, -1, 1, 0]
    df = spark.createDataFrame([("a", at(i), float(p), 0.1) for i, p in enumerate(pos)], "symbol string, ts timestamp, position double, net double")
    got = returns.round_trips(df, key=["symbol"]).orderBy("entry").collect()
    assert [(r["bars"], r["direction"]) for r in got] == [(2, "long"), (2, "short"), (1, "long")]
    assert abs(got[0]["pnl"] - (1.1**2 - 1)) < 1e-12


def test_permuted_keeps_marginals_and_cuts_links(spark):
    rows = [(k, i, float(i), "x") for k in ("a", "b", None) for i in range(40)]
    df = spark.createDataFrame(rows, "symbol string, t long, v double, w string")
    got = [tuple(r) for r in inference.permuted(df, ["v"], key=["symbol"], order="t").collect()]
    assert [len(got), got == rows] == [len(rows), False]
    assert sorted((str(k), v) for k, _, v, _ in got) == sorted((str(k), v) for k, _, v, _ in rows)
    assert sorted((str(k), t) for k, t, _, _ in got) == sorted((str(k), t) for k, t, _, _ in rows)
    assert sorted(map(str, got)) == sorted(map(str, (tuple(r) for r in inference.permuted(df.repartition(3), ["v"], key=["symbol"], order="t").collect())))
    assert inference.permuted(df.limit(0), ["v"], key=["symbol"], order="t").count() == 0
    moved = inference.displaced(df, "v", "t", share=0.1).collect()
    assert all(0.9 * r["t"] - 1e-9 <= r["v"] <= 1.1 * r["t"] + 1e-9 for r in moved) and any(r["v"] != r["t"] for r in moved)


def test_stop_breaker_counts_kept_stops_only(spark):
    at_ = [0, 1, 2, 3, 11, 12, 13, 30]
    df = spark.createDataFrame([("a", s, i, True) for i, s in enumerate(at_)] + [("b", 5, 0, None), ("b", 5, 1, True)], "symbol string, s long, id long, stopped boolean")
    kept, recent = [], []
    for s in at_:
        if len([x for x in recent if s - x <= 10]) < 2:
            kept.append(s)
            recent.append(s)
    got = events.stop_breaker(df, 10, 2, key=["symbol"], at="s", stopped="stopped", tie=["id"]).collect()
    assert sorted(r["s"] for r in got if r["symbol"] == "a") == kept
    assert sorted(r["id"] for r in got if r["symbol"] == "b") == [0, 1]


def test_latch_in_blocks_is_the_latch(spark):
    rng = np.random.default_rng(8)
    rows = [(k, at(i), *[None if rng.random() < 0.03 else bool(rng.random() < p) for p in (0.1, 0.1, 0.1, 0.1)]) for k in ("a", "b", None) for i in range(200)]
    df = spark.createDataFrame(rows, "symbol string, ts timestamp, li boolean, lo boolean, si boolean, so boolean").where("symbol IS NOT NULL OR ts > '2024-01-02'")
    want = {(r["symbol"], r["ts"]): r["latched"] for r in scans.latch(df, "li", "lo", "si", "so", key=["symbol"]).collect()}
    for seconds in (3600, 50_000, 10**9):
        got = {(r["symbol"], r["ts"]): r["latched"] for r in scans.latch(df.where("symbol IS NOT NULL"), "li", "lo", "si", "so", key=["symbol"], block_seconds=seconds).collect()}
        assert got == {k: v for k, v in want.items() if k[0] is not None}


def test_scan_reports_failures_and_goes_on(spark):
    from tidemark.operators import sweep
    from pyspark.sql import types as T

    class Count:
        def __init__(self, symbol):
            self.n, self.last = 0, None
            if symbol == "bad":
                raise ValueError("no such symbol")

        def add(self, rows):
            assert self.last is None or rows["ts"].iloc[0] >= self.last
            self.n, self.last = self.n + len(rows), rows["ts"].iloc[-1]

        def rows(self):
            import pandas as pd

            return pd.DataFrame({"n": [self.n]})

    df = spark.createDataFrame([(k, at(i), 1.0) for k in ("a", "bad", "c") for i in range(30)], "symbol string, ts timestamp, close double")
    got = {r["symbol"]: (r["n"], r["error"]) for r in sweep.scan_symbols(df, Count, T.StructType([T.StructField("n", T.LongType())])).collect()}
    assert got == {"a": (30, None), "bad": (None, "ValueError: no such symbol"), "c": (30, None)}


def test_features_are_resolved_and_warm(spark):
    from datetime import datetime, timedelta

    from tidemark.operators import registry

    registry.feature("t_prev", lookback=timedelta(hours=1))(lambda d: d.withColumn("t_prev", F.lag("close").over(Window.partitionBy("symbol").orderBy("ts"))))
    registry.feature("t_twice", deps=("t_prev",), lookback=timedelta(hours=1))(lambda d: d.withColumn("t_twice", F.lag("t_prev").over(Window.partitionBy("symbol").orderBy("ts"))))
    registry.feature("t_round", deps=("t_square",))(lambda d: d)
    registry.feature("t_square", deps=("t_round",))(lambda d: d)
    df = spark.createDataFrame([("a", at(i), float(i)) for i in range(20)], "symbol string, ts timestamp, close double")
    assert registry.warm_up(["t_twice"]) == timedelta(hours=2)
    start = datetime.fromisoformat(str(at(5)))
    got = registry.compute(df, ["t_twice"], start, start + timedelta(hours=3), keys=["symbol"]).orderBy("ts").collect()
    assert [r["t_twice"] for r in got] == [3.0, 4.0, 5.0]
    with pytest.raises(ValueError):
        registry.resolved(["t_round"])
    with pytest.raises(KeyError):
        registry.resolved(["t_nothing"])


def test_many_intervals_take_the_bucketed_join(spark, monkeypatch):
    df = spark.createDataFrame([("a", at(i)) for i in range(60)], "symbol string, ts timestamp")
    spans = spark.createDataFrame([(str(k), "r", at(7 * k), at(7 * k + 3)) for k in range(8)] + [("long", "r", at(0), at(50)), ("none", "r", at(9), at(9))], "fold string, role string, start timestamp, end timestamp")
    rows = lambda d: sorted((r["ts"], r["fold"]) for r in d.collect())
    want, inside = rows(joins.assign_folds(df, spans)), joins.in_any_interval(df, spans).count()
    monkeypatch.setattr(joins, "MOST_INTERVALS", 2)
    assert rows(joins.assign_folds(df, spans)) == want and joins.in_any_interval(df, spans).count() == inside > 50


def test_points_within_a_radius_in_four_dimensions(spark):
    rng = np.random.default_rng(9)
    x = rng.random((120, 4))
    df = spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "pid int, a double, b double, c double, d double")
    got = {(r["p"], r["q"]) for r in joins.within_radius(df, ["a", "b", "c", "d"], 0.25).collect()}
    assert got == {(i, j) for i in range(120) for j in range(i + 1, 120) if np.linalg.norm(x[i] - x[j]) <= 0.25} and got


def test_points_at_the_edge_of_a_cell(spark):
    x = [0.0, 0.02, -1e-18, 0.04, -0.02, 5.0, 5.02, float("inf"), float("-inf"), float("nan"), None, 1e18, 1e300]
    df = spark.createDataFrame([(i, v, 0.5) for i, v in enumerate(x)], "pid int, x double, y double")
    at = [(i, v) for i, v in enumerate(x) if v is not None and np.isfinite(v)]
    for d in (df, df.withColumn("pid", 12 - F.col("pid"))):
        got = {(r["p"], r["q"]) for r in joins.within_radius(d, ["x", "y"], 0.02).collect()}
        want = {(i, j) for i, v in at for j, w in at if i < j and abs(v - w) <= 0.02}
        assert got == (want if d is df else {(12 - j, 12 - i) for i, j in want}) and (1, 2) in want


def test_tasks_of_a_radius_join_are_not_merged_by_bytes_and_few_copies_travel(spark, monkeypatch):
    df, sent = spark.range(3000).select("id", (F.rand(1) * 9).alias("x"), (F.rand(2) * 9).alias("y")), []
    monkeypatch.setattr(type(df), "join", lambda self, other, *a, f=type(df).join, **k: sent.append(other.count()) or f(self, other, *a, **k))
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert joins.within_radius(df, ["x", "y"], 0.02, pid="id").rdd.getNumPartitions() == 12 and 0 < max(sent) <= 4 * 3000
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_stationary_draws(spark):
    places = spark.createDataFrame([(k, i, n) for k, n in (("a", 64), ("b", 1)) for i in range(n)], "k string, i long, n long")
    got = inference.stationary_draws(places, 40, key=["k"], at="i", n="n").collect()
    assert len(got) == 40 * 65 and all(0 <= r["at"] < (64 if r["k"] == "a" else 1) for r in got)
    runs = {}
    for r in got:
        if r["k"] == "a":
            runs.setdefault(r["replicate"], {})[r["p"]] = r["at"]
    follow = np.mean([(d[p] + 1) % 64 == d[p + 1] for d in runs.values() for p in range(63)])
    assert 0.65 < follow < 0.85  # blocks of four on average
    dealt = inference.stationary_draws(places, 5, key=["k"], at="i", n="n", permute=True).where("k = 'a'").groupBy("replicate").agg(F.sort_array(F.collect_list("at")).alias("x")).collect()
    assert all(r["x"] == list(range(64)) for r in dealt)


def test_radius_pairs_do_not_depend_on_how_rows_are_dealt(spark, tmp_path):
    from tidemark.plans import registry

    rng = np.random.default_rng(5)
    rows = [(k, int(c), float(p)) for k, (c, p) in enumerate(zip(rng.integers(0, 40, 400), np.round(rng.random(400) * 4e5, 2)))]
    o = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double")
    want = {}
    for _, c, p in rows:
        n, s = want.get(c, (0, 0.0))
        want[c] = n + 1, s + p
    at = {c: (s / n / 100000.0, n / 10.0) for c, (n, s) in want.items()}
    gap = lambda a, b: float(np.sqrt((a[0] - b[0]) * (a[0] - b[0]) + (a[1] - b[1]) * (a[1] - b[1])))
    near = {(p, q): gap(at[p], at[q]) for p in at for q in at if p < q and gap(at[p], at[q]) <= 0.02}
    for parts in (1, 7):
        o.orderBy(F.rand(parts)).repartition(parts).write.parquet(f"{tmp_path}/{parts}/orders.parquet")
        got = {(r["p"], r["q"]): r["distance"] for r in registry.queries()["radius_pairs"](spark, f"{tmp_path}/{parts}").collect()}
        assert got == {k: float(np.floor(v * 1e6 + 0.5)) / 1e6 for k, v in near.items()} and got


def test_radius_pairs_sum_rows_as_the_files_hold_them(spark, tmp_path):
    import duckdb

    from tidemark.plans import registry

    rng = np.random.default_rng(11)
    o = pd.DataFrame({"o_orderkey": rng.permutation(15_000), "o_custkey": rng.integers(0, 1500, 15_000), "o_totalprice": rng.integers(100_000, 50_000_000, 15_000) / 100})
    o.loc[::50, "o_totalprice"] = None
    for parts in (1, 3):
        os.makedirs(folder := f"{tmp_path}/{parts}/orders.parquet")
        for k in range(parts):
            o[k * 15_000 // parts : (k + 1) * 15_000 // parts].to_parquet(f"{folder}/part-{k}.parquet", row_group_size=1000)
        duck = duckdb.connect()
        duck.execute("SET threads = 1")
        duck.execute(f"CREATE VIEW orders AS SELECT * FROM '{folder}/*.parquet'")
        want = duck.execute(registry.oracle_sql()["radius_pairs"]).fetchall()
        assert sorted(map(tuple, registry.queries()["radius_pairs"](spark, f"{tmp_path}/{parts}").collect())) == sorted(want) and len(want) > 2000


def test_throttle_of_a_batch_in_many_parts_and_no_order(spark, tmp_path, monkeypatch):
    from tidemark.plans import registry  # noqa: F401 - the modules of queries in their order
    from tidemark.plans.model_queries import drained
    from tidemark.streaming import live

    monkeypatch.setattr(live, "THROTTLE_ROWS", 5000, raising=False)
    t = np.random.default_rng(2).integers(0, 40_000_000, 25_000)
    pd.DataFrame({"symbol": "a", "ts_exchange": [*t.tolist(), *t[:100].tolist()]}).to_parquet(f"{tmp_path}/rows.parquet")  # Arrow hands over 10,000 rows at a time
    books = live.file_stream(spark, str(tmp_path), "symbol string, ts_exchange long")
    want, last = [], None
    for x in sorted(t.tolist()):
        if last is None or x - last >= 20_000:
            want.append(x)
            last = x
    assert sorted(r["ts_exchange"] for r in drained(live.throttle(books, 20_000)).collect()) == want


def test_adjusted_p_values_of_ties_and_nulls(spark):
    p = [0.01, 0.04, 0.04, 0.04, 0.2, None]
    rows = inference.haircut(spark.createDataFrame([(i, "a", x) for i, x in enumerate(p)], "i int, k string, p double"), "p", key=["k"]).orderBy("i").collect()
    c = sum(1 / k for k in range(1, 7))
    assert [r["p_holm"] for r in rows] == pytest.approx([0.06, 0.2, 0.2, 0.2, 0.4, 0.4])
    assert [r["p_bhy"] for r in rows] == pytest.approx([6 * c * 0.01, *[6 * c / 4 * 0.04] * 3, 6 * c / 5 * 0.2, 1.0])
    assert [r["p_bonferroni"] for r in rows] == pytest.approx([0.06, 0.24, 0.24, 0.24, 1.0, 1.0])


def test_frames_run_on_from_an_end(spark):
    df = spark.createDataFrame([(i, "a", i / 100) for i in range(9)], "i int, k string, p double")
    plans = [inference.haircut(df, "p", key=["k"]), joins.outer_align(df.select(F.col("k").alias("symbol"), F.timestamp_seconds("i").alias("ts"), "p"), "p")]
    for d in plans:  # a frame from each row to the last is read again for every row
        text = d._jdf.queryExecution().optimizedPlan().toString()
        assert "currentrow$(), unboundedfollowing$()" not in text and "sequence(" not in text.replace("sequence(0, 15", "")
