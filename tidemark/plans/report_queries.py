"""Queries over the report, level and registry operators, and the position helpers."""

from __future__ import annotations

import math
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import events, inference, levels, meta, metrics, pairs, registry, reports, returns, rolling, sweep
from tidemark.operators.grid import ordered
from tidemark.operators.joins import asof_join
from tidemark.operators.rolling import last_k
from tidemark.plans.base import BARS, HOUR_PPY, KEY, RETS, TRADES, W, bars, out, query, rounded, trades, with_returns
from tidemark.plans.event_queries import IDX, NET, SWING, indexed, netted
from tidemark.plans.metric_queries import DAILY, daily, phi
from tidemark.plans.recipe_sql import frame

SH = "CASE WHEN count(r) < 2 OR coalesce(stddev_samp(r), 0) = 0 THEN 0 ELSE avg(r) / stddev_samp(r) * sqrt(8760) END"
CUT = datetime(2024, 1, 20)
CUT_SQL = "epoch(TIMESTAMP '2024-01-20')"


#: (n, best): expected maximum of n standard normals, for each n of a CTE ``sizes``; the inverse by bisection.
BEST = (
    "ask AS (SELECT n, k, CASE WHEN k = 0 THEN 1 - 1.0::DOUBLE / n ELSE 1 - 1 / (n * exp(1)) END AS p FROM sizes CROSS JOIN range(2) r(k) WHERE n > 1), "
    f"bis AS (SELECT n, k, p, -9.0::DOUBLE AS lo, 9.0::DOUBLE AS hi, 0 AS i FROM ask UNION ALL SELECT n, k, p, CASE WHEN c < p THEN mid ELSE lo END, CASE WHEN c < p THEN hi ELSE mid END, i + 1 FROM (SELECT *, (lo + hi) / 2 AS mid, {phi('(lo + hi) / 2')} AS c FROM bis WHERE i < 50)), "
    "best AS (SELECT n, sum(CASE WHEN k = 0 THEN (1 - 0.5772156649015329) * lo ELSE 0.5772156649015329 * lo END) AS best FROM bis WHERE i = 50 GROUP BY n)"
)


def recursive(sql: str) -> str:
    return "WITH RECURSIVE " + sql.removeprefix("WITH ") if not sql.startswith("WITH RECURSIVE") else sql


TRIALS = RETS + f", tr AS (SELECT symbol || '-' || (t // 3600 % 24) AS trial, {SH} AS s FROM rets GROUP BY 1)"


def trial_sharpes(spark, sf):
    r = with_returns(spark, sf).withColumn("trial", F.concat_ws("-", "symbol", F.hour("ts").cast("string")))
    return r.groupBy("trial").agg(metrics.sharpe(F.col("r"), HOUR_PPY).alias("s"))


@query("spread_summary", out(BARS, "symbol n", "mean median p95 fallback_pct", "SELECT symbol, count(s) AS n, avg(s) AS mean, quantile_cont(s, 0.5) AS median, quantile_cont(s, 0.95) AS p95, avg((volume < 20)::INT) * 100 AS fallback_pct FROM (SELECT *, (high - low) / nullif(close, 0) * 1e4 AS s FROM bars) GROUP BY 1", 3))
def spread_summary(spark, sf):
    s = bars(spark, sf).select("symbol", (F.try_divide(F.col("high") - F.col("low"), F.col("close")) * 1e4).alias("spread_bps"), (F.col("volume") < 20).alias("fallback"))
    d = reports.spread_summary(s, key=KEY)
    return d.select("symbol", "n", *[rounded(c, 3).alias(c) for c in ("mean", "median", "p95", "fallback_pct")])


@query("trial_sharpe_summary", recursive(out(TRIALS + ", g AS (SELECT count(*) AS n, min(s) AS least, max(s) AS most, avg(s) AS mean, quantile_cont(s, 0.5) AS median, coalesce(stddev_samp(s), 0) AS std FROM tr), sizes AS (SELECT n FROM g), " + BEST, "n", "least most mean median std expected_best premium", "SELECT g.*, best * std AS expected_best, most - best * std AS premium FROM g JOIN best USING (n)", 4)))
def trial_sharpe_summary(spark, sf):
    d = reports.trial_summary(trial_sharpes(spark, sf), "s")
    return d.select("n", *[rounded(c, 4).alias(c) for c in ("least", "most", "mean", "median", "std", "expected_best", "premium")])


@query("trial_sharpe_histogram", out(TRIALS + ", e AS (SELECT min(s) AS a, max(s) AS b, least(30, greatest(5, count(s) // 2)) AS k FROM tr)", "bin n", "lo hi", "SELECT bin, n, a + bin * ((b - a) / k) AS lo, a + (bin + 1) * ((b - a) / k) AS hi FROM (SELECT least(k - 1, floor((s - a) / ((b - a) / k)))::INT AS bin, count(*) AS n FROM tr CROSS JOIN e GROUP BY 1) CROSS JOIN e", 4))
def trial_sharpe_histogram(spark, sf):
    d = reports.equal_width_counts(trial_sharpes(spark, sf), "s")
    return d.select("bin", "n", rounded("lo", 4).alias("lo"), rounded("hi", 4).alias("hi"))


@query("path_distribution", out(RETS + f", c AS (SELECT symbol, t // 432000 AS fold, {SH} AS s FROM rets GROUP BY 1, 2)", "symbol n_paths", "median mean std q25 q75 p05 p95 positive_pct above_1_pct", "SELECT symbol, count(*) AS n_paths, quantile_cont(s, 0.5) AS median, avg(s) AS mean, coalesce(stddev_samp(s), 0) AS std, quantile_cont(s, 0.25) AS q25, quantile_cont(s, 0.75) AS q75, quantile_cont(s, 0.05) AS p05, quantile_cont(s, 0.95) AS p95, avg((s > 0)::INT) * 100 AS positive_pct, avg((s > 1)::INT) * 100 AS above_1_pct FROM c GROUP BY 1", 4))
def path_distribution(spark, sf):
    r = with_returns(spark, sf).withColumn("fold", F.floor(F.unix_timestamp("ts") / 432000))
    d = reports.path_summary(r.groupBy("symbol", "fold").agg(metrics.sharpe(F.col("r"), HOUR_PPY).alias("s")), "s", key=KEY)
    return d.select("symbol", "n_paths", *[rounded(c, 4).alias(c) for c in d.columns[2:]])


_PSR = "(1 - skew * sr + (kurt + 2) / 4 * pow(sr, 2))"
MOMENTS = RETS + ", mo AS (SELECT symbol, count(r) AS n, avg(r) / nullif(stddev_samp(r), 0) AS sr, skewness(r) AS skew, kurtosis(r) AS kurt FROM rets GROUP BY 1)"


@query("deflated_sharpe", recursive(out(MOMENTS + ", sizes AS (SELECT count(*) AS n FROM mo), " + BEST + f", b AS (SELECT max(best) * (SELECT stddev_samp(sr) FROM mo) AS bench FROM best), z AS (SELECT symbol, n, sr, (sr - bench) * sqrt(n - 1) / sqrt(greatest(1e-12, {_PSR})) AS z FROM mo CROSS JOIN b)", "symbol n", "sr z psr", f"SELECT *, {phi('z')} AS psr FROM z", 5)))
def deflated_sharpe(spark, sf):
    """Probability that each symbol's Sharpe ratio exceeds the best of as many symbols without skill."""
    r = with_returns(spark, sf)
    one = r.groupBy("symbol").agg((F.avg("r") / F.nullif(F.stddev_samp("r"), F.lit(0.0))).alias("sr")).agg(F.count("sr").alias("n"), F.stddev_samp("sr").alias("sd")).first()
    d = inference.probabilistic_sharpe(r, "r", inference.expected_max_sharpe(one["n"], one["sd"] or 0.0), key=KEY)
    return d.select("symbol", "n", *[rounded(c, 5).alias(c) for c in ("sr", "z", "psr")])


DRIFT = DAILY + f""", f AS (SELECT symbol, t, ret, CASE WHEN count(ret) OVER {frame(5)} >= 5 THEN avg(ret) OVER {frame(5)} END / nullif(stddev_samp(ret) OVER {frame(5)}, 0) * sqrt(365) < -1 AS low, product(1 + ret) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS eq FROM day),
 h AS (SELECT *, 1 - eq / greatest(1.0, max(eq) OVER (PARTITION BY symbol ORDER BY t)) AS dd, CASE WHEN low IS NOT NULL THEN count(low) OVER (PARTITION BY symbol ORDER BY t) END AS i FROM f),
 g AS (SELECT symbol, count(ret) AS n, CASE WHEN coalesce(stddev_samp(ret), 0) = 0 THEN 0 ELSE avg(ret) / stddev_samp(ret) * sqrt(365) END AS sharpe, product(1 + ret) - 1 AS total_return, max(dd) AS max_drawdown, stddev_samp(ret) AS volatility,
   coalesce(max(i) - coalesce(max(i) FILTER (NOT low), 0), 0) AS streak, avg(ret) / nullif(stddev_samp(ret), 0) AS sr, skewness(ret) AS skew, kurtosis(ret) AS kurt FROM h GROUP BY 1),
 v AS (SELECT *, (sharpe - 1) / 2 AS z, sharpe BETWEEN -1 AND 3 AS in_interval, sr * sqrt(n - 1) / sqrt(greatest(1e-12, {_PSR})) AS pz FROM g)"""


@query("drift_verdict", out(DRIFT, "symbol n in_interval streak flag", "sharpe total_return max_drawdown volatility psr z", f"SELECT *, {phi('pz')} AS psr, CASE WHEN n < 10 THEN 'unknown' WHEN z < -1.5 OR streak >= 14 THEN 'alert' WHEN z < 0 OR streak >= 7 THEN 'warn' ELSE 'ok' END AS flag FROM v", 5))
def drift_verdict(spark, sf):
    d = reports.drift_verdict(daily(spark, sf), "ret", -1.0, 3.0, 365.0, key=KEY, window=5)
    return d.select("symbol", "n", "in_interval", "streak", "flag", *[rounded(c, 5).alias(c) for c in ("sharpe", "total_return", "max_drawdown", "volatility", "psr", "z")])


FUNDING = "fu AS (SELECT symbol, t, (close - open) / 1000 AS rate FROM bars WHERE t % 28800 = 0)"


def funding(b):
    return b.where(F.unix_timestamp("ts") % 28800 == 0).select("symbol", "ts", ((F.col("close") - F.col("open")) / 1000).alias("rate"))


@query("funding_and_forward", out(BARS + ", " + FUNDING + ", c AS (SELECT symbol, (t // 28800 * 28800)::BIGINT AS t, last(close ORDER BY t) AS close FROM bars GROUP BY symbol, t // 28800), n AS (SELECT symbol, t, lead(close) OVER w / nullif(close, 0) - 1 AS fwd FROM c " + W + "), j AS (SELECT n.symbol, n.fwd, fu.rate FROM n ASOF JOIN fu ON n.symbol = fu.symbol AND n.t >= fu.t WHERE fwd IS NOT NULL AND rate IS NOT NULL)", "symbol n", "corr mean_positive mean_negative", "SELECT symbol, count(*) AS n, corr(rate, fwd) AS corr, avg(fwd) FILTER (rate > 0) AS mean_positive, avg(fwd) FILTER (rate < 0) AS mean_negative FROM j GROUP BY 1"))
def funding_and_forward(spark, sf):
    b = bars(spark, sf)
    return reports.funding_and_forward(b, funding(b), "8 hours", key=KEY)


@query("funding_features", out(BARS + ", " + FUNDING + f", z AS (SELECT symbol, t, rate, CASE WHEN count(rate) OVER {frame(30)} >= 10 THEN (rate - avg(rate) OVER {frame(30)}) / nullif(stddev_samp(rate) OVER {frame(30)}, 0) END AS z FROM fu)", "symbol t", "funding_rate funding_z", "SELECT b.symbol, b.t, z.rate AS funding_rate, z.z AS funding_z FROM bars b ASOF LEFT JOIN z ON b.symbol = z.symbol AND b.t >= z.t"))
def funding_features(spark, sf):
    """The last funding rate and its z-score over 30 fundings, on bars."""
    b = bars(spark, sf)
    f = funding(b).withColumn("z", rolling.zscore(F.col("rate"), last_k(30, KEY), 10))
    return asof_join(b, f, ["rate", "z"], key=KEY).select("symbol", "ts", F.col("rate").alias("funding_rate"), F.col("z").alias("funding_z"))


@query("volatility_split", out(RETS + f", v AS (SELECT symbol, r, CASE WHEN count(r) OVER {frame(24)} >= 24 THEN stddev_samp(r) OVER {frame(24)} END AS vol, lead(r) OVER w AS nx FROM rets {W}), u AS (SELECT *, (rank() OVER (PARTITION BY symbol ORDER BY vol) + (count(*) OVER (PARTITION BY symbol, vol) - 1) / 2.0) / count(*) OVER (PARTITION BY symbol) AS p FROM v WHERE r IS NOT NULL AND vol IS NOT NULL AND nx IS NOT NULL)", "symbol regime n", "mean_abs mean autocorrelation vol_from vol_to share", "SELECT symbol, least(2, floor(p * 3))::INT AS regime, count(*) AS n, avg(abs(r)) AS mean_abs, avg(r) AS mean, corr(r, nx) AS autocorrelation, min(vol) AS vol_from, max(vol) AS vol_to, count(*) / sum(count(*)) OVER (PARTITION BY symbol) AS share FROM u GROUP BY 1, 2"))
def volatility_split(spark, sf):
    return reports.volatility_split(with_returns(spark, sf), "r", 24, 3, key=KEY)


@query("regime_gap_pooled", out(RETS, "symbol n", "gap", "SELECT coalesce(symbol, 'ALL') AS symbol, count(*) AS n, avg(r) FILTER (volume >= 25) - avg(r) FILTER (volume < 25) AS gap FROM rets WHERE r IS NOT NULL GROUP BY ROLLUP (symbol)"))
def regime_gap_pooled(spark, sf):
    return reports.regime_gap(with_returns(spark, sf), F.col("volume") >= 25, "r", "symbol")


@query("death_rates", out(IDX + ", l AS (SELECT symbol, max(idx) AS m FROM ix GROUP BY 1), e AS (SELECT x.symbol, x.idx + 24 > l.m AS ended, y.close / nullif(x.close, 0) - 1 AS mv FROM ix x JOIN l USING (symbol) LEFT JOIN ix y ON y.symbol = x.symbol AND y.idx = x.idx + 24 WHERE x.volume >= 8)", "symbol n", "halted still_down mean_move", "SELECT symbol, count(*) AS n, avg(ended::INT) AS halted, avg((mv < -0.2)::INT) FILTER (NOT ended) AS still_down, avg(mv) FILTER (NOT ended) AS mean_move FROM e GROUP BY 1"))
def death_rates(spark, sf):
    b = indexed(spark, sf)
    return reports.halts(b.where("volume >= 8").select("symbol", "idx", "close"), b, 24, 0.2, key=KEY)


@query("train_holdout_quantiles", out(BARS + f", x AS (SELECT CASE WHEN t >= {CUT_SQL} THEN 'holdout' ELSE 'train' END AS period, close, volume FROM bars), l AS (SELECT period, 'close' AS feature, close AS x FROM x UNION ALL SELECT period, 'volume', volume FROM x)", "feature period n", "q05 q25 q50 q75 q95", "SELECT feature, period, count(x) AS n, " + ", ".join(f"quantile_cont(x, {q / 100}) AS q{q:02d}" for q in (5, 25, 50, 75, 95)) + " FROM l GROUP BY 1, 2"))
def train_holdout_quantiles(spark, sf):
    return reports.period_quantiles(bars(spark, sf), ["close", "volume"], F.col("ts") >= F.lit(CUT))


MONTHS = TRADES + ", mn AS (SELECT symbol, date_trunc('month', entry) AS m, sum(pnl) / 1e6 AS ret FROM trades GROUP BY 1, 2)"


@query("month_streaks", out(MONTHS + ", g AS (SELECT *, sum((ret >= 0)::INT) OVER (PARTITION BY symbol ORDER BY m) AS g FROM mn), k AS (SELECT *, sum((ret < 0)::INT) OVER (PARTITION BY symbol, g) AS run FROM g)", "symbol n red green longest_red", "worst best", "SELECT symbol, count(*) AS n, count(*) FILTER (ret < 0) AS red, count(*) FILTER (ret > 0) AS green, max(run)::BIGINT AS longest_red, min(ret) AS worst, max(ret) AS best FROM k GROUP BY 1"))
def month_streaks(spark, sf):
    m = trades(spark, sf).groupBy("symbol", F.date_trunc("month", "entry").alias("month")).agg((F.sum("pnl") / 1e6).alias("ret"))
    return reports.month_streaks(m, "ret", key=KEY)


EQUITY = NET + ", eq AS (SELECT symbol, t, product(1 + net) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS equity, t // 432000 AS win, abs(position) * 0.0001 AS paid FROM g)"


def equity(spark, sf):
    d = netted(spark, sf).withColumn("equity", rolling.running_product(F.col("net"), KEY))
    return d.select("symbol", "ts", "equity", F.floor(F.unix_timestamp("ts") / 432000).alias("window"), (F.abs("position") * 0.0001).alias("paid"))


@query("stitched_windows", out(EQUITY + ", x AS (SELECT symbol, win, count(*) AS n, last(equity ORDER BY t) / nullif(first(equity ORDER BY t), 0) AS g, sum(paid) AS paid FROM eq GROUP BY 1, 2)", "symbol windows", "stitched_return paid", "SELECT symbol, count(*) AS windows, product(CASE WHEN n > 1 THEN g ELSE 1 END) - 1 AS stitched_return, sum(paid) AS paid FROM x GROUP BY 1"))
def stitched_windows(spark, sf):
    return reports.stitched(equity(spark, sf), "window", key=KEY, flows=["paid"])


@query("held_out_days", out(EQUITY + ", f AS (SELECT win, CASE WHEN row_number() OVER (ORDER BY win) % 2 = 0 THEN win * 432000 + 172800 END AS c FROM (SELECT DISTINCT win FROM eq)), x AS (SELECT e.*, f.c, row_number() OVER (PARTITION BY symbol, e.win ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY symbol, e.win) AS n FROM eq e JOIN f USING (win)), o AS (SELECT * FROM x WHERE CASE WHEN c IS NOT NULL THEN t >= c ELSE i >= floor(n * 0.75) END), r AS (SELECT symbol, t, equity / nullif(lag(equity) OVER (PARTITION BY symbol, win ORDER BY t), 0) - 1 AS r FROM o)", "symbol day bars", "ret", "SELECT symbol, (t // 86400 * 86400)::BIGINT AS day, product(1 + r) - 1 AS ret, count(*) AS bars FROM r WHERE r IS NOT NULL GROUP BY symbol, t // 86400"))
def held_out_days(spark, sf):
    """Daily returns out of sample: every second window has a cutoff, the others use their last quarter."""
    e = equity(spark, sf)
    f = e.select("window").distinct().withColumn("__n", F.row_number().over(Window.orderBy("window")))  # a few windows
    f = f.select("window", F.when(F.col("__n") % 2 == 0, F.timestamp_seconds(F.col("window") * 432000 + 172800)).alias("cutoff"))
    return reports.held_out_days(e, f, key=KEY)


_FLAGS = {
    "strong_sharpe": "s >= 1.5", "negative_sharpe": "s < 0", "all_windows_positive": "windows > 0 AND positive = windows", "all_windows_negative": "windows > 0 AND positive = 0",
    "one_window_positive": "windows > 1 AND positive = 1", "train_gap": "gap > 1", "one_window_dominates": "windows >= 3 AND top > 0.5", "no_trades": "n = 0", "few_trades": "n > 0 AND n < 50",
    "almost_no_position": "pct < 5", "low_activity": "pct >= 5 AND pct < 20", "inflated_sharpe": "s > 1 AND abs(ret) < 0.01", "one_trade_dominates": "largest > 30", "red_streak": "streak >= 3",
    "losses_dominate": "pf < 1", "thin_edge": "pf >= 1 AND pf < 1.3", "calendar_bias": "s > 0.5 AND ret < 0",
}
_FLAG_INPUTS = (
    NET + ", q AS (SELECT symbol, avg(net) / nullif(stddev_samp(net), 0) * sqrt(8760) AS s, product(1 + net) - 1 AS ret, avg((position <> 0)::INT) * 100 AS pct, count(*) FILTER (position <> 0) AS n, "
    "sum(net) FILTER (net > 0) / nullif(-sum(net) FILTER (net < 0), 0) AS pf FROM g GROUP BY 1), "
    "w0 AS (SELECT symbol, t // 432000 AS win, product(1 + net) - 1 AS r, avg(net) / nullif(stddev_samp(net), 0) * sqrt(8760) AS ws FROM g GROUP BY 1, 2), "
    "w1 AS (SELECT *, lag(ws) OVER k - ws AS d, sum((r >= 0)::INT) OVER k AS grp FROM w0 WINDOW k AS (PARTITION BY symbol ORDER BY win)), "
    "w2 AS (SELECT *, sum((r < 0)::INT) OVER (PARTITION BY symbol, grp) AS reds FROM w1), "
    "ww AS (SELECT symbol, count(*) AS windows, count(*) FILTER (r > 0) AS positive, max(d) AS gap, max(r) / nullif(sum(r) FILTER (r > 0), 0) AS top, max(reds) AS streak FROM w2 GROUP BY 1), "
    "dy AS (SELECT symbol, max(abs(r)) / nullif(sum(abs(r)), 0) * 100 AS largest FROM (SELECT symbol, t // 86400 AS d, product(1 + net) - 1 AS r FROM g GROUP BY 1, 2) GROUP BY 1)"
)


@query("iteration_flags", out(
    _FLAG_INPUTS, "symbol flags", "",
    f"SELECT symbol, array_to_string(list_filter([{', '.join(f"CASE WHEN {c} THEN '{n}' END" for n, c in _FLAGS.items())}], lambda x: x IS NOT NULL), ',') AS flags FROM q JOIN ww USING (symbol) JOIN dy USING (symbol)",
))
def iteration_flags(spark, sf):
    """All rules over the run of each symbol: windows of five days stand for folds, days for trades."""
    n, seconds = F.col("net"), F.unix_timestamp("ts")
    sharpe = F.avg(n) / F.nullif(F.stddev_samp(n), F.lit(0.0)) * math.sqrt(HOUR_PPY)
    net = netted(spark, sf)
    g = net.groupBy("symbol").agg(
        sharpe.alias("s"), (F.product(1 + n) - 1).alias("ret"), (F.avg((F.col("position") != 0).cast("double")) * 100).alias("pct"),
        F.count(F.when(F.col("position") != 0, 1)).alias("n"), (F.sum(F.when(n > 0, n)) / F.nullif(-F.sum(F.when(n < 0, n)), F.lit(0.0))).alias("pf"),
    )
    w = net.groupBy("symbol", F.floor(seconds / 432_000).alias("win")).agg((F.product(1 + n) - 1).alias("r"), sharpe.alias("ws"))
    by_win, r = Window.partitionBy("symbol").orderBy("win"), F.col("r")
    w = w.withColumns({"gap": F.lag("ws").over(by_win) - F.col("ws"), "grp": F.sum((r >= 0).cast("int")).over(by_win)})
    w = w.withColumn("reds", F.sum((r < 0).cast("int")).over(Window.partitionBy("symbol", "grp")))
    w = w.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("windows"), F.count(F.when(r > 0, 1)).alias("positive"), F.max("gap").alias("gap"), (F.max("r") / F.nullif(F.sum(F.when(r > 0, r)), F.lit(0.0))).alias("top"), F.max("reds").alias("streak"),
    )
    d = net.groupBy("symbol", F.floor(seconds / 86_400).alias("day")).agg((F.product(1 + n) - 1).alias("r")).groupBy("symbol").agg((F.max(F.abs("r")) / F.nullif(F.sum(F.abs("r")), F.lit(0.0)) * 100).alias("largest"))
    f = reports.iteration_flags(
        sharpe_=F.col("s"), trades=F.col("n"), in_position_pct=F.col("pct"), total_return=F.col("ret"), largest_pct=F.col("largest"), red_streak=F.col("streak"), profit_factor=F.col("pf"),
        windows=F.col("windows"), positive_windows=F.col("positive"), worst_gap=F.col("gap"), top_share=F.col("top"),
    )
    return g.join(w, "symbol").join(d, "symbol").select("symbol", F.array_join(f, ",").alias("flags"))


_AUTOCORRELATED = (
    RETS + ", d AS (SELECT * FROM (SELECT symbol, t, r, lag(r) OVER w AS l FROM rets " + W + ") WHERE r IS NOT NULL AND l IS NOT NULL), "
    "m AS (SELECT DISTINCT (((t // 86400) + 3) // 7 * 7 - 3) * 86400 AS m FROM rets), "
    "g AS (SELECT m, symbol, corr(r, l) AS c FROM d JOIN m ON t < m AND t >= m - 14 * 86400 GROUP BY 1, 2 HAVING count(*) >= 30), "
    "k AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY c DESC, symbol) AS up, row_number() OVER (PARTITION BY m ORDER BY c, symbol) AS dn FROM g), "
    "s AS (SELECT m, symbol, c, CASE WHEN up <= 2 THEN 1 WHEN dn <= 2 THEN -1 END AS side FROM k)"
)


@query("autocorrelation_ranks", out(
    _AUTOCORRELATED, "month symbol side", "autocorrelation weight",
    "SELECT m AS month, symbol, side, c AS autocorrelation, side / count(*) OVER (PARTITION BY m) AS weight FROM s WHERE side IS NOT NULL",
))
def autocorrelation_ranks(spark, sf):
    """Two most and two least autocorrelated symbols of the 14 days before each week of the data."""
    return reports.trailing_autocorrelation_ranks(with_returns(spark, sf), "r", "week", 14, 2)


ZONES = SWING + """, cf AS (SELECT symbol, conf AS c, high AS price FROM piv WHERE is_high UNION ALL SELECT symbol, conf, low FROM piv WHERE is_low),
 dl AS (SELECT symbol, unnest(range((ceil(c / 24))::BIGINT, (c + 95) // 24 + 1)) * 24 AS at_, price, c FROM cf),
 dn AS (SELECT *, row_number() OVER (PARTITION BY symbol, at_ ORDER BY price, c) AS rn FROM dl)"""
ANCHORED = ZONES + """, an AS (SELECT symbol, at_, rn, price, price AS anchor FROM dn WHERE rn = 1
  UNION ALL SELECT n.symbol, n.at_, n.rn, n.price, CASE WHEN (n.price - k.anchor) / nullif(k.anchor, 0) <= 0.02 THEN k.anchor ELSE n.price END FROM an k JOIN dn n ON n.symbol = k.symbol AND n.at_ = k.at_ AND n.rn = k.rn + 1),
 ch AS (SELECT *, sum(CASE WHEN fresh THEN 1 ELSE 0 END) OVER (PARTITION BY symbol, at_ ORDER BY rn) AS z FROM (SELECT *, anchor IS DISTINCT FROM lag(anchor) OVER (PARTITION BY symbol, at_ ORDER BY rn) AS fresh FROM an)),
 zo AS (SELECT symbol, at_ AS atx, avg(price) AS level, count(*) AS strength FROM ch GROUP BY symbol, at_, z HAVING count(*) >= 2)"""
CENTROID = ZONES + """, ce AS (SELECT symbol, at_, 0 AS step, list({'p': price, 'n': 1.0::DOUBLE} ORDER BY price) AS z FROM dn GROUP BY 1, 2
  UNION ALL SELECT n.symbol, n.at_, n.step + 1, list_concat(list_concat(z[1 : j - 1], [{'p': (z[j].p * z[j].n + z[j + 1].p * z[j + 1].n) / (z[j].n + z[j + 1].n), 'n': z[j].n + z[j + 1].n}]), z[j + 2 :])
  FROM (SELECT *, list_position(gaps, list_min(gaps)) AS j FROM (SELECT *, list_transform(range(1, len(z)), lambda i: (z[i + 1].p - z[i].p) / nullif(z[i].p, 0)) AS gaps FROM ce WHERE len(z) > 1) WHERE list_min(gaps) <= 0.02) n),
 fl AS (SELECT symbol, at_, unnest(arg_max(z, step)) AS c FROM ce GROUP BY 1, 2), zo AS (SELECT symbol, at_ AS atx, c.p AS level, c.n::BIGINT AS strength FROM fl WHERE c.n >= 2)"""


def zones(spark, sf, merge="anchor"):
    return levels.zones(rolling.swing_points(bars(spark, sf), 3, KEY), 24, 96, 0.02, 2, key=KEY, merge=merge)


@query("level_zones", out(ANCHORED, "symbol at_bar strength", "level", "SELECT symbol, atx AS at_bar, level, strength FROM zo"))
def level_zones(spark, sf):
    return zones(spark, sf).withColumnRenamed("at", "at_bar")


_TOP_ZONES = "SELECT * FROM (SELECT symbol, atx AS at_bar, level, strength, row_number() OVER (PARTITION BY symbol, atx ORDER BY strength DESC, level) AS rank FROM zo) WHERE rank <= 3"


@query("strongest_zones", out(CENTROID, "symbol at_bar strength rank", "level", _TOP_ZONES))
def strongest_zones(spark, sf):
    return levels.strongest(zones(spark, sf, "centroid"), 3, key=KEY).withColumnRenamed("at", "at_bar")


@query("distance_profile", out(ANCHORED + ", sp AS (SELECT *, abs(close / nullif(lag(close) OVER (PARTITION BY symbol ORDER BY idx), 0) - 1) AS speed FROM ix), nr AS (SELECT b.symbol, b.idx, min(abs(b.close - z.level) / nullif(abs(z.level), 0)) AS d, any_value(b.speed) AS x FROM sp b JOIN zo z ON z.symbol = b.symbol AND b.idx >= z.atx AND b.idx < z.atx + 24 GROUP BY 1, 2)", "bin n", "mean", "SELECT CASE WHEN d < 0.01 THEN 0 WHEN d < 0.05 THEN 1 WHEN d < 0.2 THEN 2 ELSE 3 END AS bin, count(*) AS n, avg(x) AS mean FROM nr WHERE d IS NOT NULL GROUP BY 1"))
def distance_profile(spark, sf):
    """Size of the bar's move by its distance from the nearest zone."""
    b = indexed(spark, sf).withColumn("speed", F.abs(rolling.simple_return("close", KEY)))
    return levels.distance_profile(b, zones(spark, sf), 24, [0.01, 0.05, 0.2], "speed", key=KEY)


_R = "greatest(high - low, 1e-12)"


@query("rejection_triggers", out(BARS + ", l AS (SELECT *, max(high) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS res, min(low) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING) AS sup FROM bars)", "symbol wick_res inside_res wick_sup inside_sup", "", f"SELECT symbol, count(*) FILTER (close < res * 0.998 AND close <= low + {_R} * 0.33) AS wick_res, count(*) FILTER (high > res * 1.002 AND close < res) AS inside_res, count(*) FILTER (close > sup * 1.002 AND close >= high - {_R} * 0.33) AS wick_sup, count(*) FILTER (low < sup * 0.998 AND close > sup) AS inside_sup FROM l GROUP BY 1"))
def rejection_triggers(spark, sf):
    """Bars that turn from the extremes of the six bars before."""
    w = ordered(KEY).rowsBetween(-6, -1)
    b = bars(spark, sf).withColumns({"res": F.max("high").over(w), "sup": F.min("low").over(w)})
    hit = lambda level, kind, up: F.count(F.when(levels.rejection(F.col(level), 0.002, kind, resistance=up), 1))
    return b.groupBy("symbol").agg(hit("res", "wick", True).alias("wick_res"), hit("res", "inside", True).alias("inside_res"), hit("sup", "wick", False).alias("wick_sup"), hit("sup", "inside", False).alias("inside_sup"))
