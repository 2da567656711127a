"""Queries over positions, features, event features, fills, levels of effort and pairs."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.operators import events, levels, meta, metrics, orderflow, pairs, registry, reports, returns, rolling, sweep
from tidemark.operators.grid import ordered, spine
from tidemark.operators.rolling import last_k
from tidemark.plans.base import BARS, KEY, ORACLES, RETS, W, bars, ewm_sql, out, query, rounded, shared_paths, with_returns
from tidemark.plans.event_queries import IDX, NET, SWING, Z, indexed, latched, netted
from tidemark.plans.metric_queries import SHARPE
from tidemark.plans.recipe_sql import PARTS, frame
from tidemark.plans.report_queries import FUNDING, funding

START, END, CUT = datetime(2024, 1, 10), datetime(2024, 1, 20), datetime(2024, 1, 20)


@query("stale_positions", out(BARS + ", sp AS (SELECT symbol, unnest(range(min(t), max(t) + 1, 3600)) AS t FROM bars GROUP BY 1), j AS (SELECT sp.symbol, sp.t, last_value(b.t IGNORE NULLS) OVER (PARTITION BY sp.symbol ORDER BY sp.t) AS seen FROM sp LEFT JOIN bars b ON b.symbol = sp.symbol AND b.t = sp.t)", "symbol t", "position", "SELECT symbol, t, CASE WHEN t - seen <= 7200 THEN 1.0 ELSE 0.0 END AS position FROM j"))
def stale_positions(spark, sf):
    """A held position on an hourly grid, none where the last price is over two hours old."""
    b = bars(spark, sf)
    d = spine(b, 3600, key=KEY).join(b.select("symbol", "ts", "close"), ["symbol", "ts"], "left").withColumn("position", F.lit(1.0))
    return returns.zero_stale(d, 7200, key=KEY).select("symbol", "ts", "position")


@query("account_equity", out(Z + ", p AS (SELECT b.symbol, b.t, close, position / 100 AS q FROM bars b JOIN ps USING (symbol, t)), n AS (SELECT symbol, t, lag(q, 1, 0) OVER w * coalesce(close / nullif(lag(close) OVER w, 0) - 1, 0) AS gross, abs(q - lag(q, 1, 0) OVER w) * 0.0005 AS cost FROM p " + W + ")", "symbol t", "gross cost equity", "SELECT symbol, t, gross, cost, product(1 + gross - cost) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS equity FROM n").replace("n AS (SELECT symbol, t, lag(q", "nt AS (SELECT symbol, t, lag(q").replace("FROM n)", "FROM nt)"))
def account_equity(spark, sf):
    """Weight accounting of a hundredth of the latched position."""
    d = returns.account(latched(spark, sf).withColumn("position", F.col("position") / 100), 0.0005, key=KEY)
    return d.select("symbol", "ts", "gross", "cost", "equity")


@query("hedge_legs", out(BARS, "symbol t", "hedge_pnl hedge_cost", "SELECT symbol, t, -coalesce(lag(volume) OVER w, 0) * coalesce(close / nullif(lag(close) OVER w, 0) - 1, 0) AS hedge_pnl, abs(volume - coalesce(lag(volume) OVER w, 0)) * 0.001 AS hedge_cost FROM bars " + W))
def hedge_legs(spark, sf):
    d = returns.spot_hedge(bars(spark, sf).withColumn("notional", F.col("volume")), 0.001, key=KEY)
    return d.select("symbol", "ts", "hedge_pnl", "hedge_cost")


@query("composite_scores", out(NET + f", q AS (SELECT symbol, {SHARPE.replace('(r)', '(net)')} AS s, count(*) FILTER (position <> 0) AS n, product(1 + net) - 1 AS ret FROM g GROUP BY 1)", "symbol n", "score", "SELECT symbol, n, CASE WHEN ret <= 0 THEN least(raw, 0) ELSE raw END AS score FROM (SELECT *, s - 0.1 - greatest(0.0, (400 - n) / 400.0) AS raw FROM q)", 4))
def composite_scores(spark, sf):
    g = netted(spark, sf).groupBy("symbol").agg(metrics.sharpe(F.col("net"), 8760.0).alias("s"), F.count(F.when(F.col("position") != 0, 1)).alias("n"), (F.product(1 + F.col("net")) - 1).alias("ret"))
    score = metrics.composite_score(F.col("s"), F.lit(0.1), F.col("n"), F.col("ret"), least_trades=400)
    return g.select("symbol", "n", rounded(score, 4).alias("score"))


@query("annualised_volatility", out(RETS, "symbol", "volatility", "SELECT symbol, stddev_samp(r) * sqrt(8760) AS volatility FROM rets GROUP BY 1", 4))
def annualised_volatility(spark, sf):
    d = with_returns(spark, sf).groupBy("symbol").agg((F.stddev_samp("r") * F.sqrt(F.lit(metrics.periods_per_year(3600)))).alias("volatility"))
    return d.select("symbol", rounded("volatility", 4).alias("volatility"))


@query("modulated_positions", out(Z + f", m AS (SELECT b.symbol, b.t, position, CASE WHEN count(*) OVER {frame(10)} = 10 THEN avg((close > open)::INT) OVER {frame(10)} END AS p FROM bars b JOIN ps USING (symbol, t))".replace("OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 9", "OVER (PARTITION BY b.symbol ORDER BY b.t ROWS BETWEEN 9"), "symbol t", "scaled gated", "SELECT symbol, t, position * coalesce(p, 0.5) AS scaled, position * (coalesce(p, 0.5) >= 0.45)::INT AS gated FROM m"))
def modulated_positions(spark, sf):
    """Positions scaled by, and gated at, a probability: the share of rising bars of the last ten."""
    w = last_k(10, KEY)
    d = latched(spark, sf).withColumn("p", F.when(F.count(F.lit(1)).over(w) == 10, F.avg((F.col("close") > F.col("open")).cast("double")).over(w)))
    both = meta.modulate(d.withColumn("gated", F.col("position")), position="gated", gate=0.45)
    return meta.modulate(both, position="position").select("symbol", "ts", F.col("position").alias("scaled"), "gated")


@query("decile_lift", out(RETS + ", x AS (SELECT symbol, volume + t / 1e10 AS v, lead(r) OVER w AS f FROM rets " + W + ")", "symbol decile n", "mean", "SELECT symbol, decile, count(*) AS n, avg(f) AS mean FROM (SELECT *, ntile(10) OVER (PARTITION BY symbol ORDER BY v, f) AS decile FROM x WHERE f IS NOT NULL) GROUP BY 1, 2"))
def decile_lift(spark, sf):
    """Mean next return by decile of volume."""
    d = with_returns(spark, sf).withColumns({"v": F.col("volume") + F.unix_timestamp("ts") / 1e10, "f": F.lead("r").over(ordered(KEY))}).where("f IS NOT NULL")
    return meta.decile_lift(d, "v", "f", key=KEY)


def _permuted(feature: str) -> str:
    return f"SELECT symbol, t, {feature} AS v, row_number() OVER (ORDER BY md5(concat_ws(':', 1, 0, '{feature}', symbol, t)), symbol, t) AS i FROM x"


_IMPORTANCE = RETS + f""", x AS (SELECT symbol, t, volume, r, lead(r) OVER w AS y FROM rets {W} QUALIFY r IS NOT NULL AND y IS NOT NULL),
 a AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws(':', 1, 'rows', symbol, t)), symbol, t) AS i FROM x), pv AS ({_permuted('volume')}), pr AS ({_permuted('r')}),
 e AS (SELECT '' AS feature, y, -0.4 * r + 0.01 * volume AS p FROM x UNION ALL SELECT 'volume', y, -0.4 * a.r + 0.01 * pv.v FROM a JOIN pv USING (i) UNION ALL SELECT 'r', y, -0.4 * pr.v + 0.01 * a.volume FROM a JOIN pr USING (i)),
 c AS (SELECT feature, sum(pow(y - p, 2)) / (var_pop(y) * count(y)) AS cost FROM e GROUP BY 1)"""


@query("permutation_importance", out(_IMPORTANCE, "feature", "importance", "SELECT feature, cost - (SELECT cost FROM c WHERE feature = '') AS importance FROM c WHERE feature <> ''"))
def permutation_importance(spark, sf):
    """What a fixed linear forecast of the next return loses in R2 when a feature is permuted."""
    d = with_returns(spark, sf).withColumn("y", F.lead("r").over(ordered(KEY))).where("r IS NOT NULL AND y IS NOT NULL")
    d = d.select("symbol", F.unix_timestamp("ts").alias("t"), "volume", "r", "y")
    return meta.permutation_importance(lambda x: x.withColumn("p", -0.4 * F.col("r") + 0.01 * F.col("volume")), d, ["volume", "r"], "y", order=["symbol", "t"], score="r2")


@query("candidate_scores", out(RETS + ", c AS (SELECT k AS candidate, symbol, avg(CASE WHEN volume >= a THEN r END) * 100 AS m, count(*) FILTER (volume >= a) AS n FROM rets CROSS JOIN (VALUES (0::BIGINT, 5.0::DOUBLE), (1, 10.0), (2, 15.0), (3, 20.0)) v(k, a) GROUP BY 1, 2)", "candidate", "mean std trades score", "SELECT *, mean - 0.5 * std - greatest(0.0, (30 - trades) / 30) AS score FROM (SELECT candidate, avg(m) AS mean, coalesce(stddev_samp(m), 0) AS std, avg(n) AS trades FROM c GROUP BY 1)"))
def candidate_scores(spark, sf):
    """Volume thresholds on a linear axis, scored over symbols."""
    g = sweep.grid(spark, {"least": sweep.linear_axis(5.0, 20.0, 4)})
    d = sweep.with_candidates(with_returns(spark, sf), g)
    hit = F.col("volume") >= F.col("least")
    cells = d.groupBy("candidate", "symbol").agg((F.avg(F.when(hit, F.col("r"))) * 100).alias("m"), F.count(F.when(hit, 1)).alias("n"))
    return sweep.candidate_score(cells, "m", "n")


@registry.feature("ret_1", lookback=timedelta(hours=0))
def _ret_1(df):
    return df.withColumn("ret_1", rolling.log_return("close", KEY))


@registry.feature("vol_24", deps=("ret_1",), lookback=timedelta(days=3))
def _vol_24(df):
    return df.withColumn("vol_24", rolling.rolling(F.stddev_samp, F.col("ret_1"), last_k(24, KEY), 12))


@registry.feature("vol_rank", deps=("vol_24",), lookback=timedelta(days=4))
def _vol_rank(df):
    return df.withColumn("vol_rank", rolling.rolling_rank_pct(F.col("vol_24"), last_k(48, KEY), 24))


_PADDED = RETS.replace("FROM bars WINDOW", "FROM (SELECT * FROM bars WHERE t >= epoch(TIMESTAMP '2024-01-03') AND t < epoch(TIMESTAMP '2024-01-20')) WINDOW")


@query("feature_frame", out(_PADDED + f", v AS (SELECT symbol, t, r, CASE WHEN count(r) OVER {frame(24)} >= 12 THEN stddev_samp(r) OVER {frame(24)} END AS vol FROM rets), k AS (SELECT symbol, t, r, vol, list(vol) FILTER (vol IS NOT NULL) OVER {frame(48)} AS xs FROM v)", "symbol t", "ret_1 vol_24 vol_rank", "SELECT symbol, t, r AS ret_1, vol AS vol_24, CASE WHEN len(xs) >= 24 THEN (len(list_filter(xs, lambda x: x < vol)) + (len(list_filter(xs, lambda x: x = vol)) + 1) / 2.0) / len(xs) END AS vol_rank FROM k WHERE t >= epoch(TIMESTAMP '2024-01-10')"))
def feature_frame(spark, sf):
    """Registered features over ten days, warmed up by the seven days before."""
    return registry.compute(bars(spark, sf), ["ret_1", "vol_24", "vol_rank"], START, END, keys=KEY)


@query("feature_read_through", ORACLES["feature_frame"].replace("TIMESTAMP '2024-01-03'", "TIMESTAMP '2024-01-01'"))
def feature_read_through(spark, sf):
    """The same features kept by week: four days are asked for first, so the rest adds what is missing.

    Weeks are computed whole, so the warm-up begins seven days before the first week.
    """
    root, names = shared_paths(spark, "features")[0], ["ret_1", "vol_24", "vol_rank"]
    b = bars(spark, sf)
    registry.read_through(b, names, START, START + timedelta(days=4), root, unit="week")
    return registry.read_through(b, names, START, END, root, unit="week")


@registry.research_tool("volatility_split")
def _volatility_tool(df, *, k: int = 24):
    return reports.volatility_split(df, "r", k, 3, key=KEY)


@query("research_tool_run", out(RETS + f", tn AS (SELECT * FROM rets WHERE t < epoch(TIMESTAMP '2024-01-20')), v AS (SELECT symbol, r, CASE WHEN count(r) OVER {frame(24)} >= 24 THEN stddev_samp(r) OVER {frame(24)} END AS vol, lead(r) OVER w AS nx FROM tn {W}), u AS (SELECT *, (rank() OVER (PARTITION BY symbol ORDER BY vol) + (count(*) OVER (PARTITION BY symbol, vol) - 1) / 2.0) / count(*) OVER (PARTITION BY symbol) AS p FROM v WHERE r IS NOT NULL AND vol IS NOT NULL AND nx IS NOT NULL)", "tool symbol regime n", "mean_abs", "SELECT 'volatility_split' AS tool, symbol, least(2, floor(p * 3))::INT AS regime, count(*) AS n, avg(abs(r)) AS mean_abs FROM u GROUP BY 2, 3"))
def research_tool_run(spark, sf):
    """A research tool over train rows only: they end at the earlier of train end and holdout."""
    got = registry.run_tool("volatility_split", with_returns(spark, sf), datetime(2024, 1, 25), CUT)
    return got.select("tool", "symbol", "regime", "n", "mean_abs")


_DIV = SWING.replace("IDX", "IDX") + ", " + PARTS["ud"][1] + ", " + PARTS["rsi"][1] + ", pr AS (SELECT piv.*, p_rsi.rsi FROM piv JOIN ix USING (symbol, idx) LEFT JOIN p_rsi ON p_rsi.symbol = ix.symbol AND p_rsi.t = ix.t), hi AS (SELECT symbol, idx, high, rsi, lag(idx) OVER w AS i0, lag(high) OVER w AS p0, lag(rsi) OVER w AS o0 FROM pr WHERE is_high WINDOW w AS (PARTITION BY symbol ORDER BY idx)), lo AS (SELECT symbol, idx, low, rsi, lag(idx) OVER w AS i0, lag(low) OVER w AS p0, lag(rsi) OVER w AS o0 FROM pr WHERE is_low WINDOW w AS (PARTITION BY symbol ORDER BY idx))"


@query("rsi_divergence", out(_DIV, "symbol idx kind", "", "SELECT symbol, idx, CASE WHEN rsi < o0 THEN 'bear_div' ELSE 'bear_conf' END AS kind FROM hi WHERE idx - i0 BETWEEN 5 AND 72 AND high > p0 AND rsi IS NOT NULL AND o0 IS NOT NULL UNION ALL SELECT symbol, idx, CASE WHEN rsi > o0 THEN 'bull_div' ELSE 'bull_conf' END FROM lo WHERE idx - i0 BETWEEN 5 AND 72 AND low < p0 AND rsi IS NOT NULL AND o0 IS NOT NULL"))
def rsi_divergence(spark, sf):
    s = rolling.swing_points(ind.rsi(bars(spark, sf)), 3, KEY)
    return levels.divergences(s, "rsi", 5, 72, key=KEY).select("symbol", F.col("idx").cast("long").alias("idx"), "kind")


@query("trigger_features", out(RETS + ", " + f"b AS (SELECT *, row_number() OVER w AS rn, CASE WHEN row_number() OVER w > 24 THEN nullif(quantile_cont(volume, 0.5) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), 0) END AS base, sum(CASE WHEN close < pc THEN 0 ELSE 1 END) OVER w AS run FROM (SELECT *, lag(close) OVER w AS pc FROM rets {W}) {W})", "symbol t falls", "r1 r3 r5 r15 acceleration surge15 surge1 volatility range5 from_high from_low", "SELECT * FROM (SELECT symbol, t, volume, " + ", ".join(f"close / nullif(lag(close, {k}) OVER w, 0) - 1 AS r{k}" for k in (1, 3, 5, 15)) + f", close / nullif(lag(close, 5) OVER w, 0) - 1 - (lag(close, 5) OVER w / nullif(lag(close, 10) OVER w, 0) - 1) AS acceleration, sum(volume) OVER {frame(15)} / (base * 15) AS surge15, volume / base AS surge1, CASE WHEN count(r) OVER {frame(60)} > 5 THEN stddev_pop(r) OVER {frame(60)} END AS volatility, (max(high) OVER {frame(5)} - min(low) OVER {frame(5)}) / nullif(close, 0) AS range5, close / nullif(max(high) OVER {frame(25)}, 0) - 1 AS from_high, close / nullif(min(low) OVER {frame(25)}, 0) - 1 AS from_low, row_number() OVER (PARTITION BY symbol, run ORDER BY t) - 1 AS falls FROM b {W}) WHERE volume >= 8"))
def trigger_features(spark, sf):
    """Features of busy bars, from what came before them."""
    return events.trigger_features(bars(spark, sf), day=24, key=KEY).where("volume >= 8").drop("open", "high", "low", "close", "volume")


_CL = IDX + ", tg AS (SELECT *, CASE WHEN idx - lag(idx) OVER (PARTITION BY symbol ORDER BY idx) <= 6 THEN 0 ELSE 1 END AS nw FROM ix WHERE volume >= 8), cl AS (SELECT *, sum(nw) OVER (PARTITION BY symbol ORDER BY idx) AS cluster FROM tg), sp AS (SELECT symbol, cluster, min(idx) AS a, max(idx) AS z FROM cl GROUP BY 1, 2), rw AS (SELECT sp.symbol, sp.cluster, ix.idx, ix.close, row_number() OVER (PARTITION BY sp.symbol, sp.cluster ORDER BY ix.idx) AS rn FROM sp JOIN ix ON ix.symbol = sp.symbol AND ix.idx BETWEEN sp.a AND sp.z)"


def cluster_rows(spark, sf):
    """Bars from the first to the last trigger of each cluster."""
    from tidemark.operators.joins import range_join

    b = indexed(spark, sf)
    c = events.clusters(b.where("volume >= 8"), 6, at="idx", key=KEY).withColumn("__to", F.col("last") + 1)
    return range_join(b.select("symbol", "idx", "close"), c, key=KEY, at="idx", start="start", end="__to", width=24).select("symbol", "cluster", "idx", "close")


@query("price_step_fills", out(_CL + ", k AS (SELECT symbol, cluster, rn, idx, close AS last_, true AS ok FROM rw WHERE rn = 1 UNION ALL SELECT n.symbol, n.cluster, n.rn, n.idx, CASE WHEN n.close <= k.last_ * 0.9 THEN n.close ELSE k.last_ END, n.close <= k.last_ * 0.9 FROM k JOIN rw n ON n.symbol = k.symbol AND n.cluster = k.cluster AND n.rn = k.rn + 1)", "symbol cluster idx", "close", "SELECT symbol, cluster, idx, last_ AS close FROM k WHERE ok"))
def price_step_fills(spark, sf):
    """Fills of a cluster: its first bar, then each bar a tenth under the last fill."""
    return events.price_step_fills(cluster_rows(spark, sf), 0.1, key=["symbol", "cluster"])


@query("min_gap_fills", out(_CL + ", k AS (SELECT symbol, cluster, rn, idx AS kept, true AS ok FROM rw WHERE rn = 1 UNION ALL SELECT n.symbol, n.cluster, n.rn, CASE WHEN n.idx - k.kept >= 4 THEN n.idx ELSE k.kept END, n.idx - k.kept >= 4 FROM k JOIN rw n ON n.symbol = k.symbol AND n.cluster = k.cluster AND n.rn = k.rn + 1)", "symbol cluster idx", "", "SELECT symbol, cluster, kept AS idx FROM (SELECT *, row_number() OVER (PARTITION BY symbol, cluster ORDER BY kept) AS r FROM k WHERE ok) WHERE r <= 3"))
def min_gap_fills(spark, sf):
    """Fills of a cluster at least four bars apart, three at most."""
    return events.min_gap_fills(cluster_rows(spark, sf), 4, 3, key=["symbol", "cluster"]).select("symbol", "cluster", "idx")


_FADE = IDX + """, ev AS (SELECT symbol || '-' || idx AS eid, symbol, idx, close AS p0 FROM ix WHERE volume >= 8), pt AS (SELECT e.eid, e.p0, b.idx - e.idx AS step, b.close, b.high, b.low FROM ev e JOIN ix b ON b.symbol = e.symbol AND b.idx > e.idx AND b.idx <= e.idx + 24),
 tp AS (SELECT *, greatest(max(high) OVER w, p0) AS top FROM pt WINDOW w AS (PARTITION BY eid ORDER BY step)), dp AS (SELECT *, least(0.0, min(low / nullif(top, 0) - 1) OVER (PARTITION BY eid ORDER BY step)) AS deep FROM tp),
 cr AS (SELECT eid, level, min(step) AS cross_step, first(deep ORDER BY step) AS retracement, first(close ORDER BY step) AS e FROM dp CROSS JOIN (VALUES (0.1::DOUBLE), (0.5), (1.0)) v(level) WHERE high / nullif(p0, 0) - 1 >= level GROUP BY 1, 2),
 fd AS (SELECT cr.eid, level, cross_step, retracement, first(close / nullif(e, 0) - 1 ORDER BY step) FILTER (high / nullif(e, 0) - 1 >= 0.3) AS at_stop, max(CASE WHEN step = cross_step + 6 THEN close / nullif(e, 0) - 1 END) AS at_end, count(*) FILTER (high / nullif(e, 0) - 1 >= 0.3) AS hits FROM cr LEFT JOIN pt ON pt.eid = cr.eid AND step > cross_step AND step <= cross_step + 6 GROUP BY 1, 2, 3, 4)"""


@query("run_up_fades", out(_FADE, "eid cross_step", "level retracement fade", "SELECT eid, level, cross_step, retracement, CASE WHEN hits > 0 THEN least(-0.3, -at_stop) ELSE -at_end END AS fade FROM fd"))
def run_up_fades(spark, sf):
    b = indexed(spark, sf)
    e = b.where("volume >= 8").select(F.concat_ws("-", "symbol", F.col("idx").cast("string")).alias("eid"), "symbol", "idx", "close")
    return events.run_up_fades(e, b, 24, [0.1, 0.5, 1.0], 6, 0.3, key=KEY, event_id="eid")


@query("force_and_barrier", out(BARS, "symbol t", "buy_rate seconds_to_eat", f"SELECT symbol, t, CASE WHEN count(*) OVER {frame(6)} = 6 THEN sum(volume) OVER {frame(6)} / 21600 END AS buy_rate, high * 10 / nullif(CASE WHEN count(*) OVER {frame(6)} = 6 THEN sum(volume) OVER {frame(6)} / 21600 END, 0) AS seconds_to_eat FROM bars"))
def force_and_barrier(spark, sf):
    d = bars(spark, sf).withColumn("wall", F.col("high") * 10)
    return orderflow.force_and_barrier(d, "wall", "volume", 6, 3600, key=KEY).select("symbol", "ts", "buy_rate", "seconds_to_eat")


_REFIT = BARS + ", pp AS (SELECT x.symbol AS a, y.symbol AS b, x.t, ln(x.close + 1) AS va, ln(y.close + 1) AS vb FROM bars x JOIN bars y ON x.t = y.t AND x.symbol < y.symbol), dl AS (SELECT *, unnest(range(t // 86400 + 1, t // 86400 + 6)) AS d FROM pp), ft AS (SELECT a, b, d, regr_slope(va, vb) AS beta, regr_intercept(va, vb) AS alpha, sqrt(greatest(0.0, var_pop(va) * (1 - regr_r2(va, vb)))) AS sd FROM dl GROUP BY 1, 2, 3 HAVING count(*) >= 20)"


@query("trailing_refit", out(_REFIT, "a b t", "resid z", "SELECT pp.a, pp.b, pp.t, va - alpha - beta * vb AS resid, (va - alpha - beta * vb) / nullif(sd, 0) AS z FROM pp JOIN ft ON ft.a = pp.a AND ft.b = pp.b AND ft.d = pp.t // 86400"))
def trailing_refit(spark, sf):
    """Residuals of each day under the fit of the five days before it."""
    from tidemark.operators.joins import symbol_pairs

    p = symbol_pairs(bars(spark, sf).withColumn("lp", F.log(F.col("close") + 1)), "lp")
    return pairs.trailing_refit(p, 5).select("a", "b", "ts", "resid", "z")


@query("funding_index", out(BARS + ", " + FUNDING + ", fc AS (SELECT symbol, t, sum(rate) OVER (PARTITION BY symbol ORDER BY t) AS paid FROM fu)", "symbol t", "funding_paid", "SELECT b.symbol, b.t, coalesce(fc.paid, 0) AS funding_paid FROM bars b ASOF LEFT JOIN fc ON fc.symbol = b.symbol AND b.t >= fc.t"))
def funding_index(spark, sf):
    b = bars(spark, sf)
    return pairs.funding_index(b.select("symbol", "ts"), funding(b))


@query("weighted_spread", out(BARS, "t", "spread", "SELECT t, sum(CASE symbol WHEN 'click' THEN 1.0 WHEN 'view' THEN -0.5 ELSE -0.5 END * ln(close + 1)) AS spread FROM bars WHERE symbol IN ('click', 'view', 'purchase') GROUP BY 1 HAVING count(*) = 3"))
def weighted_spread(spark, sf):
    """A three-legged spread of log prices, where all legs trade."""
    return pairs.weighted_spread(bars(spark, sf), {"click": 1.0, "view": -0.5, "purchase": -0.5}, F.log(F.col("close") + 1))
