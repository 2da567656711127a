"""Queries: event studies, labels, levels, pairs, order flow, returns and signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import book, events, joins, metrics, orderflow, pairs, returns, rolling, scans
from tidemark.operators.grid import ordered
from tidemark.plans.base import BARS, HOUR_PPY, KEY, RETS, TICKS, TRADES, W, bars, out, query, rounded, ticks, trades, with_returns
from tidemark.plans.metric_queries import phi

IDX = BARS + ", ix AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS idx FROM bars)"
EV = IDX + ", ev AS (SELECT symbol || '-' || idx AS eid, symbol, idx, close FROM ix WHERE volume >= 40)"
PATH = EV + ", path AS (SELECT e.eid, e.close AS p0, b.idx - e.idx AS step, b.close, b.high, b.low FROM ev e JOIN ix b ON b.symbol = e.symbol AND b.idx > e.idx AND b.idx <= e.idx + 24)"


def indexed(spark, sf):
    return events.indexed(bars(spark, sf), key=KEY)


def busy(spark, sf):
    """Events: hours with volume of at least 40."""
    b = indexed(spark, sf).where("volume >= 40")
    return b.select(F.concat_ws("-", "symbol", F.col("idx").cast("string")).alias("eid"), "symbol", "idx", "close")


@query("trigger_clusters", "WITH " + TICKS + ", c AS (SELECT symbol, s, CASE WHEN s - lag(s) OVER (PARTITION BY symbol ORDER BY s) > 3600 OR lag(s) OVER (PARTITION BY symbol ORDER BY s) IS NULL THEN 1 ELSE 0 END AS n FROM ticks WHERE price > 50), g AS (SELECT *, sum(n) OVER (PARTITION BY symbol ORDER BY s ROWS UNBOUNDED PRECEDING) AS cluster FROM c) SELECT symbol, cluster, min(s) AS start, max(s) AS last, count(*) AS k FROM g GROUP BY 1, 2")
def trigger_clusters(spark, sf):
    t = ticks(spark, sf).where("price > 50").select("symbol", F.unix_timestamp("ts").alias("s"))
    return events.clusters(t, 3600, at="s", key=KEY)


@query("triple_barrier", out(PATH + ", a AS (SELECT eid, min(step) FILTER (close / nullif(p0, 0) - 1 >= 0.8) AS pt, min(step) FILTER (close / nullif(p0, 0) - 1 <= -0.5) AS sl, max(step) AS last FROM path GROUP BY 1), l AS (SELECT eid, CASE WHEN pt IS NOT NULL AND (sl IS NULL OR pt <= sl) THEN 1 WHEN sl IS NOT NULL THEN -1 ELSE 0 END AS label, CASE WHEN pt IS NOT NULL AND (sl IS NULL OR pt <= sl) THEN pt WHEN sl IS NOT NULL THEN sl ELSE last END AS touch_step FROM a)", "eid label touch_step", "ret", "SELECT l.*, close / nullif(p0, 0) - 1 AS ret FROM l JOIN path p ON p.eid = l.eid AND p.step = l.touch_step"))
def triple_barrier(spark, sf):
    return events.triple_barrier(busy(spark, sf), indexed(spark, sf), 24, F.lit(0.8), F.lit(0.5), key=KEY, event_id="eid")


@query("first_barrier", "WITH " + PATH + ", a AS (SELECT eid, min(step) FILTER (high >= p0 * 1.5) AS u, min(step) FILTER (low <= p0 * 0.5) AS d FROM path GROUP BY 1) SELECT eid, CASE WHEN d IS NOT NULL AND (u IS NULL OR d <= u) THEN -1 WHEN u IS NOT NULL THEN 1 END AS label FROM a")
def first_barrier(spark, sf):
    return events.first_barrier(busy(spark, sf), indexed(spark, sf), 24, 0.5, key=KEY, event_id="eid")


@query("horizon_outcomes", out(PATH + ", a AS (SELECT eid, min(step) FILTER (high >= p0 * 3) AS stop_step, min(low / nullif(p0, 0) - 1) AS worst_low, max(high / nullif(p0, 0) - 1) AS best_high, " + ", ".join(f"max(1 - close / nullif(p0, 0)) FILTER (step = {h}) AS r{h}" for h in (1, 6, 24)) + " FROM path GROUP BY 1)", "eid stop_step", "worst_low best_high pnl1 pnl6 pnl24", "SELECT eid, stop_step, worst_low, best_high, " + ", ".join(f"CASE WHEN stop_step <= {h} THEN -2.0 ELSE r{h} END AS pnl{h}" for h in (1, 6, 24)) + " FROM a"))
def horizon_outcomes(spark, sf):
    return events.outcomes(busy(spark, sf), indexed(spark, sf), [1, 6, 24], 2.0, key=KEY, event_id="eid")


@query("rollover_exit", out(PATH + ", k AS (SELECT *, greatest(p0, max(close) OVER (PARTITION BY eid ORDER BY step ROWS UNBOUNDED PRECEDING)) AS peak FROM path)", "eid exit_step", "exit_ret peak_ret", "SELECT eid, min(step) FILTER (close <= peak * 0.6) AS exit_step, (arg_min(close, step) FILTER (close <= peak * 0.6)) / nullif(any_value(p0), 0) - 1 AS exit_ret, max(close) / nullif(any_value(p0), 0) - 1 AS peak_ret FROM k GROUP BY eid"))
def rollover_exit(spark, sf):
    return events.rollover_exit(busy(spark, sf), indexed(spark, sf), 24, 0.4, key=KEY, event_id="eid")


@query("stall_exit", "WITH " + PATH + ", k AS (SELECT *, coalesce(high > max(high) OVER (PARTITION BY eid ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM path), s AS (SELECT eid, step, step - max(step) FILTER (fresh) OVER (PARTITION BY eid ORDER BY step ROWS UNBOUNDED PRECEDING) AS since FROM k) SELECT eid, min(step) FILTER (since >= 6) AS stall_step FROM s GROUP BY 1")
def stall_exit(spark, sf):
    return events.stall_exit(busy(spark, sf), indexed(spark, sf), 24, 6, key=KEY, event_id="eid")


@query("run_up_levels", "WITH " + PATH + " SELECT eid, level, min(step) FILTER (high / nullif(p0, 0) - 1 >= level) AS cross_step FROM path CROSS JOIN (VALUES (0.5::DOUBLE), (1.0), (2.0)) v(level) GROUP BY 1, 2")
def run_up_levels(spark, sf):
    return events.run_up_levels(busy(spark, sf), indexed(spark, sf), 24, [0.5, 1.0, 2.0], key=KEY, event_id="eid")


@query("mean_event_path", out(EV, "\"offset\" n", "mean_rel", "SELECT b.idx - e.idx AS \"offset\", count(*) AS n, avg(b.close / nullif(e.close, 0)) AS mean_rel FROM ev e JOIN ix b ON b.symbol = e.symbol AND b.idx BETWEEN e.idx - 5 AND e.idx + 5 GROUP BY 1", 4))
def mean_event_path(spark, sf):
    d = events.mean_path(busy(spark, sf), indexed(spark, sf), 5, 5, key=KEY)
    return d.select("offset", "n", rounded("mean_rel", 4).alias("mean_rel"))


@query("fill_schedules", out("f AS (SELECT o_custkey AS event, o_totalprice AS price, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders), s AS (SELECT 'equal' AS name, i, 0.25 AS weight FROM range(1, 5) r(i) UNION ALL SELECT 'ramp', i, i / 10.0 FROM range(1, 5) r(i))", "name event fills", "entry deployed", "SELECT name, event, sum(weight * price) / sum(weight) AS entry, least(1.0, sum(weight)) AS deployed, count(*) AS fills FROM f JOIN s USING (i) GROUP BY 1, 2", 4))
def fill_schedules(spark, sf):
    from tidemark.plans.base import table

    f = table(spark, sf, "orders").select(F.col("o_custkey").alias("event"), "o_orderkey", F.col("o_totalprice").alias("price"))
    s = spark.createDataFrame([("equal", i, 0.25) for i in range(1, 5)] + [("ramp", i, i / 10.0) for i in range(1, 5)], "name string, i int, weight double")
    d = events.fill_schedules(f, s, event="event", order="o_orderkey")
    return d.select("name", "event", "fills", rounded("entry", 4).alias("entry"), rounded("deployed", 4).alias("deployed"))


SWING = IDX + ", sw AS (SELECT *, list(high) OVER a AS hs, list(low) OVER a AS ls FROM ix WINDOW a AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)), piv AS (SELECT symbol, idx, high, low, idx + 3 AS conf, (high = list_max(hs) AND len(list_filter(hs, lambda v: v = high)) = 1) AS is_high, (low = list_min(ls) AND len(list_filter(ls, lambda v: v = low)) = 1) AS is_low FROM sw WHERE len(hs) = 7)"


@query("level_touches", out(SWING + ", lv AS (SELECT symbol, CASE WHEN is_high THEN high ELSE low END AS level, conf AS a, conf + 48 AS b FROM piv WHERE is_high OR is_low)", "symbol idx", "level distance", "SELECT i.symbol, i.idx, level, abs(i.close - level) / nullif(abs(level), 0) AS distance FROM ix i JOIN lv ON lv.symbol = i.symbol AND i.idx >= a AND i.idx < b WHERE abs(i.close - level) / nullif(abs(level), 0) <= 0.02 QUALIFY row_number() OVER (PARTITION BY i.symbol, i.idx ORDER BY abs(i.close - level) / nullif(abs(level), 0), level, a) = 1"))
def level_touches(spark, sf):
    s = rolling.swing_points(bars(spark, sf), 3, KEY)
    lv = events.levels_from_swings(s, 48, key=KEY)
    return events.level_touches(indexed(spark, sf), lv, 0.02, key=KEY, width=48).select("symbol", "idx", "level", "distance")


@query("level_density", "WITH " + SWING + ", lv AS (SELECT symbol, CASE WHEN is_high THEN high ELSE low END AS level, conf AS a, conf + 48 AS b FROM piv WHERE is_high OR is_low), hit AS (SELECT DISTINCT i.symbol, i.idx FROM ix i JOIN lv ON lv.symbol = i.symbol AND i.idx >= a AND i.idx < b WHERE abs(i.close - level) / nullif(abs(level), 0) <= 0.02) SELECT i.symbol, round(count(hit.idx) / count(*), 6) AS share FROM ix i LEFT JOIN hit USING (symbol, idx) GROUP BY 1")
def level_density(spark, sf):
    b = indexed(spark, sf)
    lv = events.levels_from_swings(rolling.swing_points(bars(spark, sf), 3, KEY), 48, key=KEY)
    hit = events.level_touches(b, lv, 0.02, key=KEY, width=48).select("symbol", "idx", F.lit(1).alias("hit"))
    return b.join(hit, ["symbol", "idx"], "left").groupBy("symbol").agg((F.count("hit") / F.count(F.lit(1))).alias("share"))


@query("trendline_breaks", "WITH " + SWING + ", h AS (SELECT *, lag(idx) OVER (PARTITION BY symbol ORDER BY idx) AS i0, lag(high) OVER (PARTITION BY symbol ORDER BY idx) AS p0 FROM piv WHERE is_high), l AS (SELECT symbol, idx AS i1, high AS p1, (high - p0) / (idx - i0) AS slope, conf AS a, conf + 48 AS b FROM h WHERE i0 IS NOT NULL), j AS (SELECT l.symbol, i1, x.idx, x.close, x.high, p1 + slope * (x.idx - i1) AS lv FROM l JOIN ix x ON x.symbol = l.symbol AND x.idx >= a AND x.idx < b), k AS (SELECT *, min(idx) FILTER (close > lv) OVER (PARTITION BY symbol, i1) AS brk FROM j) SELECT symbol, i1, any_value(brk) AS break_idx, count(*) FILTER (high >= lv AND (brk IS NULL OR idx < brk)) AS touches FROM k GROUP BY 1, 2")
def trendline_breaks(spark, sf):
    lines = events.trendlines(rolling.swing_points(bars(spark, sf), 3, KEY), 48, key=KEY)
    return events.trendline_breaks(indexed(spark, sf), lines, key=KEY, width=48).withColumn("i1", F.col("i1").cast("long"))


# the three last kept stops of a symbol are a (latest), b and c; an event stays unless c is within a day
BREAKER = "n AS (SELECT event_type AS symbol, event_id, epoch_us(ts) AS s, value > 80 AS stopped, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events), k AS (SELECT symbol, rn, event_id, stopped, TRUE AS ok, CASE WHEN stopped THEN s END AS a, NULL::BIGINT AS b, NULL::BIGINT AS c FROM n WHERE rn = 1 UNION ALL SELECT symbol, rn, event_id, stopped, ok, CASE WHEN ok AND stopped THEN s ELSE a END, CASE WHEN ok AND stopped THEN a ELSE b END, CASE WHEN ok AND stopped THEN b ELSE c END FROM (SELECT n.*, k.a, k.b, k.c, k.c IS NULL OR n.s - k.c > 86400000000 AS ok FROM k JOIN n ON n.symbol = k.symbol AND n.rn = k.rn + 1))"


@query("stop_breaker", f"WITH RECURSIVE {BREAKER} SELECT symbol, event_id, stopped FROM k WHERE ok")
def stop_breaker(spark, sf):
    """Events kept when a symbol pauses after three stops in a day."""
    t = ticks(spark, sf).select("symbol", "event_id", F.unix_micros("ts").alias("s"), (F.col("price") > 80).alias("stopped"))
    return events.stop_breaker(t, 86_400_000_000, 3, key=KEY, at="s", stopped="stopped", tie=["event_id"]).drop("s")


@query("pair_regressions", out(BARS, "a b n", "beta alpha r2 resid_sd", "SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, regr_slope(ln(x.close + 1), ln(y.close + 1)) AS beta, regr_intercept(ln(x.close + 1), ln(y.close + 1)) AS alpha, regr_r2(ln(x.close + 1), ln(y.close + 1)) AS r2, sqrt(var_pop(ln(x.close + 1)) * (1 - regr_r2(ln(x.close + 1), ln(y.close + 1)))) AS resid_sd FROM bars x JOIN bars y ON x.t = y.t AND x.symbol < y.symbol GROUP BY 1, 2"))
def pair_regressions(spark, sf):
    return pairs.pair_regression(bars(spark, sf).withColumn("lp", F.log1p("close")))


PAIR = BARS + ", pp AS (SELECT x.symbol AS a, y.symbol AS b, x.t, ln(x.close + 1) AS va, ln(y.close + 1) AS vb FROM bars x JOIN bars y ON x.t = y.t AND x.symbol < y.symbol), ft AS (SELECT a, b, regr_slope(va, vb) AS beta, regr_intercept(va, vb) AS alpha, sqrt(var_pop(va) * (1 - regr_r2(va, vb))) AS sd FROM pp GROUP BY 1, 2), rs AS (SELECT a, b, t, va - alpha - beta * vb AS resid, (va - alpha - beta * vb) / sd AS z FROM pp JOIN ft USING (a, b))"


def residuals(spark, sf):
    p = joins.symbol_pairs(bars(spark, sf).withColumn("lp", F.log1p("close")), "lp")
    r = pairs.residuals(p, pairs.regress(p, []), on=["a", "b"])
    return r.withColumn("z", F.col("resid") / F.nullif(F.col("resid_sd"), F.lit(0.0)))


#: Slope, t and half-life of change ``d`` on level ``l`` with a constant, as text over a table of (d, l).
_RHO = "regr_slope(d, l)"
_UNIT_ROOT = f"{_RHO} / sqrt((regr_syy(d, l) - {_RHO} * regr_sxy(d, l)) / (count(*) - 2) / regr_sxx(d, l))"
_HALF_LIFE = f"CASE WHEN {_RHO} < 0 AND {_RHO} > -1 THEN -ln(2) / ln(1 + {_RHO}) END"


@query("cointegration_statistics", out(
    PAIR + ", d AS (SELECT a, b, resid - lag(resid) OVER w AS d, lag(resid) OVER w AS l FROM rs WINDOW w AS (PARTITION BY a, b ORDER BY t))",
    "a b n", "t rho half_life", f"SELECT a, b, count(*) AS n, {_UNIT_ROOT} AS t, {_RHO} AS rho, {_HALF_LIFE} AS half_life FROM d WHERE l IS NOT NULL GROUP BY 1, 2",
))
def cointegration_statistics(spark, sf):
    return pairs.dickey_fuller(residuals(spark, sf), "resid", key=["a", "b"])


@query("half_lives", out(PAIR + ", d AS (SELECT a, b, resid - lag(resid) OVER w AS d, lag(resid) OVER w AS l FROM rs WINDOW w AS (PARTITION BY a, b ORDER BY t))", "a b", "slope half_life", "SELECT a, b, regr_slope(d, l) AS slope, CASE WHEN regr_slope(d, l) < 0 AND regr_slope(d, l) > -1 THEN -ln(2) / ln(1 + regr_slope(d, l)) END AS half_life FROM d GROUP BY 1, 2"))
def half_lives(spark, sf):
    return pairs.half_life(residuals(spark, sf), "resid", key=["a", "b"])


@query("reversion_curve", out(PAIR + ", m AS (SELECT floor(z / 0.5)::INT AS bin, " + ", ".join(f"lead(resid, {h}) OVER w - resid AS m{h}" for h in (1, 6)) + " FROM rs WINDOW w AS (PARTITION BY a, b ORDER BY t)), g AS (SELECT bin, count(*) AS n, avg(m1) AS m1, avg(m6) AS m6 FROM m GROUP BY 1)", "bin n horizon", "move", "SELECT bin, n, 1 AS horizon, m1 AS move FROM g UNION ALL SELECT bin, n, 6, m6 FROM g"))
def reversion_curve(spark, sf):
    return pairs.reversion_curve(residuals(spark, sf), "z", [1, 6], 0.5, key=["a", "b"])


def unit_root_sql(source: str, by: str, lags: int) -> str:
    """CTEs from ``source`` (``by``, t, resid) to ``ur`` (``by``, n, rho, ut, p): the lagged changes are taken out one by one, then change on level."""
    names = [f"d{j}" for j in range(1, lags + 1)]
    over = f"OVER (PARTITION BY {by})"
    rest = ["l", "d"]
    ctes = f"u0 AS (SELECT {by}, t, lag(resid) OVER k AS l, resid - lag(resid) OVER k AS d FROM {source} WINDOW k AS (PARTITION BY {by} ORDER BY t)), "
    ctes += f"u1 AS (SELECT *, {', '.join(f'lag(d, {j}) OVER k AS d{j}' for j in range(1, lags + 1))} FROM u0 WINDOW k AS (PARTITION BY {by} ORDER BY t)), "
    ctes += f"g0 AS (SELECT {by}, {', '.join(f'{c} - avg({c}) {over} AS {c}' for c in names + rest)} FROM u1 WHERE d{lags} IS NOT NULL)"
    for j, q in enumerate(names):
        left = names[j + 1 :] + rest
        ctes += f", g{j + 1} AS (SELECT {by}, {', '.join(f'{c} - sum({c} * {q}) {over} / sum({q} * {q}) {over} * {q} AS {c}' for c in left)} FROM g{j})"
    free = lags + 2
    ctes += f", ur AS (SELECT *, rho / sqrt((syy - rho * sxy) / (n - {free}) / sxx) AS ut FROM (SELECT {by}, count(*) AS n, sum(l * d) / sum(l * l) AS rho, sum(l * l) AS sxx, sum(l * d) AS sxy, sum(d * d) AS syy FROM g{lags} GROUP BY {by} HAVING count(*) > {free}))"
    low, high = "2.1659 + 1.4412 * ut + 0.038269 * ut * ut", "1.7339 + 0.93202 * ut - 0.12745 * ut * ut - 0.010368 * ut * ut * ut"
    return ctes + f", up AS (SELECT *, CASE WHEN ut > 2.74 THEN 1.0 WHEN ut < -18.83 THEN 0.0 WHEN ut <= -1.61 THEN {phi(low)} ELSE {phi(high)} END AS p FROM ur)"


@query("unit_root_lags", out(PAIR + ", " + unit_root_sql("rs", "a, b", 6), "a b n", "rho t p", "SELECT a, b, n, rho, ut AS t, p FROM up"))
def unit_root_lags(spark, sf):
    return pairs.unit_root_lags(residuals(spark, sf), "resid", 6, key=["a", "b"])


WEEKS = (
    PAIR + ", fm AS (SELECT a, b, t // 604800 AS w, regr_slope(va, vb) AS beta, regr_intercept(va, vb) AS alpha FROM pp GROUP BY 1, 2, 3), "
    "rw AS (SELECT pp.a, pp.b, w, t, va - alpha - beta * vb AS resid FROM pp JOIN fm ON pp.a = fm.a AND pp.b = fm.b AND t // 604800 = w), "
    "dw AS (SELECT a, b, w, resid - lag(resid) OVER k AS d, lag(resid) OVER k AS l FROM rw WINDOW k AS (PARTITION BY a, b, w ORDER BY t)), "
    f"hl AS (SELECT a, b, w, {_HALF_LIFE} AS half_life FROM dw WHERE l IS NOT NULL GROUP BY 1, 2, 3), " + unit_root_sql("rw", "a, b, w", 6) +
    ", ch AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY p, a, b) AS rank FROM up JOIN hl USING (a, b, w) WHERE n >= 20 AND p <= 0.2 AND half_life BETWEEN 0.05 AND 24)"
)


@query("pair_formation", out(
    WEEKS, "a b trade_week rank n", "half_life drift",
    "SELECT ch.a, ch.b, (ch.w + 1)::BIGINT AS trade_week, rank, count(*) AS n, any_value(half_life) AS half_life, avg(va - alpha - beta * vb) AS drift FROM ch JOIN fm ON fm.a = ch.a AND fm.b = ch.b AND fm.w = ch.w "
    "JOIN pp ON pp.a = ch.a AND pp.b = ch.b AND t // 604800 = ch.w + 1 WHERE rank <= 3 GROUP BY ch.a, ch.b, ch.w, rank",
))
def pair_formation(spark, sf):
    """Pairs formed on each week by the unit-root test with six lags, and followed through the next with the coefficients frozen."""
    p = joins.symbol_pairs(bars(spark, sf).withColumn("lp", F.log1p("close")), "lp").withColumn("w", F.floor(F.unix_timestamp("ts") / 604800))
    fits = pairs.regress(p, ["w"])
    r = pairs.residuals(p, fits, on=["a", "b", "w"])
    by = ["a", "b", "w"]
    stats = pairs.unit_root_lags(r, "resid", 6, key=by).where("n >= 20").join(pairs.dickey_fuller(r, "resid", key=by).select(*by, "half_life"), by)
    chosen = pairs.top_pairs(stats, F.lit(0.2), 0.05, 24.0, 3, by="p", window=["w"])
    frozen = chosen.select(*by, "rank", "half_life").join(fits.select(*by, "alpha", "beta"), by).withColumn("w", F.col("w") + 1)
    d = p.join(frozen, by).groupBy("a", "b", F.col("w").alias("trade_week"), "rank")
    return d.agg(F.count(F.lit(1)).alias("n"), F.first("half_life").alias("half_life"), F.avg(F.col("va") - F.col("alpha") - F.col("beta") * F.col("vb")).alias("drift"))


@query("pair_persistence", out(BARS + ", s AS (SELECT x.symbol AS a, y.symbol AS b, x.t // 432000 AS w, coalesce(CASE WHEN isnan(corr(x.close, y.close)) THEN 0 ELSE corr(x.close, y.close) END, 0) > 0 AS chosen FROM bars x JOIN bars y ON x.t = y.t AND x.symbol < y.symbol GROUP BY 1, 2, 3)", "n", "survival base_rate", "SELECT count(*) AS n, avg(l.chosen::INT) FILTER (s.chosen) AS survival, avg(l.chosen::INT) AS base_rate FROM s JOIN s l ON l.a = s.a AND l.b = s.b AND l.w = s.w + 1"))
def pair_persistence(spark, sf):
    p = joins.symbol_pairs(bars(spark, sf), "close").withColumn("w", F.floor(F.unix_timestamp("ts") / 432000))
    return pairs.persistence(p.groupBy("a", "b", "w").agg((F.coalesce(F.nanvl(F.corr("va", "vb"), F.lit(0.0)), F.lit(0.0)) > 0).alias("chosen")), 1)


@query("leave_one_out", out(TRADES + ", g AS (SELECT symbol, sum(pnl) AS s, count(pnl) AS n FROM trades GROUP BY 1), x AS (SELECT *, sum(s) OVER () AS st, sum(n) OVER () AS nt FROM g)", "symbol n", "mean_without share cluster_t", "SELECT symbol, n, (st - s) / (nt - n) AS mean_without, s / abs(st) AS share, (st / nt) / (sqrt(sum(pow(s - n * (st / nt), 2)) OVER ()) / nt) AS cluster_t FROM x", 4))
def leave_one_out(spark, sf):
    d = pairs.leave_one_out(trades(spark, sf), "pnl", KEY)
    return d.select("symbol", "n", *[rounded(c, 4).alias(c) for c in ("mean_without", "share", "cluster_t")])


_PT = PAIR + """, n AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY t) AS rn FROM rs),
 pt AS (SELECT DISTINCT a, b, 0::BIGINT AS t, 0::BIGINT AS rn, 0 AS side, 0::BIGINT AS held, 0.0::DOUBLE AS x0, 0::BIGINT AS trade, NULL::DOUBLE AS pnl, 0::BIGINT AS out_held FROM n
  UNION ALL SELECT n.a, n.b, n.t, n.rn,
   CASE WHEN k.side <> 0 THEN CASE WHEN n.z IS NOT NULL AND (abs(n.z) <= 0.5 OR abs(n.z) >= 4 OR k.held + 1 >= 48 OR n.z * k.side > 0) THEN 0 ELSE k.side END WHEN abs(n.z) >= 2 AND abs(n.z) < 4 THEN CASE WHEN n.z > 0 THEN -1 ELSE 1 END ELSE 0 END,
   CASE WHEN k.side <> 0 THEN k.held + 1 ELSE 0 END, CASE WHEN k.side = 0 THEN n.resid ELSE k.x0 END, CASE WHEN k.side = 0 AND abs(n.z) >= 2 AND abs(n.z) < 4 THEN k.trade + 1 ELSE k.trade END,
   CASE WHEN k.side <> 0 AND n.z IS NOT NULL AND (abs(n.z) <= 0.5 OR abs(n.z) >= 4 OR k.held + 1 >= 48 OR n.z * k.side > 0) THEN (n.resid - k.x0) * k.side END, k.held + 1
  FROM pt k JOIN n ON n.a = k.a AND n.b = k.b AND n.rn = k.rn + 1)"""


@query("pair_trades", out(_PT, "a b t trade held", "resid z pnl", "SELECT pt.a, pt.b, pt.t, n.resid, n.z, trade, pnl, out_held AS held FROM pt JOIN n ON n.a = pt.a AND n.b = pt.b AND n.rn = pt.rn WHERE pnl IS NOT NULL"))
def pair_trades(spark, sf):
    return pairs.pair_trades(residuals(spark, sf).select("a", "b", "ts", "resid", "z"), "z", 2.0, 0.5, 4.0, 48, key=["a", "b"])


_SHUFFLED = RETS + ", sx AS (SELECT symbol, t, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM rets WHERE r IS NOT NULL), sy AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY md5(concat_ws(':', 7, t, symbol)), t) AS i FROM rets WHERE r IS NOT NULL), sp AS (SELECT sx.symbol, sx.t, sum(sy.r) OVER (PARTITION BY sx.symbol ORDER BY sx.t) AS lp FROM sx JOIN sy ON sy.symbol = sx.symbol AND sy.i = sx.i), pp AS (SELECT x.symbol AS a, y.symbol AS b, x.t, x.lp AS va, y.lp AS vb FROM sp x JOIN sp y ON x.t = y.t AND x.symbol < y.symbol), ft AS (SELECT a, b, regr_slope(va, vb) AS beta, regr_intercept(va, vb) AS alpha FROM pp GROUP BY 1, 2), rs AS (SELECT a, b, t, va - alpha - beta * vb AS resid FROM pp JOIN ft USING (a, b)), dl AS (SELECT a, b, resid - lag(resid) OVER k AS d, lag(resid) OVER k AS l FROM rs WINDOW k AS (PARTITION BY a, b ORDER BY t))"+f", sm AS (SELECT a, b, {_UNIT_ROOT} AS t FROM dl WHERE l IS NOT NULL GROUP BY 1, 2)"


@query("shuffled_panel_cutoff", out(_SHUFFLED, "", "cutoff", "SELECT quantile_cont(t, 0.05) AS cutoff FROM sm", 4))
def shuffled_panel_cutoff(spark, sf):
    """Five-per-cent cutoff of the pair statistic when links between symbols are cut."""
    p = pairs.shuffled_panel(with_returns(spark, sf), "r", 7)
    q = joins.symbol_pairs(p, "lp")
    r = pairs.residuals(q, pairs.regress(q, []), on=["a", "b"]).withColumnsRenamed({"a": "pa", "b": "pb"})
    return pairs.null_cutoff(pairs.dickey_fuller(r, "resid", key=["pa", "pb"]), 0.05).select(rounded("cutoff", 4).alias("cutoff"))


SIDE = TICKS + ", tr AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN amount ELSE -amount END AS sv FROM ticks)"


def tape(spark, sf):
    """Ticks as a trade tape: even users buy, odd users sell."""
    return ticks(spark, sf).withColumn("side", F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell"))


@query("cumulative_delta", out(SIDE, "event_id", "cvd", "SELECT event_id, sum(sv) OVER (PARTITION BY symbol ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS cvd FROM tr"))
def cumulative_delta(spark, sf):
    t = tape(spark, sf).withColumn("at", F.struct("ts", "event_id"))
    return orderflow.cumulative_delta(t, key=KEY, ts="at").select("event_id", "cvd")


@query("footprint", out(SIDE + ", f AS (SELECT symbol, s // 86400 * 86400 AS t, floor(price / 10) * 10 AS px, sum(amount) AS volume, sum(sv) AS delta FROM tr GROUP BY 1, 2, 3)", "symbol t big", "px volume delta", "SELECT *, abs(delta) >= 20 AS big FROM f"))
def footprint(spark, sf):
    return orderflow.footprint(tape(spark, sf), 86400, 10.0, 20.0, key=KEY)


@query("delta_leads_price", out(SIDE + ", g AS (SELECT symbol, s // 3600 AS h, sum(sv) AS d, last(price ORDER BY ts, event_id) AS p FROM tr GROUP BY 1, 2), m AS (SELECT symbol, h, d, p - lag(p) OVER (PARTITION BY symbol ORDER BY h) AS dp FROM g)", "symbol lag", "corr", "SELECT symbol, k AS lag, corr(d, x) AS corr FROM (" + " UNION ALL ".join(f"SELECT symbol, {k} AS k, d, {'lead' if k >= 0 else 'lag'}(dp, {abs(k)}) OVER (PARTITION BY symbol ORDER BY h) AS x FROM m" for k in range(-3, 4)) + ") GROUP BY 1, 2"))
def delta_leads_price(spark, sf):
    g = tape(spark, sf).groupBy("symbol", F.date_trunc("hour", "ts").alias("h")).agg(F.sum(orderflow.signed_volume()).alias("d"), F.max_by("price", F.struct("ts", "event_id")).alias("p")).withColumnRenamed("h", "ts")
    g = g.withColumn("dp", F.col("p") - F.lag("p").over(ordered(KEY)))
    return orderflow.lagged_cross_correlation(g, "d", "dp", 3, key=KEY)


@query("price_interest_regimes", "WITH " + BARS + ", d AS (SELECT symbol, close - lag(close) OVER w AS dp, volume - lag(volume) OVER w AS dv FROM bars " + W + ") SELECT symbol, CASE WHEN dp > 0 AND dv > 0 THEN 'new longs' WHEN dp > 0 THEN 'short covering' WHEN dv > 0 THEN 'new shorts' ELSE 'long unwinding' END AS regime, count(*) AS n FROM d WHERE dp IS NOT NULL GROUP BY 1, 2")
def price_interest_regimes(spark, sf):
    w = ordered(KEY)
    d = bars(spark, sf).withColumn("regime", orderflow.regime_label(F.col("close") - F.lag("close").over(w), F.col("volume") - F.lag("volume").over(w)))
    return d.where("regime IS NOT NULL").groupBy("symbol", "regime").agg(F.count(F.lit(1)).alias("n"))


BOOK = "bk AS (SELECT vec_id, embedding AS e FROM embeddings)"


def ladder(spark, sf):
    """Vectors read as ladders: component i is the size at level i on either side of 100."""
    from tidemark.plans.base import table

    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    side = lambda sign, a: F.transform(F.slice("e", a, 10), lambda x, i: F.struct((F.lit(100.0) + sign * 0.01 * (i + 1)).alias("px"), F.abs(x).alias("sz")))
    return v.select("vec_id", side(-1, 1).alias("bids"), side(1, 11).alias("asks"))


@query("book_features", out(BOOK, "vec_id", "bid5 ask5 imb band", "SELECT vec_id, list_sum(list_transform(e[1:5], lambda x: abs(x::DOUBLE))) AS bid5, list_sum(list_transform(e[11:15], lambda x: abs(x::DOUBLE))) AS ask5, (list_sum(list_transform(e[1:5], lambda x: abs(x::DOUBLE))) - list_sum(list_transform(e[11:15], lambda x: abs(x::DOUBLE)))) / (list_sum(list_transform(e[1:5], lambda x: abs(x::DOUBLE))) + list_sum(list_transform(e[11:15], lambda x: abs(x::DOUBLE)))) AS imb, list_sum(list_transform(e[11:13], lambda x: abs(x::DOUBLE))) AS band FROM bk"))
def book_features(spark, sf):
    b = ladder(spark, sf)
    return b.select("vec_id", orderflow.depth("bids", 5).alias("bid5"), orderflow.depth("asks", 5).alias("ask5"), orderflow.imbalance(5).alias("imb"), orderflow.wall("asks", orderflow.mid(), 0.00035, above=True).alias("band"))


@query("book_round_trip", "SELECT count(*) AS books FROM embeddings")
def book_round_trip(spark, sf):
    """Nested ladders to wide columns and back: all are the same."""
    b = ladder(spark, sf)
    wide = orderflow.wide_book(b, 10, levels="bids", side="bid").drop("bids", "asks")
    back = orderflow.nested_book(wide, 10, side="bid", out="again")
    return b.join(back, "vec_id").where(F.col("bids") == F.col("again")).agg(F.count(F.lit(1)).alias("books"))


# latch at z of 20 hours: short above 1, long below -1, out inside a quarter
Z = BARS + ", zz AS (SELECT symbol, t, close, CASE WHEN count(close) OVER k >= 20 THEN (close - avg(close) OVER k) / nullif(stddev_samp(close) OVER k, 0) END AS z, row_number() OVER (PARTITION BY symbol ORDER BY t) AS rn FROM bars WINDOW k AS (PARTITION BY symbol ORDER BY t ROWS 19 PRECEDING)), n AS (SELECT * FROM zz), lt AS (SELECT symbol, t, rn, 0.0::DOUBLE AS pos FROM n WHERE rn = 1 UNION ALL SELECT n.symbol, n.t, n.rn, CASE WHEN n.z IS NULL THEN 0.0 WHEN n.z <= -1 THEN 1.0 WHEN n.z >= 1 THEN -1.0 WHEN lt.pos > 0 AND n.z >= -0.25 THEN 0.0 WHEN lt.pos < 0 AND n.z <= 0.25 THEN 0.0 ELSE lt.pos END FROM lt JOIN n ON n.symbol = lt.symbol AND n.rn = lt.rn + 1), ps AS (SELECT symbol, t, coalesce(lag(pos) OVER (PARTITION BY symbol ORDER BY t), 0) AS position FROM lt)"
NET = Z + ", g AS (SELECT b.symbol, b.t, close, position, lag(position, 1, 0) OVER w * coalesce(close / nullif(lag(close) OVER w, 0) - 1, 0) / 100 - abs(position - lag(position, 1, 0) OVER w) * 0.0005 AS net FROM (SELECT b.*, ps.position FROM bars b JOIN ps USING (symbol, t)) b WINDOW w AS (PARTITION BY symbol ORDER BY t))"


def latched(spark, sf, block_seconds=None):
    b = bars(spark, sf).withColumn("z", rolling.zscore(F.col("close"), rolling.last_k(20, KEY), 20))
    b = b.withColumns({"li": F.col("z") <= -1, "lo": F.col("z") >= -0.25, "si": F.col("z") >= 1, "so": F.col("z") <= 0.25})
    d = scans.latch(b, "li", "lo", "si", "so", key=KEY, block_seconds=block_seconds)
    return d.withColumn("position", F.lag("latched", 1, 0.0).over(ordered(KEY)))


def netted(spark, sf):
    """Returns of the latched position at a hundredth of the price move, less costs."""
    d = latched(spark, sf)
    w = ordered(KEY)
    r = F.coalesce(F.try_divide(F.col("close"), F.lag("close").over(w)) - 1, F.lit(0.0)) / 100
    return d.withColumn("net", F.lag("position", 1, 0.0).over(w) * r - F.abs(F.col("position") - F.lag("position", 1, 0.0).over(w)) * 0.0005)


@query("zscore_latch", out(Z, "symbol t", "position", "SELECT * FROM ps"))
def zscore_latch(spark, sf):
    return latched(spark, sf).select("symbol", "ts", "position")


@query("zscore_latch_in_blocks", out(Z, "symbol t", "position", "SELECT * FROM ps"))
def zscore_latch_in_blocks(spark, sf):
    """The same latch with two days of a symbol a block."""
    return latched(spark, sf, 172_800).select("symbol", "ts", "position")


FLAGSHIP_SQL = out(NET + ", e AS (SELECT symbol, t, net, product(1 + net) OVER (PARTITION BY symbol ORDER BY t ROWS UNBOUNDED PRECEDING) AS eq FROM g), d AS (SELECT *, eq / max(eq) OVER (PARTITION BY symbol ORDER BY t) - 1 AS dd FROM e)", "symbol bars", "sharpe max_drawdown total_return", "SELECT symbol, count(*) AS bars, CASE WHEN coalesce(stddev_samp(net), 0) = 0 THEN 0 ELSE avg(net) / stddev_samp(net) * sqrt(8760) END AS sharpe, -min(dd) AS max_drawdown, last(eq ORDER BY t) - 1 AS total_return FROM d GROUP BY 1")


@query("latched_reversion_performance", FLAGSHIP_SQL)
def latched_reversion_performance(spark, sf):
    """Hourly bars, z-score latch, lagged position, net return, risk per symbol."""
    d = netted(spark, sf).withColumn("equity", rolling.running_product(F.col("net"), KEY))
    d = metrics.drawdown(d, "equity", key=KEY)
    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), metrics.sharpe(F.col("net"), HOUR_PPY).alias("sharpe"), (-F.min("dd")).alias("max_drawdown"), (F.max_by("equity", "ts") - 1).alias("total_return"))


@query("round_trips", out(NET + ", f AS (SELECT *, CASE WHEN lag(position) OVER w = position THEN 0 ELSE 1 END AS ch FROM g " + W + "), k AS (SELECT *, sum(ch) OVER w AS run FROM f " + W + ")", "symbol entry exit bars direction", "position pnl", "SELECT symbol, min(t) AS entry, max(t) AS exit, count(*) AS bars, any_value(position) AS position, CASE WHEN any_value(position) > 0 THEN 'long' ELSE 'short' END AS direction, product(1 + net) - 1 AS pnl FROM k WHERE position <> 0 GROUP BY symbol, run"))
def round_trips(spark, sf):
    return returns.round_trips(netted(spark, sf), key=KEY)


@query("time_in_position", out(Z, "n", "pct", "SELECT count(*) AS n, avg(p) * 100 AS pct FROM (SELECT t, max((position <> 0)::INT) AS p FROM ps GROUP BY 1)"))
def time_in_position(spark, sf):
    d = latched(spark, sf).groupBy("ts").agg(F.max((F.col("position") != 0).cast("int")).alias("p"))
    return d.agg(F.count(F.lit(1)).alias("n"), (F.avg("p") * 100).alias("pct"))


@query("daily_turnover", out(Z + ", m AS (SELECT t // 86400 AS d, abs(position - lag(position) OVER (PARTITION BY symbol ORDER BY t)) AS m FROM ps)", "", "turnover", "SELECT sum(m) / (max(d) - min(d) + 1) AS turnover FROM m"))
def daily_turnover(spark, sf):
    return metrics.turnover(latched(spark, sf), "position")


@query("densified_signals", out(BARS + ", sg AS (SELECT symbol, t, CASE WHEN close > 60 THEN 2.0 WHEN close < 10 THEN -0.5 END AS p FROM bars), u AS (SELECT * FROM sg WHERE p IS NOT NULL)", "symbol t", "position", "SELECT b.symbol, b.t, greatest(-1.0, least(1.0, coalesce(last_value(u.p IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.t), 0))) AS position FROM bars b LEFT JOIN u USING (symbol, t)"))
def densified_signals(spark, sf):
    b = bars(spark, sf)
    s = b.withColumn("position", F.when(F.col("close") > 60, 2.0).when(F.col("close") < 10, -0.5)).where("position IS NOT NULL").select("symbol", "ts", "position")
    return returns.densify(b.select("symbol", "ts", "close"), s, key=KEY).select("symbol", "ts", "position")


@query("funding_cashflows", out(BARS + ", f AS (SELECT symbol, unnest(range(min(t) // 28800 * 28800, max(t) + 1, 28800)) AS t FROM bars GROUP BY 1), m AS (SELECT f.symbol, f.t, b.volume * 0.0001 AS paid FROM f ASOF JOIN bars b ON f.symbol = b.symbol AND f.t >= b.t)", "symbol t", "paid paid_to_date", "SELECT symbol, t, paid, sum(paid) OVER (PARTITION BY symbol ORDER BY t) AS paid_to_date FROM m"))
def funding_cashflows(spark, sf):
    from tidemark.operators.grid import spine

    b = bars(spark, sf).select("symbol", "ts", F.col("volume").alias("notional"))
    f = spine(b, 28800, key=KEY).withColumn("rate", F.lit(0.0001))
    return returns.funding_cashflow(f, b, key=KEY).select("symbol", "ts", "paid", "paid_to_date")


@query("trading_cost", out(BARS, "symbol t", "cost_bps", "SELECT symbol, t, greatest(0.5, least(50.0, 2.0 + coalesce(100 * 50.0 / nullif(avg(close * volume) OVER (PARTITION BY symbol ORDER BY t ROWS 59 PRECEDING), 0), 0))) AS cost_bps FROM bars"))
def trading_cost(spark, sf):
    return returns.cost_bps(bars(spark, sf), base=2.0, order=50.0, k=100.0, key=KEY).select("symbol", "ts", "cost_bps")


@query("buy_and_hold", out(BARS, "t", "benchmark", "SELECT t, avg(g) AS benchmark FROM (SELECT t, close / nullif(first_value(close) OVER (PARTITION BY symbol ORDER BY t), 0) AS g FROM bars) GROUP BY 1"))
def buy_and_hold(spark, sf):
    return returns.benchmark(bars(spark, sf))


@query("leverage_grid", out(RETS + ", x AS (SELECT symbol, t, l AS leverage, 1 + l * coalesce(r, 0) / 10 AS g FROM rets CROSS JOIN (VALUES (1.0::DOUBLE), (3.0)) v(l)), d AS (SELECT *, max((g <= 0)::INT) OVER k AS dead, product(CASE WHEN g > 0 THEN g ELSE 1 END) OVER k AS live FROM x WINDOW k AS (PARTITION BY symbol, leverage ORDER BY t ROWS UNBOUNDED PRECEDING))", "symbol leverage survived", "value", "SELECT symbol, leverage, max(dead) = 0 AS survived, last(CASE WHEN dead = 1 THEN 0 ELSE live END ORDER BY t) AS value FROM d GROUP BY 1, 2"))
def leverage_grid(spark, sf):
    d = returns.leverage_grid(with_returns(spark, sf).withColumn("r10", F.col("r") / 10), "r10", [1.0, 3.0], key=KEY)
    g = d.groupBy("symbol", "leverage").agg(F.max_by("value", "ts").alias("value"))
    return g.select("symbol", "leverage", (F.col("value") > 0).alias("survived"), "value")


@query("event_book_audit", "SELECT count(*) AS rows, 0::BIGINT AS entry_not_after_signal, count(*) FILTER (l_tax + 0.95 > 1) AS bad_frac, count(*) FILTER (l_shipdate + INTERVAL 1 MINUTE < TIMESTAMP '1996-01-01' OR l_shipdate + INTERVAL 1 MINUTE >= TIMESTAMP '2001-01-01') AS outside_windows, 0::BIGINT AS no_symbol, (SELECT count(*) FROM (SELECT l_returnflag, l_shipdate FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1)) AS duplicates, 0 AS missing_columns, 1 AS undeclared_columns FROM lineitem")
def event_book_audit(spark, sf):
    from tidemark.plans.base import table

    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("sym"), F.col("l_shipdate").cast("timestamp").alias("signal_ts"), (F.col("l_shipdate").cast("timestamp") + F.expr("INTERVAL 1 MINUTE")).alias("entry_ts"), (F.col("l_tax") + 0.95).alias("frac"), F.col("l_discount").alias("liq"), F.col("l_quantity").alias("pnl"))
    return book.audit(book.declare(li, {"liq": 0}), "1996-01-01", "2001-01-01")


@query("causal_book_filter", "SELECT l_returnflag AS sym, count(*) AS n FROM lineitem WHERE l_discount >= 0.05 GROUP BY 1")
def causal_book_filter(spark, sf):
    from tidemark.plans.base import table

    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("sym"), F.col("l_discount").alias("liq"), F.col("l_quantity").alias("pnl240"))
    b = book.declare(li, {"liq": 0, "pnl240": 240})
    return book.causal_filter(b, F.col("liq") >= 0.05, ["liq"]).groupBy("sym").agg(F.count(F.lit(1)).alias("n"))


@query("cvd_grid_divergence", out(SIDE + ", g AS (SELECT symbol, s // 3600 AS h, sum(sv) AS d, last(price ORDER BY ts, event_id) AS p FROM tr GROUP BY 1, 2), m AS (SELECT symbol, h, sum(d) OVER (PARTITION BY symbol ORDER BY h ROWS 5 PRECEDING) AS dc, p - lag(p, 6) OVER w AS dp, lead(p, 6) OVER w / nullif(p, 0) - 1 AS f FROM g WINDOW w AS (PARTITION BY symbol ORDER BY h))", "symbol kind n", "fwd", "SELECT symbol, CASE WHEN dc > 0 AND dp < 0 THEN 'bullish' WHEN dc < 0 AND dp > 0 THEN 'bearish' ELSE 'none' END AS kind, count(f) AS n, avg(f) AS fwd FROM m WHERE dp IS NOT NULL GROUP BY 1, 2", 4))
def cvd_grid_divergence(spark, sf):
    """Six-hour flow against price, and the mean return of the next six hours."""
    g = tape(spark, sf).groupBy("symbol", F.date_trunc("hour", "ts").alias("h")).agg(F.sum(orderflow.signed_volume()).alias("d"), F.max_by("price", F.struct("ts", "event_id")).alias("p")).withColumnRenamed("h", "ts")
    w = ordered(KEY)
    g = g.withColumns({"dc": F.sum("d").over(w.rowsBetween(-5, 0)), "dp": F.col("p") - F.lag("p", 6).over(w), "f": rolling.forward_return("p", KEY, k=6)}).where("dp IS NOT NULL")
    kind = F.when((F.col("dc") > 0) & (F.col("dp") < 0), "bullish").when((F.col("dc") < 0) & (F.col("dp") > 0), "bearish").otherwise("none")
    d = g.groupBy("symbol", kind.alias("kind")).agg(F.count("f").alias("n"), F.avg("f").alias("fwd"))
    return d.select("symbol", "kind", "n", rounded("fwd", 4).alias("fwd"))
