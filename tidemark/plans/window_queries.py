"""Queries: rolling, recursive, rank and cross-sectional windows, and indicators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.operators import order_stats, rolling, scans
from tidemark.operators.grid import ordered, up_to_now
from tidemark.plans.base import BARS, HOUR_PPY, KEY, RETS, TICKS, W, bars, ewm_sql, out, query, ticks, with_returns
from tidemark.operators.rolling import last_k
from tidemark.plans.recipe_sql import FLAT_SQL

TR = "tr AS (SELECT *, CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM bars " + W + ")"


def _frame(k: int) -> str:
    return f"(PARTITION BY symbol ORDER BY t ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


@query("lag_lead_returns", out(BARS, "symbol t", "diff pct lr fwd", "SELECT symbol, t, close - lag(close) OVER w AS diff, close / nullif(lag(close) OVER w, 0) - 1 AS pct, CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END AS lr, lead(close, 3) OVER w / nullif(close, 0) - 1 AS fwd FROM bars " + W))
def lag_lead_returns(spark, sf):
    w = ordered(KEY)
    return bars(spark, sf).select("symbol", "ts", (F.col("close") - F.lag("close").over(w)).alias("diff"), rolling.simple_return("close", KEY).alias("pct"), rolling.log_return("close", KEY).alias("lr"), rolling.forward_return("close", KEY, k=3).alias("fwd"))


@query("rolling_statistics", out(BARS, "symbol t", "m s p total lo hi", f"SELECT symbol, t, CASE WHEN n >= 10 THEN m END AS m, CASE WHEN n >= 10 THEN s END AS s, CASE WHEN n >= 10 THEN p END AS p, CASE WHEN n >= 10 THEN total END AS total, CASE WHEN n >= 10 THEN lo END AS lo, CASE WHEN n >= 10 THEN hi END AS hi FROM (SELECT symbol, t, count(close) OVER w AS n, avg(close) OVER w AS m, stddev_samp(close) OVER w AS s, stddev_pop(close) OVER w AS p, sum(close) OVER w AS total, min(close) OVER w AS lo, max(close) OVER w AS hi FROM bars WINDOW w AS {_frame(20)})"))
def rolling_statistics(spark, sf):
    w, c = last_k(20, KEY), F.col("close")
    r = lambda f: rolling.rolling(f, c, w, 10)
    return bars(spark, sf).select("symbol", "ts", r(F.avg).alias("m"), r(F.stddev_samp).alias("s"), r(F.stddev_pop).alias("p"), r(F.sum).alias("total"), r(F.min).alias("lo"), r(F.max).alias("hi"))


@query("rolling_quantiles", out(BARS, "symbol t", "q25 med", f"SELECT symbol, t, CASE WHEN count(close) OVER w >= 10 THEN quantile_cont(close, 0.25) OVER w END AS q25, CASE WHEN count(close) OVER w >= 10 THEN quantile_cont(close, 0.5) OVER w END AS med FROM bars WINDOW w AS {_frame(24)}"))
def rolling_quantiles(spark, sf):
    w, c = last_k(24, KEY), F.col("close")
    return bars(spark, sf).select("symbol", "ts", rolling.rolling_quantile(c, 0.25, w, 10).alias("q25"), rolling.rolling_quantile(c, 0.5, w, 10).alias("med"))


@query("rolling_rank", out(BARS, "symbol t", "rank_pct", f"SELECT symbol, t, CASE WHEN len(xs) >= 24 THEN (len(list_filter(xs, lambda v: v < close)) + (len(list_filter(xs, lambda v: v = close)) + 1) / 2.0) / len(xs) END AS rank_pct FROM (SELECT symbol, t, close, list(close) OVER {_frame(24)} AS xs FROM bars)"))
def rolling_rank(spark, sf):
    return bars(spark, sf).select("symbol", "ts", rolling.rolling_rank_pct(F.col("close"), last_k(24, KEY), 24).alias("rank_pct"))


@query("rolling_zscore", out(BARS, "symbol t", "z", f"SELECT symbol, t, CASE WHEN count(close) OVER w >= 20 THEN (close - avg(close) OVER w) / nullif(stddev_samp(close) OVER w, 0) END AS z FROM bars WINDOW w AS {_frame(20)}"))
def rolling_zscore(spark, sf):
    return bars(spark, sf).select("symbol", "ts", rolling.zscore(F.col("close"), last_k(20, KEY), 20).alias("z"))


@query("ewm_close", out(BARS + ", " + ewm_sql("bars", "close", 0.1, "e"), "symbol t", "y", "SELECT symbol, t, y FROM e"))
def ewm_close(spark, sf):
    return scans.ewm(bars(spark, sf), "close", 0.1, "y", key=KEY).select("symbol", "ts", "y")


@query("ewm_per_user", "WITH RECURSIVE n AS (SELECT user_id AS symbol, event_id AS t, value AS x, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events), e AS (SELECT symbol, t, rn, x AS y FROM n WHERE rn = 1 UNION ALL SELECT n.symbol, n.t, n.rn, 0.7 * e.y + 0.3 * n.x FROM e JOIN n ON n.symbol = e.symbol AND n.rn = e.rn + 1) SELECT symbol AS user_id, t AS event_id, round(y, 6) AS y FROM e")
def ewm_per_user(spark, sf):
    """Many keys, blocks of 16 rows: the block scan's carry is exercised."""
    t = ticks(spark, sf).select("user_id", "ts", "event_id", "price").withColumn("at", F.struct("ts", "event_id"))
    w = Window.partitionBy("user_id").orderBy("at")
    d = t.withColumn("rn", F.row_number().over(w)).withColumns({"a": F.when(F.col("rn") == 1, 0.0).otherwise(0.7), "b": F.when(F.col("rn") == 1, F.col("price")).otherwise(0.3 * F.col("price"))}).drop("at")
    return scans.affine_scan(d, "a", "b", "y", key=["user_id"], ts="rn", block=16).select("user_id", "event_id", "y")


@query("cumulative", out(RETS, "symbol t", "total peak growth", "SELECT symbol, t, sum(close) OVER w AS total, max(close) OVER w AS peak, exp(sum(coalesce(r, 0)) OVER w) AS growth FROM rets " + W))
def cumulative(spark, sf):
    b = with_returns(spark, sf)
    return b.select("symbol", "ts", F.sum("close").over(up_to_now(KEY)).alias("total"), F.max("close").over(up_to_now(KEY)).alias("peak"), rolling.running_product(F.exp("r") - 1, KEY).alias("growth"))


@query("first_of_day", out(BARS, "symbol t", "day_open", "SELECT symbol, t, first_value(open) OVER (PARTITION BY symbol, t // 86400 ORDER BY t) AS day_open FROM bars"))
def first_of_day(spark, sf):
    return bars(spark, sf).select("symbol", "ts", F.first("open").over(Window.partitionBy("symbol", F.date_trunc("day", "ts")).orderBy("ts")).alias("day_open"))


def _wma(x: str, k: int) -> str:
    return "(" + " + ".join(f"{k - i} * lag({x}, {i}) OVER w" if i else f"{k} * {x}" for i in range(k)) + f") / {k * (k + 1) / 2}"


@query("weighted_average", out(BARS, "symbol t", "wma", f"SELECT symbol, t, {_wma('close', 9)} AS wma FROM bars {W}"))
def weighted_average(spark, sf):
    return bars(spark, sf).select("symbol", "ts", rolling.weighted_average(F.col("close"), 9, KEY).alias("wma"))


@query("hull_average", out(BARS + f", h AS (SELECT symbol, t, 2 * {_wma('close', 8)} - {_wma('close', 16)} AS h FROM bars {W})", "symbol t", "hma", f"SELECT symbol, t, CASE WHEN count(h) OVER (PARTITION BY symbol ORDER BY t ROWS 3 PRECEDING) = 4 THEN {_wma('h', 4)} END AS hma FROM h {W}"))
def hull_average(spark, sf):
    return ind.hull(bars(spark, sf), 16).select("symbol", "ts", "hma")


@query("rolling_sharpe", out(RETS, "symbol t", "sharpe", f"SELECT symbol, t, CASE WHEN count(r) OVER w = 48 THEN avg(r) OVER w / nullif(stddev_samp(r) OVER w, 0) * sqrt(8760) END AS sharpe FROM rets WINDOW w AS {_frame(48)}"))
def rolling_sharpe(spark, sf):
    w, r = last_k(48, KEY), F.col("r")
    s = rolling.rolling(F.avg, r, w, 48) / F.nullif(F.stddev_samp(r).over(w), F.lit(0.0)) * F.sqrt(F.lit(HOUR_PPY))
    return with_returns(spark, sf).select("symbol", "ts", s.alias("sharpe"))


@query("rank_regimes", "WITH " + BARS + " SELECT symbol, t, round((rank() OVER (PARTITION BY symbol ORDER BY volume) + (count(*) OVER (PARTITION BY symbol, volume) - 1) / 2.0) / count(*) OVER (PARTITION BY symbol), 6) AS pct FROM bars")
def rank_regimes(spark, sf):
    return rolling.rank_pct(bars(spark, sf), "volume", "pct", KEY).select("symbol", "ts", "pct")


@query("quantile_bins", "WITH " + BARS + ", e AS (SELECT symbol, quantile_cont(close, 0.2) AS a, quantile_cont(close, 0.4) AS b, quantile_cont(close, 0.6) AS c, quantile_cont(close, 0.8) AS d FROM bars GROUP BY 1) SELECT symbol, t, (close > a)::INT + (close > b)::INT + (close > c)::INT + (close > d)::INT AS bin FROM bars JOIN e USING (symbol)")
def quantile_bins(spark, sf):
    return rolling.quantile_cut(bars(spark, sf), "close", 5, "bin", KEY).select("symbol", "ts", "bin")


@query("fixed_bins", "WITH " + TICKS + " SELECT CASE WHEN price > 0 AND price <= 10 THEN 0 WHEN price > 10 AND price <= 50 THEN 1 WHEN price > 50 AND price <= 100 THEN 2 END AS bin, count(*) AS n FROM ticks GROUP BY 1")
def fixed_bins(spark, sf):
    return ticks(spark, sf).groupBy(rolling.fixed_cut(F.col("price"), [0, 10, 50, 100]).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("runs_above_mean", "WITH " + BARS + ", f AS (SELECT symbol, t, close > 40 AS up FROM bars), c AS (SELECT *, CASE WHEN lag(up) OVER w = up THEN 0 ELSE 1 END AS ch FROM f " + W + "), g AS (SELECT *, sum(ch) OVER w AS run FROM c " + W + ") SELECT symbol, run, min(t) AS first, count(*) AS n FROM g WHERE up GROUP BY 1, 2")
def runs_above_mean(spark, sf):
    b = bars(spark, sf).withColumn("up", F.col("close") > 40)
    return rolling.runs(b, "up", "run", KEY).where("up").groupBy("symbol", "run").agg(F.min("ts").alias("first"), F.count(F.lit(1)).alias("n"))


@query("swing_pivots", "WITH " + BARS + ", x AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS idx, list(high) OVER a AS hs, list(low) OVER a AS ls FROM bars WINDOW a AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)) SELECT symbol, t, idx + 3 AS confirmed_idx, (high = list_max(hs) AND len(list_filter(hs, lambda v: v = high)) = 1) AS is_high, (low = list_min(ls) AND len(list_filter(ls, lambda v: v = low)) = 1) AS is_low FROM x WHERE len(hs) = 7 AND ((high = list_max(hs) AND len(list_filter(hs, lambda v: v = high)) = 1) OR (low = list_min(ls) AND len(list_filter(ls, lambda v: v = low)) = 1))")
def swing_pivots(spark, sf):
    return rolling.swing_points(bars(spark, sf), 3, KEY).where("is_high OR is_low").select("symbol", "ts", F.col("confirmed_idx").cast("long").alias("confirmed_idx"), "is_high", "is_low")


@query("fractals_held", out(BARS, "symbol t", "fractal_up fractal_down", "SELECT symbol, t, last_value(u IGNORE NULLS) OVER w AS fractal_up, last_value(d IGNORE NULLS) OVER w AS fractal_down FROM (SELECT symbol, t, CASE WHEN lag(high, 2) OVER w > greatest(high, lag(high) OVER w) AND lag(high, 2) OVER w > lag(high, 3) OVER w AND lag(high, 2) OVER w > lag(high, 4) OVER w THEN lag(high, 2) OVER w END AS u, CASE WHEN lag(low, 2) OVER w < least(low, lag(low) OVER w) AND lag(low, 2) OVER w < lag(low, 3) OVER w AND lag(low, 2) OVER w < lag(low, 4) OVER w THEN lag(low, 2) OVER w END AS d FROM bars " + W + ") " + W))
def fractals_held(spark, sf):
    return ind.fractals(bars(spark, sf)).select("symbol", "ts", "fractal_up", "fractal_down")


@query("donchian_channel", out(BARS, "symbol t", "dc_up dc_low", "SELECT symbol, t, CASE WHEN count(*) OVER p = 20 THEN max(high) OVER p END AS dc_up, CASE WHEN count(*) OVER p = 20 THEN min(low) OVER p END AS dc_low FROM bars WINDOW p AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING)"))
def donchian_channel(spark, sf):
    return ind.donchian(bars(spark, sf), 20).select("symbol", "ts", "dc_up", "dc_low")


@query("last_shock_before", "WITH " + BARS + " SELECT symbol, t, last_value(CASE WHEN volume >= 45 THEN t END IGNORE NULLS) OVER w AS shock_t, max((volume >= 45)::INT) OVER (PARTITION BY symbol ORDER BY t ROWS 5 PRECEDING) = 1 AS recent FROM bars " + W)
def last_shock_before(spark, sf):
    b = bars(spark, sf).withColumn("hit", F.col("volume") >= 45)
    at = F.last(F.when(F.col("hit"), F.unix_timestamp("ts")), ignorenulls=True).over(up_to_now(KEY))
    return b.select("symbol", "ts", at.alias("shock_t"), F.max("hit").over(last_k(6, KEY)).alias("recent"))


@query("cross_section", out(BARS, "symbol t", "cs_mean cs_std cs_median cs_z", "SELECT symbol, t, CASE WHEN n >= 4 THEN m END AS cs_mean, CASE WHEN n >= 4 THEN s END AS cs_std, CASE WHEN n >= 4 THEN q END AS cs_median, CASE WHEN n >= 4 THEN (close - m) / nullif(s, 0) END AS cs_z FROM (SELECT *, count(close) OVER x AS n, avg(close) OVER x AS m, stddev_samp(close) OVER x AS s, quantile_cont(close, 0.5) OVER x AS q FROM bars WINDOW x AS (PARTITION BY t))"))
def cross_section(spark, sf):
    return rolling.cross_section(bars(spark, sf), "close", least=4).select("symbol", "ts", "cs_mean", "cs_std", "cs_median", "cs_z")


@query("long_short_book", out(BARS, "symbol t", "position", "SELECT symbol, t, coalesce(last_value(p IGNORE NULLS) OVER w, 0) AS position FROM (SELECT b.symbol, b.t, CASE WHEN i % 6 = 0 THEN CASE WHEN n < 4 THEN 0.0 WHEN up <= 2 THEN 0.25 WHEN down <= 2 THEN -0.25 ELSE 0.0 END END AS p FROM (SELECT symbol, t, count(*) OVER (PARTITION BY t) AS n, row_number() OVER (PARTITION BY t ORDER BY close DESC, symbol) AS up, row_number() OVER (PARTITION BY t ORDER BY close, symbol) AS down FROM bars) b JOIN (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT t FROM bars)) x USING (t)) " + W))
def long_short_book(spark, sf):
    return rolling.long_short_ranks(bars(spark, sf), "close", 2, 6).select("symbol", "ts", "position")


@query("gross_capped", out(BARS, "symbol t", "position", "SELECT symbol, t, (close - 40) / 40 * least(1.0, 1.5 / nullif(sum(abs((close - 40) / 40)) OVER (PARTITION BY t), 0)) AS position FROM bars"))
def gross_capped(spark, sf):
    return rolling.gross_cap(bars(spark, sf).withColumn("position", (F.col("close") - 40) / 40), 1.5).select("symbol", "ts", "position")


@query("index_without_self", out(RETS + f", v AS (SELECT *, sum(close * volume) OVER {_frame(24)} AS dv0 FROM rets), l AS (SELECT *, lag(dv0) OVER w AS dv FROM v {W}), g AS (SELECT *, dv / nullif(sum(dv) OVER (PARTITION BY t), 0) AS weight FROM l WHERE r IS NOT NULL AND dv IS NOT NULL)", "symbol t", "others", "SELECT symbol, t, (sum(weight * r) OVER (PARTITION BY t) - weight * r) / nullif(1 - weight, 0) AS others FROM g WHERE true"))
def index_without_self(spark, sf):
    d = rolling.leave_one_out_index(bars(spark, sf), 24)
    return d.select("symbol", "ts", F.when(F.col("weight") < 1, F.col("others")).alias("others"))


@query("cooldown_events", "WITH RECURSIVE " + TICKS + ", h AS (SELECT symbol, s, row_number() OVER (PARTITION BY symbol ORDER BY s, event_id) AS rn FROM ticks WHERE price > 60), e AS (SELECT symbol, rn, s, s AS kept, true AS k FROM h WHERE rn = 1 UNION ALL SELECT h.symbol, h.rn, h.s, CASE WHEN h.s - e.kept >= 7200 THEN h.s ELSE e.kept END, h.s - e.kept >= 7200 FROM e JOIN h ON h.symbol = e.symbol AND h.rn = e.rn + 1) SELECT symbol, s FROM e WHERE k")
def cooldown_events(spark, sf):
    t = ticks(spark, sf).where("price > 60").select("symbol", F.unix_timestamp("ts").alias("s"))
    return scans.cooldown(t, "s", 7200, key=KEY)


@query("atr_wilder", out(BARS + ", " + TR + ", " + ewm_sql("tr", "tr", "(1.0/14)", "e"), "symbol t", "atr", "SELECT symbol, t, CASE WHEN rn >= 14 THEN y END AS atr FROM e"))
def atr_wilder(spark, sf):
    return ind.atr(bars(spark, sf)).select("symbol", "ts", "atr")


@query("realised_vol", out(RETS, "symbol t", "realised_vol", f"SELECT symbol, t, CASE WHEN count(r) OVER w >= 30 THEN stddev_samp(r) OVER w END AS realised_vol FROM rets WINDOW w AS {_frame(30)}"))
def realised_vol(spark, sf):
    return ind.realised_vol(bars(spark, sf)).select("symbol", "ts", "realised_vol")


_UPDN = "ud AS (SELECT symbol, t, greatest(close - lag(close) OVER w, 0) AS up, greatest(lag(close) OVER w - close, 0) AS dn, lag(close) OVER w AS pc FROM bars " + W + "), ud2 AS (SELECT symbol, t, CASE WHEN pc IS NOT NULL THEN up END AS up, CASE WHEN pc IS NOT NULL THEN dn END AS dn FROM ud)"


@query("rsi_wilder", out(BARS + ", " + _UPDN + ", " + ewm_sql("ud2", "up", "(1.0/14)", "eu") + ", " + ewm_sql("ud2", "dn", "(1.0/14)", "ed"), "symbol t", "rsi", "SELECT b.symbol, b.t, CASE WHEN eu.rn >= 14 THEN CASE WHEN ed.y = 0 THEN 100 ELSE 100 - 100 / (1 + eu.y / ed.y) END END AS rsi FROM bars b LEFT JOIN eu USING (symbol, t) LEFT JOIN ed USING (symbol, t)"))
def rsi_wilder(spark, sf):
    return ind.rsi(bars(spark, sf)).select("symbol", "ts", "rsi")


@query("rsi_simple", out(BARS + ", " + _UPDN, "symbol t", "rsi", f"SELECT symbol, t, CASE WHEN count(up) OVER w >= 14 THEN CASE WHEN avg(dn) OVER w = 0 THEN 50 ELSE 100 - 100 / (1 + avg(up) OVER w / avg(dn) OVER w) END END AS rsi FROM ud2 WINDOW w AS {_frame(14)}"))
def rsi_simple(spark, sf):
    return ind.rsi(bars(spark, sf), smooth="simple", undefined=50.0).select("symbol", "ts", "rsi")


@query("bollinger_bands", out(BARS, "symbol t", "bb_mid bb_up bb_low bb_width", f"SELECT symbol, t, m AS bb_mid, m + 2 * s AS bb_up, m - 2 * s AS bb_low, 4 * s / nullif(m, 0) AS bb_width FROM (SELECT symbol, t, CASE WHEN count(close) OVER w >= 20 THEN avg(close) OVER w END AS m, CASE WHEN count(close) OVER w >= 20 THEN stddev_samp(close) OVER w END AS s FROM bars WINDOW w AS {_frame(20)})"))
def bollinger_bands(spark, sf):
    return ind.bollinger(bars(spark, sf)).select("symbol", "ts", "bb_mid", "bb_up", "bb_low", "bb_width")


@query("keltner_channel", out(BARS + ", " + TR + ", " + ewm_sql("bars", "close", "(2.0/21)", "m") + ", " + ewm_sql("tr", "tr", "(1.0/20)", "a"), "symbol t", "kc_mid kc_up kc_low", "SELECT m.symbol, m.t, m.y AS kc_mid, CASE WHEN a.rn >= 20 THEN m.y + 2 * a.y END AS kc_up, CASE WHEN a.rn >= 20 THEN m.y - 2 * a.y END AS kc_low FROM m JOIN a USING (symbol, t)"))
def keltner_channel(spark, sf):
    return ind.keltner(bars(spark, sf)).select("symbol", "ts", "kc_mid", "kc_up", "kc_low")


@query("macd_lines", out(BARS + ", " + ewm_sql("bars", "close", "(2.0/13)", "f") + ", " + ewm_sql("bars", "close", "(2.0/27)", "s") + ", md AS (SELECT f.symbol, f.t, f.y - s.y AS macd FROM f JOIN s USING (symbol, t)), " + ewm_sql("md", "macd", "(2.0/10)", "g"), "symbol t", "macd macd_signal", "SELECT md.symbol, md.t, macd, g.y AS macd_signal FROM md JOIN g USING (symbol, t)"))
def macd_lines(spark, sf):
    return ind.macd(bars(spark, sf)).select("symbol", "ts", "macd", "macd_signal")


_DM = TR + ", dm AS (SELECT symbol, t, tr, CASE WHEN u IS NOT NULL THEN CASE WHEN u > d AND u > 0 THEN u ELSE 0.0 END END AS p, CASE WHEN u IS NOT NULL THEN CASE WHEN d > u AND d > 0 THEN d ELSE 0.0 END END AS m FROM (SELECT symbol, t, tr, high - lag(high) OVER w AS u, lag(low) OVER w - low AS d FROM tr " + W + "))"


@query("adx_lines", out(BARS + ", " + _DM + ", " + ", ".join(ewm_sql("dm", x, "(1.0/14)", f"e{x}") for x in ("p", "m", "tr")) + ", di AS (SELECT symbol, t, 100 * ep.y / nullif(etr.y, 0) AS a, 100 * em.y / nullif(etr.y, 0) AS b, ep.rn FROM ep JOIN em USING (symbol, t) JOIN etr USING (symbol, t) WHERE ep.rn >= 14), dx AS (SELECT symbol, t, 100 * abs(a - b) / nullif(a + b, 0) AS dx FROM di), " + ewm_sql("dx", "dx", "(1.0/14)", "ax"), "symbol t", "di_plus di_minus adx", "SELECT b.symbol, b.t, di.a AS di_plus, di.b AS di_minus, CASE WHEN ax.rn >= 14 THEN ax.y END AS adx FROM bars b LEFT JOIN di USING (symbol, t) LEFT JOIN ax USING (symbol, t)"))
def adx_lines(spark, sf):
    return ind.adx(bars(spark, sf)).select("symbol", "ts", "di_plus", "di_minus", "adx")


@query("cci_line", out(BARS, "symbol t", "cci", f"SELECT symbol, t, CASE WHEN len(xs) = 20 THEN (tp - list_avg(xs)) / nullif(0.015 * list_avg(list_transform(xs, lambda v: abs(v - list_avg(xs)))), 0) END AS cci FROM (SELECT symbol, t, (high + low + close) / 3 AS tp, list((high + low + close) / 3) OVER {_frame(20)} AS xs FROM bars)"))
def cci_line(spark, sf):
    return ind.cci(bars(spark, sf)).select("symbol", "ts", "cci")


@query("kama_line", out(BARS + f", er AS (SELECT symbol, t, close, rn, abs(close - lag(close, 10) OVER w) / nullif(sum(d) OVER {_frame(10)}, 0) AS er FROM (SELECT *, row_number() OVER w AS rn, abs(close - lag(close) OVER w) AS d FROM bars {W}) {W}), n AS (SELECT *, pow(er * (2.0/3 - 2.0/31) + 2.0/31, 2) AS sc FROM er), k AS (SELECT symbol, t, rn, close AS y FROM n WHERE rn = 1 UNION ALL SELECT n.symbol, n.t, n.rn, CASE WHEN n.rn <= 10 THEN n.close ELSE k.y + coalesce(n.sc, 0) * (n.close - k.y) END FROM k JOIN n ON n.symbol = k.symbol AND n.rn = k.rn + 1)", "symbol t", "kama", "SELECT symbol, t, y AS kama FROM k"))
def kama_line(spark, sf):
    return ind.kama(bars(spark, sf)).select("symbol", "ts", "kama")


@query("awesome_oscillator", out(BARS, "symbol t", "ao", f"SELECT symbol, t, CASE WHEN count(*) OVER b = 34 THEN avg((high + low) / 2) OVER a - avg((high + low) / 2) OVER b END AS ao FROM bars WINDOW a AS {_frame(5)}, b AS {_frame(34)}"))
def awesome_oscillator(spark, sf):
    return ind.awesome(bars(spark, sf)).select("symbol", "ts", "ao")


@query("rolling_vwap", out(BARS, "symbol t", "vwap vwap_up vwap_low", f"SELECT symbol, t, vwap, vwap + 2 * sd AS vwap_up, vwap - 2 * sd AS vwap_low FROM (SELECT symbol, t, vwap, CASE WHEN count(close - vwap) OVER w >= 2 THEN stddev_samp(close - vwap) OVER w END AS sd FROM (SELECT *, CASE WHEN count(*) OVER w = 24 THEN sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0) END AS vwap FROM bars WINDOW w AS {_frame(24)}) WINDOW w AS {_frame(24)})"))
def rolling_vwap(spark, sf):
    return ind.vwap_bands(bars(spark, sf), 24, 2.0).select("symbol", "ts", "vwap", "vwap_up", "vwap_low")


@query("camarilla_fib", out(BARS, "symbol t", "cam_r4 cam_s4 fib_382 fib_618", f"SELECT symbol, t, CASE WHEN count(*) OVER p = 24 THEN lag(close) OVER o + (max(high) OVER p - min(low) OVER p) * 0.55 END AS cam_r4, CASE WHEN count(*) OVER p = 24 THEN lag(close) OVER o - (max(high) OVER p - min(low) OVER p) * 0.55 END AS cam_s4, CASE WHEN count(*) OVER k = 24 THEN min(low) OVER k + 0.382 * (max(high) OVER k - min(low) OVER k) END AS fib_382, CASE WHEN count(*) OVER k = 24 THEN min(low) OVER k + 0.618 * (max(high) OVER k - min(low) OVER k) END AS fib_618 FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY t), p AS (PARTITION BY symbol ORDER BY t ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING), k AS {_frame(24)}"))
def camarilla_fib(spark, sf):
    return ind.fib_channel(ind.camarilla(bars(spark, sf), 24), 24).select("symbol", "ts", "cam_r4", "cam_s4", "fib_382", "fib_618")


@query("trend_regime", out(RETS + ", " + ewm_sql("bars", "close", "(2.0/51)", "f") + ", " + ewm_sql("bars", "close", "(2.0/201)", "s") + f", v AS (SELECT symbol, t, CASE WHEN count(r) OVER w >= 30 THEN stddev_samp(r) OVER w END AS vol FROM rets WINDOW w AS {_frame(30)}), q AS (SELECT symbol, t, vol, CASE WHEN count(vol) OVER w >= 50 THEN quantile_cont(vol, 0.5) OVER w END AS med FROM v WINDOW w AS {_frame(250)})", "symbol t regime_class", "trend", "SELECT q.symbol, q.t, f.y / nullif(s.y, 0) - 1 AS trend, CASE WHEN med IS NOT NULL THEN (vol > med)::INT * 2 + (f.y / nullif(s.y, 0) - 1 > 0)::INT END AS regime_class FROM q JOIN f USING (symbol, t) JOIN s USING (symbol, t)"))
def trend_regime(spark, sf):
    return ind.trend_regime(bars(spark, sf)).select("symbol", "ts", "trend", "regime_class")


@query("shock_bars", out(RETS, "symbol t", "shock", f"SELECT symbol, t, CASE WHEN abs(rz) >= 2 AND vz >= 1 THEN sign(rz) ELSE 0 END::DOUBLE AS shock FROM (SELECT symbol, t, CASE WHEN count(r) OVER w >= 30 THEN (r - avg(r) OVER w) / nullif(stddev_samp(r) OVER w, 0) END AS rz, CASE WHEN count(volume) OVER w >= 30 THEN (volume - avg(volume) OVER w) / nullif(stddev_samp(volume) OVER w, 0) END AS vz FROM rets WINDOW w AS {_frame(30)})"))
def shock_bars(spark, sf):
    return ind.shock(bars(spark, sf), 30, 2.0).select("symbol", "ts", "shock")


@query("surge_climax", "WITH " + BARS + f" SELECT symbol, t, coalesce(close / nullif(lag(close, 3) OVER o, 0) - 1 >= 0.5 AND CASE WHEN count(volume) OVER k >= 48 THEN volume >= quantile_cont(volume, 0.8) OVER k END, false) AS surge, coalesce(CASE WHEN count(volume) OVER v >= 20 THEN volume > 2 * avg(volume) OVER v END AND abs(close - open) / nullif(high - low, 0) < 0.5, false) AS climax FROM bars WINDOW o AS (PARTITION BY symbol ORDER BY t), k AS {_frame(48)}, v AS {_frame(20)}")
def surge_climax(spark, sf):
    return ind.climax(ind.surge(bars(spark, sf), 3, 0.5, 0.8, 48)).select("symbol", "ts", "surge", "climax")


@query("fractional_difference", out(BARS, "symbol t", "ffd", "SELECT symbol, t, " + "ln(close) - 0.4 * lag(ln(close)) OVER w - 0.12 * lag(ln(close), 2) OVER w - 0.064 * lag(ln(close), 3) OVER w - 0.0416 * lag(ln(close), 4) OVER w AS ffd FROM bars " + W))
def fractional_difference(spark, sf):
    return ind.fractional_difference(bars(spark, sf), 0.4, 5).select("symbol", "ts", "ffd")


@query("flat_regime_gate", FLAT_SQL)
def flat_regime_gate(spark, sf):
    return ind.flat_gate(bars(spark, sf)).select("symbol", "ts", "flat")


@query("width_rank", out(BARS + f", b AS (SELECT symbol, t, 4 * CASE WHEN count(close) OVER w >= 20 THEN stddev_samp(close) OVER w END / nullif(avg(close) OVER w, 0) AS bw FROM bars WINDOW w AS {_frame(20)})", "symbol t", "width_rank", f"SELECT symbol, t, CASE WHEN len(xs) >= 100 THEN (len(list_filter(xs, lambda v: v < bw)) + (len(list_filter(xs, lambda v: v = bw)) + 1) / 2.0) / len(xs) END AS width_rank FROM (SELECT symbol, t, bw, list(bw) FILTER (bw IS NOT NULL) OVER {_frame(100)} AS xs FROM b)"))
def width_rank(spark, sf):
    return ind.width_rank(bars(spark, sf), 100).select("symbol", "ts", "width_rank")


_LONG_WINDOW = 240


@query("rolling_quantiles_long", out(
    BARS, "symbol t", "q10 med",
    f"SELECT symbol, t, CASE WHEN count(close) OVER w >= 24 THEN quantile_cont(close, 0.1) OVER w END AS q10, CASE WHEN count(close) OVER w >= 24 THEN quantile_cont(close, 0.5) OVER w END AS med FROM bars WINDOW w AS {_frame(_LONG_WINDOW)}",
))
def rolling_quantiles_long(spark, sf):
    """Quantiles over ten days of hours, a row at the cost of the window's logarithm."""
    d = order_stats.rolling_order(bars(spark, sf), "close", _LONG_WINDOW, key=KEY, quantiles={"q10": 0.1, "med": 0.5}, least=24, block_rows=300)
    return d.select("symbol", "ts", "q10", "med")


@query("rolling_rank_long", out(
    BARS, "symbol t", "rank_pct",
    "SELECT symbol, t, CASE WHEN len(xs) >= 24 THEN (len(list_filter(xs, lambda v: v < close)) + (len(list_filter(xs, lambda v: v = close)) + 1) / 2.0) / len(xs) END AS rank_pct "
    f"FROM (SELECT symbol, t, close, list(close) OVER {_frame(_LONG_WINDOW)} AS xs FROM bars)",
))
def rolling_rank_long(spark, sf):
    return order_stats.rolling_order(bars(spark, sf), "close", _LONG_WINDOW, key=KEY, rank="rank_pct", least=24, block_rows=300).select("symbol", "ts", "rank_pct")
