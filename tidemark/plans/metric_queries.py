"""Queries: performance, risk, distribution and portfolio statistics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import folds, inference, metrics, orderflow, returns, rolling, sweep
from tidemark.operators.grid import ordered
from tidemark.plans.base import BARS, HOUR_PPY, KEY, RETS, TICKS, TRADES, W, bars, out, query, rounded, table, ticks, trades, with_returns

SHARPE = "CASE WHEN count(r) < 2 OR coalesce(stddev_samp(r), 0) = 0 THEN 0 ELSE avg(r) / stddev_samp(r) * sqrt(8760) END"
EQ = RETS + ", eq AS (SELECT symbol, t, exp(sum(coalesce(r, 0) / 10) OVER w) AS equity FROM rets " + W + ")"
DD = EQ + ", dd AS (SELECT *, equity / max(equity) OVER w - 1 AS dd FROM eq " + W + ")"


def equity(spark, sf):
    """Growth of a tenth of the log return, so that it stays within range."""
    b = with_returns(spark, sf)
    w = ordered(KEY).rowsBetween(Window.unboundedPreceding, 0)
    return b.withColumn("equity", F.exp(F.sum(F.coalesce(F.col("r") / 10, F.lit(0.0))).over(w)))


@query("risk_summary", out(RETS, "symbol n", "mean std sharpe sortino hit_rate profit_factor avg_win avg_loss skew kurtosis", f"SELECT symbol, count(r) AS n, avg(r) AS mean, stddev_samp(r) AS std, {SHARPE} AS sharpe, avg(r) / stddev_samp(r) FILTER (r < 0) * sqrt(8760) AS sortino, avg((r > 0)::INT) FILTER (r <> 0) AS hit_rate, sum(r) FILTER (r > 0) / -sum(r) FILTER (r < 0) AS profit_factor, avg(r) FILTER (r > 0) AS avg_win, avg(r) FILTER (r < 0) AS avg_loss, skewness(r) AS skew, kurtosis(r) AS kurtosis FROM rets GROUP BY 1"))
def risk_summary(spark, sf):
    return metrics.risk_summary(with_returns(spark, sf), "r", HOUR_PPY, key=KEY)


@query("drawdown_summary", out(DD, "symbol", "max_drawdown ulcer_index growth years cagr calmar", "SELECT *, pow(growth, 1 / years) - 1 AS cagr, (pow(growth, 1 / years) - 1) / max_drawdown AS calmar FROM (SELECT symbol, -min(dd) AS max_drawdown, sqrt(avg(dd * dd)) AS ulcer_index, last(equity ORDER BY t) / first(equity ORDER BY t) AS growth, (max(t) - min(t)) / 31557600.0 AS years FROM dd GROUP BY 1)", 4))
def drawdown_summary(spark, sf):
    d = metrics.drawdown_summary(equity(spark, sf), "equity", key=KEY)
    return d.select("symbol", *[rounded(c, 4).alias(c) for c in ("max_drawdown", "ulcer_index", "growth", "years", "cagr", "calmar")])


@query("drawdown_episodes", "WITH " + DD + ", f AS (SELECT *, CASE WHEN lag(dd < 0) OVER w = (dd < 0) THEN 0 ELSE 1 END AS ch FROM dd " + W + "), g AS (SELECT *, sum(ch) OVER w AS run FROM f " + W + "), e AS (SELECT symbol, min(t) AS start, max(t) AS \"end\", min(dd) AS depth, count(*) AS bars FROM g WHERE dd < 0 GROUP BY symbol, run) SELECT symbol, start, \"end\", round(depth, 6) AS depth, bars, row_number() OVER (PARTITION BY symbol ORDER BY depth, start) AS rank FROM e QUALIFY rank <= 5")
def drawdown_episodes(spark, sf):
    return metrics.drawdown_episodes(equity(spark, sf), "equity", 5, key=KEY)


@query("longest_underwater", "WITH " + DD + ", f AS (SELECT *, CASE WHEN lag(dd < 0) OVER w = (dd < 0) THEN 0 ELSE 1 END AS ch FROM dd " + W + "), g AS (SELECT *, sum(ch) OVER w AS run FROM f " + W + ") SELECT symbol, max(n) AS longest FROM (SELECT symbol, count(*) AS n FROM g WHERE dd < 0 GROUP BY symbol, run) GROUP BY 1")
def longest_underwater(spark, sf):
    d = metrics.drawdown(equity(spark, sf), "equity", key=KEY)
    return metrics.longest_run(d, F.col("dd") < 0, key=KEY)


DAILY = RETS + ", day AS (SELECT g.symbol, g.t, coalesce(d.ret, 0) AS ret FROM (SELECT symbol, unnest(range(min(t) // 86400 * 86400, max(t) + 1, 86400)) AS t FROM rets GROUP BY 1) g LEFT JOIN (SELECT symbol, t // 86400 * 86400 AS t, product(1 + coalesce(r, 0) / 10) - 1 AS ret FROM rets GROUP BY 1, 2) d ON g.symbol = d.symbol AND g.t = d.t)"


def daily(spark, sf):
    return metrics.daily_returns(with_returns(spark, sf).withColumn("r10", F.col("r") / 10), "r10", key=KEY)


@query("tail_risk_daily", out(DAILY + ", v AS (SELECT symbol, quantile_cont(ret, 0.05) AS var, count(ret) AS n FROM day GROUP BY 1)", "symbol n", "var cvar", "SELECT v.symbol, v.n, v.var, avg(ret) AS cvar FROM day JOIN v USING (symbol) WHERE ret <= var GROUP BY 1, 2, 3"))
def tail_risk_daily(spark, sf):
    return metrics.tail_risk(daily(spark, sf), "ret", 0.95, key=KEY)


@query("tail_ratio", out(RETS + ", q AS (SELECT symbol, quantile_cont(r, 0.1) AS a, quantile_cont(r, 0.9) AS b FROM rets GROUP BY 1)", "symbol n", "up down tail_ratio", "SELECT symbol, count(r) AS n, avg(r) FILTER (r >= b) AS up, avg(r) FILTER (r <= a) AS down, avg(r) FILTER (r >= b) / abs(avg(r) FILTER (r <= a)) AS tail_ratio FROM rets JOIN q USING (symbol) GROUP BY symbol"))
def tail_ratio(spark, sf):
    return metrics.tail_ratio(with_returns(spark, sf), "r", key=KEY)


@query("information_ratio", out(RETS, "symbol n", "ir", "SELECT a.symbol, count(a.r - b.r) AS n, avg(a.r - b.r) / stddev_samp(a.r - b.r) * sqrt(8760) AS ir FROM rets a JOIN rets b ON a.t = b.t AND b.symbol = 'click' WHERE a.symbol <> 'click' GROUP BY 1"))
def information_ratio(spark, sf):
    r = with_returns(spark, sf)
    bench = r.where("symbol = 'click'").select("ts", F.col("r").alias("b"))
    d = r.where("symbol <> 'click'").join(bench, "ts").withColumn("d", F.col("r") - F.col("b"))
    return d.groupBy("symbol").agg(F.count("d").alias("n"), metrics.sharpe(F.col("d"), HOUR_PPY).alias("ir"))


@query("benchmark_beta", out(RETS, "symbol", "beta alpha corr", "SELECT a.symbol, regr_slope(a.r, b.r) AS beta, regr_intercept(a.r, b.r) AS alpha, corr(a.r, b.r) AS corr FROM rets a JOIN rets b ON a.t = b.t AND b.symbol = 'click' WHERE a.symbol <> 'click' GROUP BY 1"))
def benchmark_beta(spark, sf):
    r = with_returns(spark, sf)
    bench = r.where("symbol = 'click'").select("ts", F.col("r").alias("b"))
    return r.where("symbol <> 'click'").join(bench, "ts").groupBy("symbol").agg(F.regr_slope("r", "b").alias("beta"), F.regr_intercept("r", "b").alias("alpha"), F.corr("r", "b").alias("corr"))


@query("pnl_concentration", out(TRADES, "symbol", "top1_pct top5_pct", "SELECT symbol, sum(pnl) FILTER (rk <= 1 AND pnl > 0) / abs(sum(pnl)) * 100 AS top1_pct, sum(pnl) FILTER (rk <= 5 AND pnl > 0) / abs(sum(pnl)) * 100 AS top5_pct FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY pnl DESC, trade_id) AS rk FROM trades) GROUP BY 1"))
def pnl_concentration(spark, sf):
    return metrics.concentration(trades(spark, sf), "pnl", key=KEY, tie="trade_id")


@query("trade_shape", out(TRADES, "symbol n", "pnl win_pct payoff median_win median_loss largest_share expectancy profit_factor", "SELECT symbol, count(pnl) AS n, sum(pnl) AS pnl, avg((pnl > 0)::INT) * 100 AS win_pct, avg(pnl) FILTER (pnl > 0) / abs(avg(pnl) FILTER (pnl < 0)) AS payoff, quantile_cont(pnl, 0.5) FILTER (pnl > 0) AS median_win, quantile_cont(pnl, 0.5) FILTER (pnl < 0) AS median_loss, max(abs(pnl)) / sum(abs(pnl)) AS largest_share, avg(pnl) AS expectancy, sum(pnl) FILTER (pnl > 0) / -sum(pnl) FILTER (pnl < 0) AS profit_factor FROM trades GROUP BY 1", 4))
def trade_shape(spark, sf):
    d = metrics.trade_shape(trades(spark, sf), "pnl", key=KEY)
    return d.select("symbol", "n", *[rounded(c, 4).alias(c) for c in d.columns[2:]])


@query("trade_duration", out(TRADES, "symbol", "mean median", "SELECT symbol, avg(hours) AS mean, quantile_cont(hours, 0.5) AS median FROM trades GROUP BY 1"))
def trade_duration(spark, sf):
    return trades(spark, sf).groupBy("symbol").agg(F.avg("hours").alias("mean"), F.percentile("hours", F.lit(0.5)).alias("median"))


@query("slice_table", "SELECT l_returnflag AS flag, l_linestatus AS status, count(*) AS n, round(sum(round(l_extendedprice * (l_discount - 0.05), 4)), 2) AS pnl FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), (l_returnflag, l_linestatus), ())")
def slice_table(spark, sf):
    """Several key sets in one pass."""
    li = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"), rounded(F.col("l_extendedprice") * (F.col("l_discount") - 0.05), 4).alias("pnl"))
    return li.groupingSets([[F.col("flag")], [F.col("status")], [F.col("flag"), F.col("status")], []], "flag", "status").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("pnl"), 2).alias("pnl"))


@query("describe_by_window", out(RETS, "w n", "mean median win std q10 q90 ratio sum", "SELECT CASE WHEN t < epoch(TIMESTAMP '2024-01-10') THEN 'TRAIN' WHEN t < epoch(TIMESTAMP '2024-01-20') THEN 'VALID' WHEN t < epoch(TIMESTAMP '2024-01-28') THEN 'TEST' ELSE 'OUT' END AS w, count(r) AS n, avg(r) AS mean, quantile_cont(r, 0.5) AS median, avg((r > 0)::INT) FILTER (r IS NOT NULL) AS win, stddev_samp(r) AS std, quantile_cont(r, 0.1) AS q10, quantile_cont(r, 0.9) AS q90, avg(r) / stddev_samp(r) AS ratio, sum(r) AS sum FROM rets GROUP BY 1"))
def describe_by_window(spark, sf):
    r = with_returns(spark, sf).withColumn("w", folds.label_windows(F.col("ts"), "2024-01-10", "2024-01-20", "2024-01-28"))
    return metrics.describe(r, "r", key=["w"])


@query("signal_against_baseline", out(RETS, "n_signal n_base", "delta welch_t", "SELECT count(r) FILTER (volume >= 30) AS n_signal, count(r) FILTER (volume < 30) AS n_base, avg(r) FILTER (volume >= 30) - avg(r) FILTER (volume < 30) AS delta, (avg(r) FILTER (volume >= 30) - avg(r) FILTER (volume < 30)) / sqrt(var_samp(r) FILTER (volume >= 30) / count(r) FILTER (volume >= 30) + var_samp(r) FILTER (volume < 30) / count(r) FILTER (volume < 30)) AS welch_t FROM rets"))
def signal_against_baseline(spark, sf):
    return metrics.against_baseline(with_returns(spark, sf), "r", F.col("volume") >= 30)


@query("monthly_table", out("o AS (SELECT o_orderstatus AS symbol, year(o_orderdate) AS year, month(o_orderdate) AS m, (o_totalprice - 150000) / 1e8 AS r FROM orders), g AS (SELECT symbol, year, m, product(1 + r) - 1 AS ret FROM o GROUP BY 1, 2, 3)", "symbol year", " ".join(f"m{i}" for i in range(1, 13)), "SELECT symbol, year, " + ", ".join(f"max(ret) FILTER (m = {i}) AS m{i}" for i in range(1, 13)) + " FROM g GROUP BY 1, 2"))
def monthly_table(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderstatus").alias("symbol"), F.col("o_orderdate").cast("timestamp").alias("ts"), ((F.col("o_totalprice") - 150000) / 1e8).alias("r"))
    return metrics.month_table(metrics.monthly_returns(o, "r", key=KEY), key=KEY)


@query("positive_months", out("o AS (SELECT o_orderstatus AS symbol, date_trunc('month', o_orderdate) AS m, sum(o_totalprice - 150000) AS v FROM orders GROUP BY 1, 2)", "symbol months", "pct", "SELECT symbol, count(*) AS months, avg((v > p)::INT) * 100 AS pct FROM (SELECT *, lag(v) OVER (PARTITION BY symbol ORDER BY m) AS p FROM o) WHERE p IS NOT NULL GROUP BY 1"))
def positive_months(spark, sf):
    """Share of months above the month before; the first has none."""
    o = table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("symbol"), F.date_trunc("month", "o_orderdate").alias("m")).agg(F.sum(F.col("o_totalprice") - 150000).alias("v"))
    o = o.withColumn("p", F.lag("v").over(Window.partitionBy("symbol").orderBy("m"))).where("p IS NOT NULL")
    return o.groupBy("symbol").agg(F.count(F.lit(1)).alias("months"), (F.avg((F.col("v") > F.col("p")).cast("double")) * 100).alias("pct"))


@query("price_histogram", "WITH " + TICKS + ", h AS (SELECT symbol, least(floor(price / (100 / 30.0)), 29)::INT AS bin, count(*) AS n FROM ticks WHERE price BETWEEN 0 AND 100 GROUP BY 1, 2) SELECT s.symbol, b.bin::INT AS bin, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT symbol FROM ticks) s CROSS JOIN range(30) b(bin) LEFT JOIN h ON h.symbol = s.symbol AND h.bin = b.bin")
def price_histogram(spark, sf):
    return metrics.histogram(ticks(spark, sf), "price", 0.0, 100.0, 30, key=KEY)


@query("return_correlations", out(RETS, "a b n", "corr", "SELECT x.symbol AS a, y.symbol AS b, count(*) AS n, corr(x.r, y.r) AS corr FROM rets x JOIN rets y ON x.t = y.t AND x.symbol < y.symbol GROUP BY 1, 2"))
def return_correlations(spark, sf):
    return metrics.correlation_table(with_returns(spark, sf), "r")


@query("autocorrelations", out(RETS, "symbol lag", "corr", "SELECT symbol, k AS lag, corr(r, p) AS corr FROM (" + " UNION ALL ".join(f"SELECT symbol, {k} AS k, r, lag(r, {k}) OVER w AS p FROM rets {W}" for k in range(1, 7)) + ") GROUP BY 1, 2"))
def autocorrelations(spark, sf):
    return metrics.autocorrelation(with_returns(spark, sf), "r", list(range(1, 7)), key=KEY)


@query("variance_ratio", out(RETS + ", x AS (SELECT symbol, t, r, avg(r) OVER (PARTITION BY symbol) AS mu, sum(r) OVER k AS s, count(r) OVER k AS n FROM rets WHERE r IS NOT NULL WINDOW k AS (PARTITION BY symbol ORDER BY t ROWS 3 PRECEDING))", "symbol", "variance_ratio", "SELECT symbol, avg(pow(s - 4 * mu, 2)) FILTER (n = 4) / (4 * var_pop(r)) AS variance_ratio FROM x GROUP BY 1"))
def variance_ratio(spark, sf):
    return metrics.variance_ratio(with_returns(spark, sf), "r", 4, key=KEY)


@query("regime_table", out(RETS + ", v AS (SELECT symbol, t, r, stddev_samp(r) OVER k AS vol, avg(r) OVER k AS trend, count(r) OVER k AS n FROM rets WINDOW k AS (PARTITION BY symbol ORDER BY t ROWS 23 PRECEDING)), f AS (SELECT * FROM v WHERE n >= 24), e AS (SELECT symbol, quantile_cont(vol, 0.25) a, quantile_cont(vol, 0.5) b, quantile_cont(vol, 0.75) c, quantile_cont(trend, 1/3.0) d, quantile_cont(trend, 2/3.0) g FROM f GROUP BY 1), q AS (SELECT f.symbol, r, (vol > a)::INT + (vol > b)::INT + (vol > c)::INT AS vol_q, (trend > d)::INT + (trend > g)::INT AS trend_q FROM f JOIN e USING (symbol))", "symbol vol_q trend_q n", "sharpe mean_bps hit_pct", f"SELECT symbol, vol_q, trend_q, count(r) AS n, CASE WHEN count(r) >= 5 THEN {SHARPE} END AS sharpe, CASE WHEN count(r) >= 5 THEN avg(r) * 1e4 END AS mean_bps, CASE WHEN count(r) >= 5 THEN avg((r > 0)::INT) FILTER (r IS NOT NULL) * 100 END AS hit_pct FROM q GROUP BY 1, 2, 3", 4))
def regime_table(spark, sf):
    d = metrics.regime_table(with_returns(spark, sf), "r", 24, HOUR_PPY, key=KEY)
    return d.select("symbol", "vol_q", "trend_q", "n", *[rounded(c, 4).alias(c) for c in ("sharpe", "mean_bps", "hit_pct")])


@query("sweep_report", "WITH c AS (SELECT c_nationkey AS nation, o_orderpriority AS prio, avg(o_totalprice) - 150000 AS m FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2) SELECT nation, prio, count(m) AS n, round(avg((m > 0)::INT), 6) AS breadth, round(quantile_cont(m, 0.5), 4) AS median, round(quantile_cont(m, 0.75) - quantile_cont(m, 0.25), 4) AS iqr FROM c GROUP BY GROUPING SETS ((nation), (prio), ())")
def sweep_report(spark, sf):
    j = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    c = j.groupBy(F.col("c_nationkey").alias("nation"), F.col("o_orderpriority").alias("prio")).agg((F.avg("o_totalprice") - 150000).alias("m"))
    d = metrics.sweep_report(c, "m", ["nation", "prio"])
    return d.select("nation", "prio", "n", "breadth", rounded("median", 4).alias("median"), rounded("iqr", 4).alias("iqr"))


@query("fold_walk_forward", out(RETS + f", c AS (SELECT symbol, t // 432000 AS fold, {SHARPE} AS sharpe, product(1 + r / 10) - 1 AS ret FROM rets GROUP BY 1, 2)", "symbol folds", "mean std median worst stitched", "SELECT symbol, count(*) AS folds, avg(sharpe) AS mean, stddev_samp(sharpe) AS std, quantile_cont(sharpe, 0.5) AS median, min(sharpe) AS worst, product(1 + ret) - 1 AS stitched FROM c GROUP BY 1", 4))
def fold_walk_forward(spark, sf):
    r = with_returns(spark, sf).withColumn("fold", F.floor(F.unix_timestamp("ts") / 432000))
    c = r.groupBy("symbol", "fold").agg(metrics.sharpe(F.col("r"), HOUR_PPY).alias("sharpe"), (F.product(1 + F.col("r") / 10) - 1).alias("ret"))
    d = metrics.walk_forward_summary(c, "sharpe", "ret", key=KEY)
    return d.select("symbol", "folds", *[rounded(c, 4).alias(c) for c in ("mean", "std", "median", "worst", "stitched")])


@query("adjusted_p_values", out("p AS (SELECT c_custkey AS id, (abs(c_acctbal) + 1) / 123457.0 AS p, c_nationkey AS nation FROM customer), r AS (SELECT *, count(*) OVER (PARTITION BY nation) AS m, row_number() OVER (PARTITION BY nation ORDER BY p) AS i FROM p)", "id", "p p_bonferroni p_holm p_bhy", "SELECT id, p, least(1.0, m * p) AS p_bonferroni, least(1.0, max((m - i + 1) * p) OVER (PARTITION BY nation ORDER BY p ROWS UNBOUNDED PRECEDING)) AS p_holm, least(1.0, min(m * c / i * p) OVER (PARTITION BY nation ORDER BY p ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_bhy FROM (SELECT r.*, list_sum(list_transform(range(1, m + 1), lambda k: 1.0::DOUBLE / k)) AS c FROM r)"))
def adjusted_p_values(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), ((F.abs("c_acctbal") + 1) / 123457.0).alias("p"), F.col("c_nationkey").alias("nation"))
    return inference.haircut(c, "p", key=["nation"]).select("id", "p", "p_bonferroni", "p_holm", "p_bhy")


_OVERFIT = f"""c AS (SELECT symbol || '-' || (t // 3600 % 24) AS trial, {{train}} AS train, {{test}} AS test FROM (SELECT *, CASE WHEN t < epoch(TIMESTAMP '2024-01-20') THEN r END AS a, CASE WHEN t >= epoch(TIMESTAMP '2024-01-20') THEN r END AS b FROM rets) GROUP BY 1),
 k AS (SELECT *, row_number() OVER (ORDER BY train, trial) AS rt, row_number() OVER (ORDER BY test, trial) AS ro FROM c), h AS (SELECT quantile_cont(train, 0.5) AS mt, quantile_cont(test, 0.5) AS mo, count(*) AS n FROM k),
 bt AS (SELECT test AS best FROM k ORDER BY train DESC, trial LIMIT 1),
 o AS (SELECT max(n) AS n, (count(*) FILTER (test < best) + 0.5) / count(*) AS share, corr(rt, ro) AS spearman, regr_slope(test, train) AS slope, regr_intercept(test, train) AS intercept,
  avg(CASE WHEN train >= mt THEN (test < mo)::INT END) * 100 AS top_below_median_pct, max(train) - max(best) AS best_gap, max(best) - max(mo) AS best_over_median, max(test) - max(mo) AS selection_inflation FROM k CROSS JOIN h CROSS JOIN bt)""".format(
    train=SHARPE.replace("(r)", "(a)"), test=SHARPE.replace("(r)", "(b)")
)


@query("overfit_statistics", out(RETS + ", " + _OVERFIT, "n", "spearman slope intercept top_below_median_pct logit best_gap best_over_median selection_inflation", "SELECT *, -ln(share / (1 - share)) AS logit FROM o", 4))
def overfit_statistics(spark, sf):
    r = with_returns(spark, sf).withColumn("trial", F.concat_ws("-", "symbol", F.hour("ts").cast("string")))
    c = r.groupBy("trial").agg(metrics.sharpe(F.when(F.col("ts") < F.lit("2024-01-20").cast("timestamp"), F.col("r")), HOUR_PPY).alias("train"), metrics.sharpe(F.when(F.col("ts") >= F.lit("2024-01-20").cast("timestamp"), F.col("r")), HOUR_PPY).alias("test"))
    d = folds.overfit_statistics(c, train="train", test="test", trial="trial")
    return d.select("n", *[rounded(c, 4).alias(c) for c in d.columns if c != "n"])


def phi(z: str) -> str:
    """Standard normal distribution function, by Simpson's rule."""
    return f"(0.5 + ({z}) / 1200 / sqrt(2 * pi()) * list_sum(list_transform(range(0, 401), lambda i: (CASE WHEN i IN (0, 400) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5 * pow(i * ({z}) / 400.0, 2)))))"


@query("probabilistic_sharpe", out(RETS + ", mo AS (SELECT symbol, count(r) AS n, avg(r) / nullif(stddev_samp(r), 0) AS sr, skewness(r) AS skew, kurtosis(r) AS kurt FROM rets GROUP BY 1), z AS (SELECT symbol, n, sr, sr * sqrt(n - 1) / sqrt(greatest(1e-12, 1 - skew * sr + (kurt + 2) / 4 * pow(sr, 2))) AS z FROM mo)", "symbol n", "sr z psr", f"SELECT *, {phi('z')} AS psr FROM z"))
def probabilistic_sharpe(spark, sf):
    return inference.probabilistic_sharpe(with_returns(spark, sf), "r", key=KEY)


def _h(kind: str, *cols: str) -> str:
    return f"('0x' || substr(md5(concat_ws(':', '{kind}', 1, {', '.join(cols)})), 1, 8))::BIGINT"


def draws_sql(keys: list[str], replicates: int, source: str, permute: bool = False) -> str:
    """CTEs up to pk (keys, rep, p, at_) over ``source`` (keys, p, n)."""
    k = "".join(f"{x}, " for x in keys)
    dr = f"dr AS (SELECT {k}n, p, k AS rep FROM {source} CROSS JOIN range({replicates}) r(k))"
    if permute:
        return dr + f", pk AS (SELECT {k}rep, p, row_number() OVER (PARTITION BY {k}rep ORDER BY {_h('p', *keys, 'rep', 'p')}, p) - 1 AS at_ FROM dr)"
    return (
        dr + f", st AS (SELECT *, p = 0 OR {_h('b', *keys, 'rep', 'p')} / 4294967296.0::DOUBLE < 1 / greatest(1.0, pow(n, {1 / 3!r}::DOUBLE)) AS fresh, {_h('s', *keys, 'rep', 'p')} % n AS s FROM dr), "
        f"bl AS (SELECT *, last_value(CASE WHEN fresh THEN p END IGNORE NULLS) OVER w AS bp, last_value(CASE WHEN fresh THEN s END IGNORE NULLS) OVER w AS bs FROM st WINDOW w AS (PARTITION BY {k}rep ORDER BY p)), pk AS (SELECT {k}rep, p, (bs + p - bp) % n AS at_ FROM bl)"
    )


def replicates_sql(x: str, replicates: int, permute: bool = False) -> str:
    """CTEs up to rp (symbol, rep, sharpe, sortino, total_return, max_drawdown) over DAILY."""
    return (
        DAILY + f", nb AS (SELECT symbol, {x} AS x, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS p, count(*) OVER (PARTITION BY symbol) AS n FROM day), " + draws_sql(["symbol"], replicates, "nb", permute)
        + ", dn AS (SELECT pk.*, nb.x FROM pk JOIN nb ON nb.symbol = pk.symbol AND nb.p = at_), pe AS (SELECT *, product(1 + x) OVER (PARTITION BY symbol, rep ORDER BY p ROWS UNBOUNDED PRECEDING) AS e FROM dn), "
        "pd AS (SELECT *, 1 - e / greatest(1.0, max(e) OVER (PARTITION BY symbol, rep ORDER BY p)) AS dd FROM pe), "
        "rp AS (SELECT symbol, rep, CASE WHEN stddev_samp(x) > 0 THEN avg(x) / stddev_samp(x) * sqrt(365) ELSE 0 END AS sharpe, CASE WHEN stddev_samp(x) FILTER (x < 0) > 0 THEN avg(x) / (stddev_samp(x) FILTER (x < 0)) * sqrt(365) END AS sortino, product(1 + x) - 1 AS total_return, max(dd) AS max_drawdown FROM pd GROUP BY 1, 2)"
    )


@query("bootstrap_interval", out(replicates_sql("ret", 500), "symbol n", "lo median hi", "SELECT symbol, quantile_cont(sharpe, 0.025) AS lo, quantile_cont(sharpe, 0.5) AS median, quantile_cont(sharpe, 0.975) AS hi, count(sharpe) AS n FROM rp GROUP BY 1", 4))
def bootstrap_interval(spark, sf):
    """Interval of every symbol's daily Sharpe ratio under the stationary bootstrap."""
    d = inference.interval(inference.bootstrap_by_key(daily(spark, sf), "ret", ["ts"], 500, 365.0, key=KEY), "sharpe", key=KEY)
    return d.select("symbol", "n", *[rounded(c, 4).alias(c) for c in ("lo", "median", "hi")])


@query("bootstrap_null", out(replicates_sql("ret - avg(ret) OVER (PARTITION BY symbol)", 300) + ", ob AS (SELECT symbol, CASE WHEN stddev_samp(ret) > 0 THEN avg(ret) / stddev_samp(ret) * sqrt(365) ELSE 0 END AS o FROM day GROUP BY 1)", "symbol", "observed p", "SELECT rp.symbol, max(o) AS observed, (count(*) FILTER (sharpe >= o) + 1) / (count(*) + 1) AS p FROM rp JOIN ob USING (symbol) GROUP BY 1", 4))
def bootstrap_null(spark, sf):
    """p-value of every symbol's daily Sharpe ratio against resamples without a mean."""
    d = daily(spark, sf)
    drawn = inference.bootstrap_by_key(d, "ret", ["ts"], 300, 365.0, key=KEY, centre=True)
    sd = F.stddev_samp("ret")
    seen = d.groupBy("symbol").agg(F.when(sd > 0, F.avg("ret") / sd * F.sqrt(F.lit(365.0))).otherwise(0.0).alias("sharpe"))
    got = inference.null_p_value(drawn, "sharpe", seen, key=KEY)
    return got.select("symbol", rounded("observed", 4).alias("observed"), rounded("p", 4).alias("p"))


@query("permutation_null", out(replicates_sql("ret", 200, True), "symbol n", "return_from return_to drawdown_lo drawdown_median drawdown_hi", "SELECT symbol, count(*) AS n, min(total_return) AS return_from, max(total_return) AS return_to, quantile_cont(max_drawdown, 0.05) AS drawdown_lo, quantile_cont(max_drawdown, 0.5) AS drawdown_median, quantile_cont(max_drawdown, 0.95) AS drawdown_hi FROM rp GROUP BY 1", 5))
def permutation_null(spark, sf):
    """Drawdowns of shuffled days; the total return cannot move."""
    g = inference.bootstrap_by_key(daily(spark, sf), "ret", ["ts"], 200, 365.0, key=KEY, permute=True).groupBy("symbol")
    q = lambda p: rounded(F.percentile("max_drawdown", F.lit(p)), 5)
    return g.agg(F.count(F.lit(1)).alias("n"), rounded(F.min("total_return"), 5).alias("return_from"), rounded(F.max("total_return"), 5).alias("return_to"), q(0.05).alias("drawdown_lo"), q(0.5).alias("drawdown_median"), q(0.95).alias("drawdown_hi"))


_P = "(count(*) FILTER ({hit}) + 1) / (count(*) + 1)"
_REALITY = (
    DAILY + ", xx AS (SELECT symbol AS strategy, t, ret AS x FROM day), nb AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS p, count(*) OVER () AS n FROM (SELECT t FROM xx GROUP BY t HAVING count(*) = (SELECT count(DISTINCT strategy) FROM xx))), "
    + draws_sql([], 300, "nb") + ", rw AS (SELECT xx.*, nb.p FROM xx JOIN nb USING (t)), mn AS (SELECT strategy, avg(x) AS mean, count(*) AS n FROM rw GROUP BY 1), "
    "yy AS (SELECT strategy, rep, avg(x) AS y FROM pk JOIN rw ON rw.p = at_ GROUP BY 1, 2), dd AS (SELECT yy.*, sqrt(n) * (y - mean) AS d FROM yy JOIN mn USING (strategy)), sd AS (SELECT strategy, greatest(1e-12, stddev_samp(d)) AS s FROM dd GROUP BY 1), "
    "o1 AS (SELECT strategy, mean, n, sqrt(n) * mean AS v, sqrt(n) * mean / s AS t, s FROM mn JOIN sd USING (strategy)), "
    "o2 AS (SELECT *, least(t, 0) AS sl, CASE WHEN t <= -sqrt(2 * ln(ln(greatest(n, 16)))) THEN t ELSE 0 END AS sm, t >= -sqrt(2 * ln(greatest(ln(greatest(n, 3)), 1))) AS fair, row_number() OVER (ORDER BY t DESC, strategy) AS rk FROM o1), "
    "z AS (SELECT dd.*, o2.*, d / s AS z FROM dd JOIN o2 USING (strategy)), "
    "bs AS (SELECT rep, max(d) AS b, greatest(0, max(z + sl)) AS bl, greatest(0, max(z + sm)) AS bm, greatest(0, max(z)) AS bu, max(v) AS v, greatest(0, max(t)) AS tb, max(z) AS ma, max(z) FILTER (fair) AS mf, max(z) FILTER (mean >= 0) AS mp, max(t) AS mt FROM z GROUP BY 1), "
    f"jt AS (SELECT {_P.format(hit='b >= v')} AS p_reality, {_P.format(hit='bl >= tb')} AS p_hansen_lower, {_P.format(hit='bm >= tb')} AS p_hansen, {_P.format(hit='bu >= tb')} AS p_hansen_upper, {_P.format(hit='ma >= mt')} AS p_spa_lower, {_P.format(hit='mf >= mt')} AS p_spa, {_P.format(hit='mp >= mt')} AS p_spa_upper FROM bs), "
    f"s1 AS (SELECT strategy, rk, {_P.format(hit='sb >= t')} AS p FROM (SELECT *, max(z) OVER (PARTITION BY rep ORDER BY rk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS sb FROM z) GROUP BY 1, 2), s2 AS (SELECT strategy, max(p) OVER (ORDER BY rk) AS p_step FROM s1)"
)


@query("reality_check", out(_REALITY, "strategy", "mean t p_reality p_spa_lower p_spa p_spa_upper p_hansen_lower p_hansen p_hansen_upper p_step", "SELECT o2.strategy, mean, t, p_reality, p_spa_lower, p_spa, p_spa_upper, p_hansen_lower, p_hansen, p_hansen_upper, p_step FROM o2 JOIN s2 USING (strategy) CROSS JOIN jt", 4))
def reality_check(spark, sf):
    d = inference.reality_check(daily(spark, sf), "symbol", "ret", "ts", 300)
    return d.select("strategy", *[rounded(c, 4).alias(c) for c in d.columns if c != "strategy"])


@query("cluster_bootstrap", out(TRADES + ", g AS (SELECT symbol, date_trunc('month', entry) AS m, sum(pnl) AS s, count(pnl) AS c FROM trades GROUP BY 1, 2), nb AS (SELECT *, row_number() OVER (ORDER BY symbol, m) - 1 AS p, count(*) OVER () AS n FROM g), dr AS (SELECT n, p, k AS rep FROM nb CROSS JOIN range(500) r(k)), pk AS (SELECT rep, " + _h("c", "rep", "p") + " % n AS at_ FROM dr), mn AS (SELECT rep, sum(s) / sum(c) AS mean FROM pk JOIN nb ON nb.p = at_ GROUP BY 1)", "n", "lo median hi", "SELECT count(*) AS n, quantile_cont(mean, 0.025) AS lo, quantile_cont(mean, 0.5) AS median, quantile_cont(mean, 0.975) AS hi FROM mn", 4))
def cluster_bootstrap(spark, sf):
    g = trades(spark, sf).groupBy("symbol", F.date_trunc("month", "entry").alias("m")).agg(F.sum("pnl").alias("s"), F.count("pnl").cast("double").alias("n"))
    d = inference.interval(inference.cluster_bootstrap(g, 500, order=["symbol", "m"]), "mean")
    return d.select("n", *[rounded(c, 4).alias(c) for c in ("lo", "median", "hi")])


@query("roll_spread_daily", out(TICKS + ", m AS (SELECT symbol, s // 60 AS m, max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close FROM ticks GROUP BY 1, 2), r AS (SELECT *, m // 1440 AS d, close / nullif(lag(close) OVER (PARTITION BY symbol, m // 1440 ORDER BY m), 0) - 1 AS r FROM m), q AS (SELECT *, lag(r) OVER (PARTITION BY symbol, d ORDER BY m) AS r0 FROM r), g AS (SELECT symbol, (d * 86400)::BIGINT AS bucket_start, covar_samp(r, r0) AS cov, count(r) AS n_bars, avg((high - low) / nullif(close, 0)) AS hl FROM q GROUP BY 1, 2)", "symbol bucket_start n_bars fallback", "spread_bps", "SELECT symbol, bucket_start, n_bars, NOT coalesce(n_bars >= 30 AND cov < 0, false) AS fallback, greatest(0.5, CASE WHEN n_bars >= 30 AND cov < 0 THEN 2 * sqrt(-cov) * 1e4 ELSE hl * 0.5 * 1e4 END) AS spread_bps FROM g", 3))
def roll_spread_daily(spark, sf):
    d = orderflow.roll_spread(bars(spark, sf, "1 minute"), "day", key=KEY)
    return d.select("symbol", "bucket_start", "n_bars", "fallback", rounded("spread_bps", 3).alias("spread_bps"))


@query("portfolio_value", out(EQ + ", day AS (SELECT symbol, t // 86400 AS d, last(equity ORDER BY t) AS e FROM eq GROUP BY 1, 2), x AS (SELECT symbol, d, e / first_value(e) OVER (PARTITION BY symbol ORDER BY d) * 1000 AS v FROM day), g AS (SELECT s.symbol, k.d, x.v FROM (SELECT DISTINCT symbol FROM x) s CROSS JOIN (SELECT DISTINCT d FROM x) k LEFT JOIN x ON x.symbol = s.symbol AND x.d = k.d), f AS (SELECT d, coalesce(last_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY d), first_value(v IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY d ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS v FROM g)", "t", "value", "SELECT (d * 86400)::BIGINT AS t, sum(v) AS value FROM f GROUP BY 1", 3))
def portfolio_value(spark, sf):
    e = equity(spark, sf).select(F.col("symbol").alias("strategy"), "ts", "equity")
    cap = e.select("strategy").distinct().withColumn("capital", F.lit(1000.0))
    d = returns.portfolio(e, cap)
    return d.select("ts", rounded("value", 3).alias("value"))


@query("continuation_grid", out(BARS, "l h n", "p", "SELECT l, h, count(*) AS n, avg((past = fut)::INT) AS p FROM (" + " UNION ALL ".join(f"SELECT {a} AS l, {b} AS h, sign(close - lag(close, {a}) OVER w) AS past, sign(lead(close, {b}) OVER w - close) AS fut FROM bars {W}" for a in (1, 6) for b in (1, 6)) + ") WHERE past IS NOT NULL AND fut IS NOT NULL GROUP BY 1, 2"))
def continuation_grid(spark, sf):
    """Chance that the sign of the next h bars repeats that of the last l."""
    w = ordered(KEY)
    cells = [(a, b) for a in (1, 6) for b in (1, 6)]
    s = lambda c: F.signum(c)
    parts = F.array(*[F.struct(F.lit(a).alias("l"), F.lit(b).alias("h"), s(F.col("close") - F.lag("close", a).over(w)).alias("past"), s(F.lead("close", b).over(w) - F.col("close")).alias("fut")) for a, b in cells])
    x = bars(spark, sf).select(parts.alias("p")).select(F.explode("p").alias("p")).select("p.*").where("past IS NOT NULL AND fut IS NOT NULL")
    return x.groupBy("l", "h").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("past") == F.col("fut")).cast("double")).alias("p"))


@query("spearman_volume_return", out(RETS + ", x AS (SELECT symbol, volume, lead(r) OVER w AS f FROM rets " + W + "), y AS (SELECT symbol, rank() OVER (PARTITION BY symbol ORDER BY volume) + (count(*) OVER (PARTITION BY symbol, volume) - 1) / 2.0 AS a, rank() OVER (PARTITION BY symbol ORDER BY f) + (count(*) OVER (PARTITION BY symbol, f) - 1) / 2.0 AS b FROM x WHERE f IS NOT NULL)", "symbol", "rho", "SELECT symbol, corr(a, b) AS rho FROM y GROUP BY 1"))
def spearman_volume_return(spark, sf):
    x = with_returns(spark, sf).withColumn("f", F.lead("r").over(ordered(KEY))).where("f IS NOT NULL")
    x = rolling.rank_pct(rolling.rank_pct(x, "volume", "a", KEY), "f", "b", KEY)
    return x.groupBy("symbol").agg(F.corr("a", "b").alias("rho"))


@query("quantile_surface", out(BARS + ", x AS (SELECT symbol, volume, high - low AS rng, lead(close) OVER w - close AS f FROM bars " + W + "), e AS (SELECT quantile_cont(volume, 0.2) a1, quantile_cont(volume, 0.4) a2, quantile_cont(volume, 0.6) a3, quantile_cont(volume, 0.8) a4, quantile_cont(rng, 0.2) b1, quantile_cont(rng, 0.4) b2, quantile_cont(rng, 0.6) b3, quantile_cont(rng, 0.8) b4, min(volume) va, max(volume) vb, min(rng) ra, max(rng) rb FROM x)", "vq rq n", "mean", "SELECT len(list_filter(list_distinct([a1, a2, a3, a4]), lambda e: e > va AND e < vb AND volume > e)) AS vq, len(list_filter(list_distinct([b1, b2, b3, b4]), lambda e: e > ra AND e < rb AND rng > e)) AS rq, count(f) AS n, avg(f) AS mean FROM x CROSS JOIN e GROUP BY 1, 2"))
def quantile_surface(spark, sf):
    x = bars(spark, sf).withColumns({"rng": F.col("high") - F.col("low"), "f": F.lead("close").over(ordered(KEY)) - F.col("close")})
    x = rolling.quantile_cut(rolling.quantile_cut(x, "volume", 5, "vq", []), "rng", 5, "rq", [])
    return x.groupBy("vq", "rq").agg(F.count("f").alias("n"), F.avg("f").alias("mean"))


@query("top_quantile_share", "SELECT c_custkey FROM customer WHERE c_acctbal >= (SELECT quantile_cont(c_acctbal, 0.9) FROM customer)")
def top_quantile_share(spark, sf):
    return sweep.top_share(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", 0.1).select("c_custkey")


@query("top_per_group", "SELECT o_custkey, o_orderkey, rank FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3")
def top_per_group(spark, sf):
    return rolling.top_k(table(spark, sf, "orders"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 3, ["o_custkey"]).select("o_custkey", "o_orderkey", "rank")


@query("kelly_fraction", out(RETS + ", x AS (SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY symbol) AS n FROM rets WHERE r IS NOT NULL " + W + ")", "symbol", "kelly", "SELECT symbol, avg(r) / var_samp(r) AS kelly FROM x WHERE i <= 0.6 * n GROUP BY 1"))
def kelly_fraction(spark, sf):
    x = with_returns(spark, sf).where("r IS NOT NULL").withColumns({"i": F.row_number().over(ordered(KEY)), "n": F.count(F.lit(1)).over(Window.partitionBy("symbol"))})
    return x.where(F.col("i") <= 0.6 * F.col("n")).groupBy("symbol").agg((F.avg("r") / F.var_samp("r")).alias("kelly"))


@query("nonzero_volume_share", out(BARS, "symbol t", "share", "SELECT symbol, t, avg((volume > 20)::INT) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING) AS share FROM bars"))
def nonzero_volume_share(spark, sf):
    w = ordered(KEY).rowsBetween(-48, -1)
    return bars(spark, sf).select("symbol", "ts", F.avg((F.col("volume") > 20).cast("double")).over(w).alias("share"))


@query("feed_statistics", out(TICKS + ", g AS (SELECT symbol, epoch(ts) AS s, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY symbol ORDER BY ts) AS g FROM ticks)", "symbol rows", "span_s median_gap p95_gap rows_per_minute", "SELECT symbol, count(*) AS rows, max(s) - min(s) AS span_s, quantile_cont(g, 0.5) AS median_gap, quantile_cont(g, 0.95) AS p95_gap, count(*) / ((max(s) - min(s)) / 60) AS rows_per_minute FROM g GROUP BY 1", 3))
def feed_statistics(spark, sf):
    d = orderflow.feed_statistics(ticks(spark, sf), key=KEY)
    return d.select("symbol", "rows", *[rounded(c, 3).alias(c) for c in d.columns[2:]])
