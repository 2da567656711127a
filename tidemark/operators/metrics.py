"""Performance, risk and distribution statistics as grouped aggregates."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.grid import ordered, resample, up_to_now
from tidemark.operators.rolling import runs

YEAR_SECONDS = 31_557_600


def periods_per_year(seconds: int) -> float:
    """Bars of a width in a year of 365 days."""
    return 365 * 86_400 / seconds


def sharpe(r: Column, ppy: float) -> Column:
    """Mean over sample deviation, annualised; 0 under two rows or without spread."""
    sd = F.stddev_samp(r)
    return F.when((F.count(r) < 2) | (sd == 0) | sd.isNull(), 0.0).otherwise(F.avg(r) / sd * math.sqrt(ppy))


def sortino(r: Column, ppy: float) -> Column:
    """Against the deviation of losses; infinite when nothing is lost and the mean is positive."""
    down = F.stddev_samp(F.when(r < 0, r))
    return (
        F.when(F.count(r) < 2, 0.0)
        .when(down.isNull() | (down == 0), F.when(F.avg(r) > 0, F.lit(float("inf"))).otherwise(0.0))
        .otherwise(F.avg(r) / down * math.sqrt(ppy))
    )


def profit_factor(x: Column) -> Column:
    """Gains over losses; infinite without losses, null without either."""
    gain, loss = F.coalesce(F.sum(F.when(x > 0, x)), F.lit(0.0)), F.coalesce(-F.sum(F.when(x < 0, x)), F.lit(0.0))
    return F.when(loss > 0, gain / loss).when(gain > 0, F.lit(float("inf")))


def skew_unbiased(x: Column) -> Column:
    n = F.count(x)
    return F.when(n >= 3, F.sqrt(n * (n - 1)) / (n - 2) * F.skewness(x))


def kurtosis_unbiased(x: Column) -> Column:
    n = F.count(x)
    return F.when(n >= 4, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6))


def drawdown(df: DataFrame, equity: str, *, key: list[str], ts: str = "ts") -> DataFrame:
    """``df`` with ``peak`` and ``dd`` = equity / running peak - 1."""
    return df.withColumn("peak", F.max(equity).over(up_to_now(key, ts))).withColumn("dd", F.col(equity) / F.col("peak") - 1)


def risk_summary(returns: DataFrame, r: str, ppy: float, *, key: list[str]) -> DataFrame:
    c = F.col(r)
    return returns.groupBy(*key).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), sharpe(c, ppy).alias("sharpe"), sortino(c, ppy).alias("sortino"),
        F.avg(F.when(c != 0, (c > 0).cast("double"))).alias("hit_rate"), profit_factor(c).alias("profit_factor"),
        F.avg(F.when(c > 0, c)).alias("avg_win"), F.avg(F.when(c < 0, c)).alias("avg_loss"),
        skew_unbiased(c).alias("skew"), kurtosis_unbiased(c).alias("kurtosis"),
    )


def drawdown_summary(df: DataFrame, equity: str, *, key: list[str], ts: str = "ts") -> DataFrame:
    """Maximum drawdown, ulcer index, growth per year and their ratio."""
    d = drawdown(df, equity, key=key, ts=ts)
    years = (F.max(F.unix_timestamp(ts)) - F.min(F.unix_timestamp(ts))) / YEAR_SECONDS
    growth = F.max_by(equity, ts) / F.min_by(equity, ts)
    out = d.groupBy(*key).agg(
        (-F.min("dd")).alias("max_drawdown"), F.sqrt(F.avg(F.pow(F.least(F.col("dd"), F.lit(0.0)), 2))).alias("ulcer_index"),
        growth.alias("growth"), years.alias("years"),
    )
    out = out.withColumn("cagr", F.when((F.col("years") > 0) & (F.col("growth") > 0), F.pow("growth", 1 / F.col("years")) - 1))
    return out.withColumn("calmar", F.when(F.col("max_drawdown") > 0, F.col("cagr") / F.col("max_drawdown")))


def longest_run(df: DataFrame, cond: Column, *, key: list[str], ts: str = "ts") -> DataFrame:
    """Longest stretch of rows in which the condition holds."""
    r = runs(df.withColumn("__c", F.coalesce(cond, F.lit(False))), "__c", "__run", key, ts)
    by_run = r.groupBy(*key, "__run").agg(F.first("__c").alias("c"), F.count(F.lit(1)).alias("n"))
    return by_run.groupBy(*key).agg(F.coalesce(F.max(F.when(F.col("c"), F.col("n"))), F.lit(0)).alias("longest"))


def drawdown_episodes(df: DataFrame, equity: str, n: int, *, key: list[str], ts: str = "ts") -> DataFrame:
    """The ``n`` deepest stretches under water: start, end, depth, bars."""
    d = drawdown(df, equity, key=key, ts=ts).withColumn("__under", F.col("dd") < 0)
    by_run = runs(d, "__under", "__run", key, ts).where("__under").groupBy(*key, "__run").agg(
        F.min(ts).alias("start"), F.max(ts).alias("end"), F.min("dd").alias("depth"), F.count(F.lit(1)).alias("bars")
    )
    return by_run.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy("depth", "start"))).where(F.col("rank") <= n).drop("__run")


def daily_returns(returns: DataFrame, r: str, *, key: list[str], ts: str = "ts") -> DataFrame:
    """Compounded return per calendar day; a day without rows compounds to 0."""
    day = resample(returns, "day", {"ret": F.product(1 + F.coalesce(F.col(r), F.lit(0.0))) - 1}, key=key, ts=ts)
    span = day.groupBy(*key).agg(F.min(ts).alias("a"), F.max(ts).alias("b"))
    grid = span.select(*key, F.explode(F.sequence("a", "b", F.expr("INTERVAL 1 DAY"))).alias(ts))
    return grid.join(day, [*key, ts], "left").withColumn("ret", F.coalesce("ret", F.lit(0.0)))


def tail_risk(returns: DataFrame, r: str, level: float, *, key: list[str], least: int = 20) -> DataFrame:
    """Value at risk (a quantile) and the mean at or below it."""
    var = returns.groupBy(*key).agg(F.percentile(r, F.lit(1 - level)).alias("var"), F.count(r).alias("n"))
    below = returns.join(var, key).where(F.col(r) <= F.col("var")).groupBy(*key).agg(F.avg(r).alias("cvar"))
    return var.join(below, key, "left").where(F.col("n") >= least)


def tail_ratio(returns: DataFrame, r: str, *, key: list[str], least: int = 50) -> DataFrame:
    q = returns.groupBy(*key).agg(F.percentile(r, F.array(F.lit(0.1), F.lit(0.9))).alias("q"), F.count(r).alias("n"))
    out = returns.join(q, key).groupBy(*key).agg(
        F.first("n").alias("n"), F.avg(F.when(F.col(r) >= F.col("q")[1], F.col(r))).alias("up"), F.avg(F.when(F.col(r) <= F.col("q")[0], F.col(r))).alias("down")
    )
    return out.where(F.col("n") >= least).withColumn("tail_ratio", F.col("up") / F.nullif(F.abs("down"), F.lit(0.0)))


def turnover(positions: DataFrame, position: str, *, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Mean over calendar days of the summed absolute position changes."""
    moved = positions.withColumn("__d", F.abs(F.col(position) - F.lag(position).over(ordered([key], ts))))
    day = moved.groupBy(F.date_trunc("day", ts).alias("day")).agg(F.sum("__d").alias("t"))
    span = day.agg(F.sum("t").alias("t"), (F.datediff(F.max("day"), F.min("day")) + 1).alias("days"))
    return span.select((F.coalesce("t", F.lit(0.0)) / F.col("days")).alias("turnover"))


def concentration(trades: DataFrame, pnl: str, *, key: list[str], tie: str) -> DataFrame:
    """Share of the total's absolute value that the best and the five best winners make."""
    w = Window.partitionBy(*key).orderBy(F.col(pnl).desc(), tie)
    ranked = trades.withColumn("__rk", F.when(F.col(pnl) > 0, F.row_number().over(w)))
    total = F.nullif(F.abs(F.sum(pnl)), F.lit(0.0))
    return ranked.groupBy(*key).agg(
        (F.sum(F.when(F.col("__rk") <= 1, F.col(pnl))) / total * 100).alias("top1_pct"), (F.sum(F.when(F.col("__rk") <= 5, F.col(pnl))) / total * 100).alias("top5_pct")
    )


def trade_shape(trades: DataFrame, pnl: str, *, key: list[str]) -> DataFrame:
    """Win rate, payoff, medians and the largest trade's share."""
    p = F.col(pnl)
    win, loss = F.when(p > 0, p), F.when(p < 0, p)
    return trades.groupBy(*key).agg(
        F.count(p).alias("n"), F.sum(p).alias("pnl"), (F.avg((p > 0).cast("double")) * 100).alias("win_pct"),
        (F.avg(win) / F.nullif(F.abs(F.avg(loss)), F.lit(0.0))).alias("payoff"), F.percentile(win, F.lit(0.5)).alias("median_win"), F.percentile(loss, F.lit(0.5)).alias("median_loss"),
        (F.max(F.abs(p)) / F.nullif(F.sum(F.abs(p)), F.lit(0.0))).alias("largest_share"), F.avg(p).alias("expectancy"), profit_factor(p).alias("profit_factor"),
    )


def describe(df: DataFrame, x: str, *, key: list[str]) -> DataFrame:
    """One distribution line per key."""
    c = F.col(x)
    return df.groupBy(*key).agg(
        F.count(c).alias("n"), F.avg(c).alias("mean"), F.percentile(c, F.lit(0.5)).alias("median"), F.avg((c > 0).cast("double")).alias("win"), F.stddev_samp(c).alias("std"),
        F.percentile(c, F.lit(0.1)).alias("q10"), F.percentile(c, F.lit(0.9)).alias("q90"), (F.avg(c) / F.nullif(F.stddev_samp(c), F.lit(0.0))).alias("ratio"), F.sum(c).alias("sum"),
    )


def against_baseline(df: DataFrame, x: str, is_signal: Column) -> DataFrame:
    """Difference of means and Welch's t between signal and other rows."""
    c = F.col(x)
    a, b = F.when(is_signal, c), F.when(~is_signal, c)
    se = F.sqrt(F.var_samp(a) / F.count(a) + F.var_samp(b) / F.count(b))
    return df.agg(F.count(a).alias("n_signal"), F.count(b).alias("n_base"), (F.avg(a) - F.avg(b)).alias("delta"), ((F.avg(a) - F.avg(b)) / F.nullif(se, F.lit(0.0))).alias("welch_t"))


def monthly_returns(returns: DataFrame, r: str, *, key: list[str], ts: str = "ts") -> DataFrame:
    return returns.groupBy(*key, F.date_trunc("month", ts).alias("month")).agg((F.product(1 + F.coalesce(F.col(r), F.lit(0.0))) - 1).alias("ret"))


def month_table(monthly: DataFrame, *, key: list[str]) -> DataFrame:
    """One row per year with columns m1 to m12."""
    wide = monthly.withColumn("__m", F.month("month")).groupBy(*key, F.year("month").alias("year")).pivot("__m", list(range(1, 13)))
    out = wide.agg(F.first("ret"))
    return out.select(*key, "year", *[F.col(str(i)).alias(f"m{i}") for i in range(1, 13)])


def histogram(df: DataFrame, x: str, lo: float, hi: float, bins: int, *, key: list[str]) -> DataFrame:
    """Equal-width counts; the right edge belongs to the last bin; empty bins are present."""
    b = F.when((F.col(x) >= lo) & (F.col(x) <= hi), F.least(F.floor((F.col(x) - lo) / ((hi - lo) / bins)), F.lit(bins - 1)).cast("int"))
    counted = df.where(b.isNotNull()).groupBy(*key, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.select(*key).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(counted, [*key, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))


def correlation_table(df: DataFrame, value: str, *, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Pearson correlation of every two keys over their common times, a < b."""
    from tidemark.operators.joins import symbol_pairs

    return symbol_pairs(df, value, key=key, ts=ts).groupBy("a", "b").agg(F.corr("va", "vb").alias("corr"), F.count(F.lit(1)).alias("n"))


def autocorrelation(df: DataFrame, x: str, lags: list[int], *, key: list[str], ts: str = "ts") -> DataFrame:
    """(key, lag, corr), all lags in one pass."""
    w = ordered(key, ts)
    wide = df.withColumns({f"__l{k}": F.lag(x, k).over(w) for k in lags})
    one = wide.groupBy(*key).agg(*[F.corr(F.col(x), F.col(f"__l{k}")).alias(f"c{k}") for k in lags])
    return one.select(*key, F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"c{k}").alias("corr")) for k in lags])).alias("e")).select(*key, "e.lag", "e.corr")


def variance_ratio(df: DataFrame, r: str, q: int, *, key: list[str], ts: str = "ts") -> DataFrame:
    """Variance of overlapping q-sums about q means, over q times the variance."""
    w = ordered(key, ts).rowsBetween(-(q - 1), 0)
    s = df.where(F.col(r).isNotNull()).withColumn("__s", F.when(F.count(r).over(w) == q, F.sum(r).over(w))).withColumn("__mu", F.avg(r).over(Window.partitionBy(*key)))
    return s.groupBy(*key).agg((F.avg(F.pow(F.col("__s") - q * F.col("__mu"), 2)) / (q * F.var_pop(r))).alias("variance_ratio"))


def capacity(trades: DataFrame, bars: DataFrame, *, key: str = "symbol", entry: str = "entry", notional: str = "notional", limit: float = 1.0) -> DataFrame:
    """Participation of each trade in the day's traded value; missing days give null."""
    day = bars.groupBy(F.col(key).alias("__k"), F.date_trunc("day", "ts").alias("__day")).agg(F.sum(F.col("close") * F.col("volume")).alias("day_value"))
    return trades.join(day, (trades[key] == F.col("__k")) & (F.date_trunc("day", F.col(entry)) == F.col("__day")), "left").drop("__k", "__day").withColumn(
        "participation_pct", F.col(notional) / F.nullif(F.col("day_value"), F.lit(0.0)) * 100
    )


def regime_table(df: DataFrame, r: str, k: int, ppy: float, *, key: list[str], ts: str = "ts") -> DataFrame:
    """Sharpe, mean and hit rate by volatility quartile and trend tercile; under 5 rows null."""
    from tidemark.operators.rolling import last_k, quantile_cut, rolling

    w = last_k(k, key, ts)
    d = df.withColumns({"vol": rolling(F.stddev_samp, F.col(r), w, k), "trend": rolling(F.avg, F.col(r), w, k)}).where("vol IS NOT NULL AND trend IS NOT NULL")
    d = quantile_cut(quantile_cut(d, "vol", 4, "vol_q", key), "trend", 3, "trend_q", key)
    c = F.col(r)
    g = d.groupBy(*key, "vol_q", "trend_q").agg(F.count(c).alias("n"), sharpe(c, ppy).alias("s"), (F.avg(c) * 1e4).alias("b"), (F.avg((c > 0).cast("double")) * 100).alias("h"))
    ok = lambda x: F.when(F.col("n") >= 5, F.col(x))
    return g.select(*key, "vol_q", "trend_q", "n", ok("s").alias("sharpe"), ok("b").alias("mean_bps"), ok("h").alias("hit_pct"))


def composite_score(sharpe_: Column, max_dd: Column, n_trades: Column, total_return: Column, *, dd_weight: float = 1.0, least_trades: int = 30) -> Column:
    """Sharpe less weighted drawdown and a penalty for few trades; losers never score above 0."""
    raw = sharpe_ - dd_weight * max_dd - F.greatest(F.lit(0.0), (least_trades - n_trades) / float(least_trades))
    return F.when(total_return <= 0, F.least(raw, F.lit(0.0))).otherwise(raw)


def walk_forward_summary(folds: DataFrame, metric: str, ret: str, *, key: list[str]) -> DataFrame:
    return folds.groupBy(*key).agg(
        F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), F.percentile(metric, F.lit(0.5)).alias("median"), F.min(metric).alias("worst"),
        (F.product(1 + F.col(ret)) - 1).alias("stitched"), F.count(F.lit(1)).alias("folds"),
    )


def sweep_report(cells: DataFrame, metric: str, dims: list[str]) -> DataFrame:
    """Breadth, median and quartile range per dimension and in all, by grouping sets."""
    c = F.col(metric)
    out = cells.groupingSets([[F.col(d)] for d in dims] + [[]], *dims).agg(
        F.count(c).alias("n"), F.avg((c > 0).cast("double")).alias("breadth"), F.percentile(c, F.lit(0.5)).alias("median"),
        (F.percentile(c, F.lit(0.75)) - F.percentile(c, F.lit(0.25))).alias("iqr"),
    )
    return out
