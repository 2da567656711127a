"""Summary tables over returns, trials, paths and windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.grid import ordered, resample, up_to_now
from tidemark.operators.inference import expected_max_sharpe, probabilistic_sharpe
from tidemark.operators.joins import asof_join
from tidemark.operators.metrics import sharpe
from tidemark.operators.rolling import last_k, rank_pct, rolling, running_product, simple_return


def spread_summary(spreads: DataFrame, *, key: list[str]) -> DataFrame:
    """Mean, median and 95th percentile of spreads, and the share that fell back to the range."""
    s = F.col("spread_bps")
    return spreads.groupBy(*key).agg(
        F.count(s).alias("n"), F.avg(s).alias("mean"), F.percentile(s, F.lit(0.5)).alias("median"), F.percentile(s, F.lit(0.95)).alias("p95"),
        (F.avg(F.col("fallback").cast("double")) * 100).alias("fallback_pct"),
    )


def trial_summary(trials: DataFrame, metric: str, *, key: list[str] = []) -> DataFrame:  # noqa: B006
    """Spread of trial Sharpe ratios beside the best of as many trials without skill."""
    m = F.col(metric)
    g = trials.where(m.isNotNull() & ~F.isnan(m)).groupBy(*key).agg(
        F.count(m).alias("n"), F.min(m).alias("least"), F.max(m).alias("most"), F.avg(m).alias("mean"), F.percentile(m, F.lit(0.5)).alias("median"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias("std")
    )
    best = _expected_best(g)
    return g.withColumn("expected_best", best * F.col("std")).withColumn("premium", F.col("most") - F.col("expected_best"))


def _expected_best(g: DataFrame) -> Column:
    """Expected maximum of ``n`` standard normals, by a map over the few values of ``n``."""
    sizes = sorted(r["n"] for r in g.select("n").distinct().limit(10_001).collect())
    if len(sizes) > 10_000:
        raise ValueError("over 10,000 different numbers of trials: summarise them in parts")
    pairs = [F.lit(x) for n in sizes for x in (n, expected_max_sharpe(n, 1.0))]
    return F.element_at(F.create_map(*pairs), F.col("n")) if pairs else F.lit(0.0)


def equal_width_counts(df: DataFrame, x: str, *, key: list[str] = []) -> DataFrame:  # noqa: B006
    """(bin, lo, hi, n) of half as many bins as values, at least 5 and at most 30."""
    v = F.col(x)
    edges = df.where(v.isNotNull()).groupBy(*key).agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"), F.least(F.lit(30), F.greatest(F.lit(5), F.floor(F.count(v) / 2))).alias("__n"))
    d = df.where(v.isNotNull())
    d = d.join(edges, key) if key else d.join(F.broadcast(edges))
    width = (F.col("__hi") - F.col("__lo")) / F.col("__n")
    at = F.least(F.col("__n") - 1, F.coalesce(F.floor(F.try_divide(v - F.col("__lo"), width)), F.lit(0))).cast("int")
    g = d.groupBy(*key, at.alias("bin"), "__lo", width.alias("__w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(*key, "bin", (F.col("__lo") + F.col("bin") * F.col("__w")).alias("lo"), (F.col("__lo") + (F.col("bin") + 1) * F.col("__w")).alias("hi"), "n")


def path_summary(paths: DataFrame, metric: str, *, key: list[str] = []) -> DataFrame:  # noqa: B006
    """Distribution of a metric over combinatorial paths."""
    m = F.col(metric)
    q = lambda p: F.percentile(m, F.lit(p))
    return paths.groupBy(*key).agg(
        F.count(m).alias("n_paths"), q(0.5).alias("median"), F.avg(m).alias("mean"), F.coalesce(F.stddev_samp(m), F.lit(0.0)).alias("std"), q(0.25).alias("q25"), q(0.75).alias("q75"), q(0.05).alias("p05"),
        q(0.95).alias("p95"), (F.avg((m > 0).cast("double")) * 100).alias("positive_pct"), (F.avg((m > 1).cast("double")) * 100).alias("above_1_pct"),
    )


def drift_verdict(forward: DataFrame, r: str, lo: float, hi: float, ppy: float, *, key: list[str], ts: str = "ts", window: int = 30, bars_per_day: int = 1, alert_days: int = 14, warn_days: int = 7) -> DataFrame:
    """Forward Sharpe against a backtest's interval [lo, hi].

    ``z`` is the distance from its middle in half widths; ``streak`` the days that the
    rolling Sharpe has been under ``lo`` by now. alert: z under -1.5 or a streak of
    ``alert_days``; warn: z under 0 or ``warn_days``; unknown: under 10 returns.
    """
    c = F.col(r)
    d = forward.where(c.isNotNull())
    w = last_k(window, key, ts)
    rolled = rolling(F.avg, c, w, window) / F.nullif(F.stddev_samp(c).over(w), F.lit(0.0)) * math.sqrt(ppy)
    d = d.withColumn("__low", rolled < lo).withColumn("__eq", running_product(c, key, ts))
    d = d.withColumn("__dd", 1 - F.col("__eq") / F.greatest(F.lit(1.0), F.max("__eq").over(up_to_now(key, ts))))
    d = d.withColumn("__i", F.when(F.col("__low").isNotNull(), F.count("__low").over(up_to_now(key, ts))))
    g = d.groupBy(*key).agg(
        F.count(c).alias("n"), sharpe(c, ppy).alias("sharpe"), (F.product(1 + c) - 1).alias("total_return"), F.max("__dd").alias("max_drawdown"), F.stddev_samp(c).alias("volatility"),
        F.coalesce(F.max("__i") - F.coalesce(F.max(F.when(~F.col("__low"), F.col("__i"))), F.min(F.when(F.col("__low"), F.col("__i"))) - 1), F.lit(0)).alias("__streak"),
    )
    psr = probabilistic_sharpe(d, r, key=key).select(*key, "psr")
    half = max((hi - lo) / 2, 1e-9)
    g = g.join(psr, key).withColumns({"z": (F.col("sharpe") - (lo + hi) / 2) / half, "in_interval": F.col("sharpe").between(lo, hi), "streak": F.floor(F.col("__streak") / bars_per_day)})
    flag = (
        F.when(F.col("n") < 10, "unknown").when((F.col("z") < -1.5) | (F.col("streak") >= alert_days), "alert")
        .when((F.col("z") < 0) | (F.col("streak") >= warn_days), "warn").otherwise("ok")
    )
    return g.withColumn("flag", flag).drop("__streak")


def funding_and_forward(bars: DataFrame, funding: DataFrame, width: str, *, key: list[str], ts: str = "ts", rate: str = "rate") -> DataFrame:
    """Funding rate against the next coarse return: correlation and mean by sign."""
    coarse = resample(bars, width, {"close": F.max_by("close", ts)}, key=key, ts=ts)
    nxt = F.try_divide(F.lead("close").over(ordered(key, ts)), F.col("close")) - 1
    d = asof_join(coarse.withColumn("fwd", nxt), funding, [rate], key=key, ts=ts).where(F.col("fwd").isNotNull() & F.col(rate).isNotNull())
    return d.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.corr(rate, "fwd").alias("corr"), F.avg(F.when(F.col(rate) > 0, F.col("fwd"))).alias("mean_positive"), F.avg(F.when(F.col(rate) < 0, F.col("fwd"))).alias("mean_negative")
    )


def volatility_split(returns: DataFrame, r: str, k: int, regimes: int, *, key: list[str], ts: str = "ts") -> DataFrame:
    """Autocorrelation and size of returns in equal shares of rolling volatility."""
    d = returns.withColumns({"__vol": rolling(F.stddev_samp, F.col(r), last_k(k, key, ts), k), "__next": F.lead(r).over(ordered(key, ts))})
    d = rank_pct(d.where(F.col(r).isNotNull() & F.col("__vol").isNotNull() & F.col("__next").isNotNull()), "__vol", "__p", key)
    d = d.withColumn("regime", F.least(F.lit(regimes - 1), F.floor(F.col("__p") * regimes)).cast("int"))
    g = d.groupBy(*key, "regime").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(r)).alias("mean_abs"), F.avg(r).alias("mean"), F.corr(r, "__next").alias("autocorrelation"), F.min("__vol").alias("vol_from"), F.max("__vol").alias("vol_to")
    )
    return g.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(*key)))


def regime_gap(rows: DataFrame, flag: Column, x: str, key: str) -> DataFrame:
    """Mean of ``x`` where the flag holds less the mean elsewhere, per key and pooled ("ALL")."""
    d = rows.withColumn("__f", flag).where(F.col("__f").isNotNull() & F.col(x).isNotNull())
    g = d.rollup(key).agg(F.grouping(key).alias("__all"), F.count(F.lit(1)).alias("n"), (F.avg(F.when(F.col("__f"), F.col(x))) - F.avg(F.when(~F.col("__f"), F.col(x)))).alias("gap"))
    return g.select(F.when(F.col("__all") == 1, F.lit("ALL")).otherwise(F.col(key)).alias(key), "n", "gap")


def halts(events: DataFrame, bars: DataFrame, horizon: int, fall: float, *, key: list[str]) -> DataFrame:
    """Share of events whose horizon passes the end of the data, and of the others still down by ``fall``."""
    last = bars.groupBy(*key).agg(F.max("idx").alias("__last"))
    later = bars.select(*key, (F.col("idx") - horizon).alias("idx"), F.col("close").alias("__later"))
    d = events.join(last, key).join(later, [*key, "idx"], "left").withColumn("__ended", F.col("idx") + horizon > F.col("__last"))
    move = F.try_divide(F.col("__later"), F.col("close")) - 1
    return d.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("__ended").cast("double")).alias("halted"), F.avg(F.when(~F.col("__ended"), (move < -fall).cast("double"))).alias("still_down"), F.avg(F.when(~F.col("__ended"), move)).alias("mean_move")
    )


def period_quantiles(df: DataFrame, features: list[str], at: Column, *, qs: tuple[float, ...] = (0.05, 0.25, 0.5, 0.75, 0.95)) -> DataFrame:
    """(feature, period, one column per quantile): train is before ``at``, holdout from it on."""
    period = F.when(at, "holdout").otherwise("train").alias("period")
    long = df.select(period, F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features])).alias("e")).select("period", "e.*")
    g = long.groupBy("feature", "period").agg(F.count("x").alias("n"), F.percentile("x", F.array(*[F.lit(q) for q in qs])).alias("q"))
    return g.select("feature", "period", "n", *[F.col("q")[i].alias(f"q{round(q * 100):02d}") for i, q in enumerate(qs)])


def month_streaks(months: DataFrame, ret: str, *, key: list[str], month: str = "month") -> DataFrame:
    """Red and green months, the worst, the best, and the longest run of losses."""
    w = Window.partitionBy(*key).orderBy(month)
    d = months.withColumn("__g", F.sum((F.col(ret) >= 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    red = F.col(ret) < 0
    d = d.withColumn("__run", F.sum(red.cast("int")).over(Window.partitionBy(*key, "__g")))
    return d.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.count(F.when(red, 1)).alias("red"), F.count(F.when(F.col(ret) > 0, 1)).alias("green"), F.max("__run").alias("longest_red"), F.min(ret).alias("worst"), F.max(ret).alias("best")
    )


def stitched(equity: DataFrame, window: str, *, key: list[str], ts: str = "ts", value: str = "equity", flows: list[str] = []) -> DataFrame:  # noqa: B006
    """Windows compounded by last over first value, with the sums of cash flows; short windows count as flat."""
    g = equity.groupBy(*key, window).agg(F.count(F.lit(1)).alias("__n"), F.try_divide(F.max_by(value, ts), F.min_by(value, ts)).alias("__g"), *[F.sum(c).alias(f"__{c}") for c in flows])
    grown = F.product(F.when(F.col("__n") > 1, F.col("__g")).otherwise(1.0)) - 1
    return g.groupBy(*key).agg(F.count(F.lit(1)).alias("windows"), grown.alias("stitched_return"), *[F.sum(f"__{c}").alias(c) for c in flows])


def held_out_days(equity: DataFrame, folds: DataFrame, *, key: list[str], ts: str = "ts", value: str = "equity", share: float = 0.75) -> DataFrame:
    """Daily returns of the out-of-sample part of each window, first window first where they overlap.

    ``folds`` is (window, cutoff); without a cutoff the last quarter of a window counts.
    """
    w = Window.partitionBy(*key, "window").orderBy(ts)
    n = F.count(F.lit(1)).over(Window.partitionBy(*key, "window"))
    d = equity.join(F.broadcast(folds), "window", "left").withColumns({"__i": F.row_number().over(w) - 1, "__n": n})
    d = d.where(F.when(F.col("cutoff").isNotNull(), F.col(ts) >= F.col("cutoff")).otherwise(F.col("__i") >= F.floor(F.col("__n") * share)))
    d = d.withColumn("__r", F.try_divide(F.col(value), F.lag(value).over(w)) - 1).where("__r IS NOT NULL")
    one = d.groupBy(*key, ts).agg(F.min_by("__r", "window").alias("__r"))
    return one.groupBy(*key, F.date_trunc("day", ts).alias("day")).agg((F.product(1 + F.col("__r")) - 1).alias("ret"), F.count(F.lit(1)).alias("bars"))


def iteration_flags(*, sharpe_: Column, trades: Column, in_position_pct: Column, total_return: Column, largest_pct: Column, red_streak: Column, profit_factor: Column, windows: Column, positive_windows: Column, worst_gap: Column, top_share: Column) -> Column:
    """Names of the rules that a run trips, as an array."""
    rules = {
        "strong_sharpe": sharpe_ >= 1.5, "negative_sharpe": sharpe_ < 0, "all_windows_positive": (windows > 0) & (positive_windows == windows), "all_windows_negative": (windows > 0) & (positive_windows == 0),
        "one_window_positive": (windows > 1) & (positive_windows == 1), "train_gap": worst_gap > 1.0, "one_window_dominates": (windows >= 3) & (top_share > 0.5), "no_trades": trades == 0,
        "few_trades": (trades > 0) & (trades < 50), "almost_no_position": in_position_pct < 5, "low_activity": (in_position_pct >= 5) & (in_position_pct < 20), "inflated_sharpe": (sharpe_ > 1) & (F.abs(total_return) < 0.01),
        "one_trade_dominates": largest_pct > 30, "red_streak": red_streak >= 3, "losses_dominate": profit_factor < 1, "thin_edge": (profit_factor >= 1) & (profit_factor < 1.3), "calendar_bias": (sharpe_ > 0.5) & (total_return < 0),
    }
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]), lambda x: x.isNotNull())


def trailing_autocorrelation_ranks(returns: DataFrame, r: str, every: str, days: int, k: int, *, key: str = "symbol", ts: str = "ts", least: int = 30) -> DataFrame:
    """(month, key, autocorrelation, side, weight): k most and k least autocorrelated keys of the ``days`` days before each period.

    Periods (``every``: "month", "week", ...) are those that begin within the data and have rows. A row
    is dealt to the starts that look back to it, so nothing is compared with all dates. Equal weights on both sides.
    """
    d = returns.withColumn("__l", F.lag(r).over(ordered([key], ts))).where(F.col(r).isNotNull() & F.col("__l").isNotNull())
    m = returns.select(F.date_trunc(every, ts).alias("__m")).distinct()
    step = F.expr(f"interval 1 {every}")
    starts = F.sequence(F.date_trunc(every, ts), F.date_trunc(every, F.col(ts) + F.make_dt_interval(F.lit(days))), step)
    j = d.withColumn("__m", F.explode(starts)).where((F.col("__m") > F.col(ts)) & (F.col("__m") <= F.col(ts) + F.make_dt_interval(F.lit(days)))).join(m, "__m")
    g = j.groupBy(F.col("__m").alias("month"), key).agg(F.count(F.lit(1)).alias("n"), F.corr(r, "__l").alias("autocorrelation")).where((F.col("n") >= least) & F.col("autocorrelation").isNotNull())
    up = F.row_number().over(Window.partitionBy("month").orderBy(F.col("autocorrelation").desc(), key))
    down = F.row_number().over(Window.partitionBy("month").orderBy("autocorrelation", key))
    g = g.withColumn("side", F.when(up <= k, 1).when(down <= k, -1)).where("side IS NOT NULL")
    return g.withColumn("weight", F.col("side") / F.count(F.lit(1)).over(Window.partitionBy("month"))).drop("n")
