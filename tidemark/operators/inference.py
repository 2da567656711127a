"""Resampling tests and Sharpe inference.

Replicates are rows: draws are hashes of a seed, the replicate and the place, and meet
the numbered rows by an equi join, so no series passes through the driver or a worker
whole and results repeat wherever they run.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.metrics import kurtosis_unbiased, skew_unbiased

EULER = 0.5772156649015329


def _phi(x: float) -> float:
    return 0.5 * math.erfc(-x / math.sqrt(2))


def _phi_inverse(p: float) -> float:
    from statistics import NormalDist

    return NormalDist().inv_cdf(p) if 0 < p < 1 else (math.inf if p >= 1 else -math.inf)


def normal_cdf(x: Column) -> Column:
    """Standard normal distribution function, for one row per group."""

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None or v != v else _phi(v)).astype(float)

    run.__annotations__ = {"s": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "double")(x.cast("double"))


def expected_max_sharpe(n_trials: int, sd: float) -> float:
    """Expected best of n independent zero Sharpe ratios with the given deviation."""
    if n_trials < 2:
        return 0.0
    return sd * ((1 - EULER) * _phi_inverse(1 - 1 / n_trials) + EULER * _phi_inverse(1 - 1 / (n_trials * math.e)))


def probabilistic_sharpe(returns: DataFrame, r: str, benchmark: float = 0.0, *, key: list[str]) -> DataFrame:
    """P(true Sharpe > benchmark) per period, with skew and kurtosis."""
    c = F.col(r)
    m = returns.groupBy(*key).agg(F.count(c).alias("n"), F.avg(c).alias("mu"), F.stddev_samp(c).alias("sd"), skew_unbiased(c).alias("skew"), kurtosis_unbiased(c).alias("kurt"))
    m = m.withColumn("sr", F.col("mu") / F.nullif(F.col("sd"), F.lit(0.0)))
    spread = F.sqrt(F.greatest(F.lit(1e-12), 1 - F.col("skew") * F.col("sr") + (F.col("kurt") + 2) / 4 * F.pow("sr", 2)))
    m = m.withColumn("z", (F.col("sr") - benchmark) * F.sqrt(F.col("n") - 1) / spread)
    return m.withColumn("psr", normal_cdf(F.col("z"))).select(*key, "n", "sr", "z", "psr")


def permuted(rows: DataFrame, cols: list[str], *, key: list[str], order: str, seed: int = 1) -> DataFrame:
    """``cols`` dealt anew to the rows of each key, by a seeded order of ``order``, which is unique in a key.

    Marginals stay and links with the other columns are cut: the null of a matched
    control. Both rankings stream over sorted rows, so no key is held in memory.
    """
    rank = F.md5(F.concat(F.lit(f"{seed}:"), F.col(order).cast("string")))
    kept = rows.drop(*cols).withColumn("__i", F.row_number().over(Window.partitionBy(*key).orderBy(order)))
    dealt = rows.select(
        *[F.col(k).alias(f"__k{n}") for n, k in enumerate(key)], *[F.col(c).alias(f"__c{n}") for n, c in enumerate(cols)],
        F.row_number().over(Window.partitionBy(*key).orderBy(rank, order)).alias("__j"),
    )
    same = F.col("__i") == F.col("__j")
    for n, k in enumerate(key):
        same &= F.col(k).eqNullSafe(F.col(f"__k{n}"))
    return kept.join(dealt, same).select(*[F.col(f"__c{cols.index(c)}").alias(c) if c in cols else c for c in rows.columns])


def displaced(rows: DataFrame, col: str, by: str, *, share: float = 0.02, seed: int = 1) -> DataFrame:
    """``col`` moved by a seeded factor within 1 +- ``share``, from a hash of ``by``; no shuffle."""
    u = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(by).cast("string"))), 1, 8), 16, 10).cast("double") / 4294967295.0
    return rows.withColumn(col, F.col(col) * (1 + share * (2 * u - 1)))


def haircut(tests: DataFrame, p: str, *, key: list[str]) -> DataFrame:
    """Bonferroni, Holm and BHY adjusted p-values over all rows of a key; null p-values come last, equal ones get equal results.

    The sum of 1 / i over a key is the last of its running sums, and all frames run on from
    an end (BHY's from the largest p), so a key costs in proportion to its rows.
    """
    w = Window.partitionBy(*key)
    upto = w.orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    after = w.orderBy(F.desc("__i")).rowsBetween(Window.unboundedPreceding, 0)
    t = tests.withColumn("__i", F.row_number().over(w.orderBy(F.col(p).asc_nulls_last())))
    t = t.withColumn("__c", F.sum(1 / F.col("__i")).over(upto)).withColumns({"__m": F.count(F.lit(1)).over(w), "__c": F.max("__c").over(w)})
    t = t.withColumns({"__h": (F.col("__m") - F.col("__i") + 1) * F.col(p), "__y": F.col("__m") * F.col("__c") / F.col("__i") * F.col(p)})
    one = F.lit(1.0)
    t = t.withColumn("p_bonferroni", F.least(one, F.col("__m") * F.col(p))).withColumn("p_holm", F.least(one, F.max("__h").over(upto))).withColumn("p_bhy", F.least(one, F.min("__y").over(after)))
    return t.drop("__m", "__i", "__c", "__h", "__y")


def _draw(kind: str, seed: int, *cols: str) -> Column:
    """A seeded number of 32 bits from a hash of the columns."""
    name = F.concat_ws(":", F.lit(kind), F.lit(seed), *[F.col(c).cast("string") for c in cols])
    return F.conv(F.substring(F.md5(name), 1, 8), 16, 10).cast("long")


def stationary_draws(places: DataFrame, replicates: int, *, key: list[str], at: str, n: str, seed: int = 1, permute: bool = False) -> DataFrame:
    """(key, replicate, p, at): the rows that each replicate takes, in order.

    ``places`` holds the places 0 .. n - 1 of each key. Blocks of geometric length with
    mean n^(1/3) start at random places and wrap round (stationary bootstrap); with
    ``permute`` every place is taken once, in random order. All draws are hashes of
    (seed, key, replicate, place), made where the rows are.
    """
    d = places.select(*key, F.col(n).alias("__n"), F.col(at).alias("p")).withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    w = Window.partitionBy(*key, "replicate")
    if permute:
        order = w.orderBy(_draw("p", seed, *key, "replicate", "p"), "p")
        return d.withColumn("at", (F.row_number().over(order) - 1).cast("long")).select(*key, "replicate", "p", "at")
    fresh = (F.col("p") == 0) | (_draw("b", seed, *key, "replicate", "p") / 4294967296.0 < 1 / F.greatest(F.lit(1.0), F.pow(F.col("__n"), F.lit(1 / 3))))
    start = F.when(fresh, F.struct(F.col("p").alias("p"), (_draw("s", seed, *key, "replicate", "p") % F.col("__n")).alias("s")))
    last = F.last(start, ignorenulls=True).over(w.orderBy("p").rowsBetween(Window.unboundedPreceding, 0))
    d = d.withColumn("__b", last)
    return d.select(*key, "replicate", "p", ((F.col("__b.s") + F.col("p") - F.col("__b.p")) % F.col("__n")).alias("at"))


def _numbered(rows: DataFrame, order: list[str], key: list[str]) -> DataFrame:
    """``rows`` with __at, 0, 1, ... in order, and __n per key."""
    w = Window.partitionBy(*key)
    return rows.withColumns({"__at": F.row_number().over(w.orderBy(*order)).cast("long") - 1, "__n": F.count(F.lit(1)).over(w)})


def bootstrap_by_key(
    returns: DataFrame, r: str, order: list[str], replicates: int, ppy: float, *, key: list[str], seed: int = 1, permute: bool = False, centre: bool = False
) -> DataFrame:
    """(key, replicate, sharpe, sortino, total_return, max_drawdown) of every key's series, resampled on Spark.

    ``permute`` shuffles instead (the permutation null: only path measures move);
    ``centre`` takes the mean off first, for a null of no skill. Null keys are kept apart.
    """
    names = [f"__k{i}" for i in range(len(key))]
    rows = _numbered(returns.where(F.col(r).isNotNull()).select(*[F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(c) for k, c in zip(key, names)], *order, F.col(r).cast("double").alias("__x"), *[F.col(k).alias(f"__v{i}") for i, k in enumerate(key)]), order, names)
    if centre:
        rows = rows.withColumn("__x", F.col("__x") - F.avg("__x").over(Window.partitionBy(*names)))
    draws = stationary_draws(rows, replicates, key=names, at="__at", n="__n", seed=seed, permute=permute)
    drawn = draws.join(rows.select(*names, F.col("__at").alias("at"), "__x", *[f"__v{i}" for i in range(len(key))]), [*names, "at"])
    upto = Window.partitionBy(*names, "replicate").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    drawn = drawn.withColumn("__e", F.product(1 + F.col("__x")).over(upto))
    drawn = drawn.withColumn("__d", 1 - F.col("__e") / F.greatest(F.lit(1.0), F.max("__e").over(upto)))
    x = F.col("__x")
    sd, down = F.stddev_samp(x), F.stddev_samp(F.when(x < 0, x))
    out = drawn.groupBy(*names, "replicate").agg(
        F.when(sd > 0, F.avg(x) / sd * math.sqrt(ppy)).otherwise(0.0).alias("sharpe"), F.when(down > 0, F.avg(x) / down * math.sqrt(ppy)).alias("sortino"), (F.product(1 + x) - 1).alias("total_return"), F.max("__d").alias("max_drawdown"),
        *[F.first(f"__v{i}").alias(k) for i, k in enumerate(key)],
    )
    return out.select(*key, "replicate", "sharpe", "sortino", "total_return", "max_drawdown")


def null_p_value(replicates: DataFrame, x: str, observed: DataFrame, *, key: list[str]) -> DataFrame:
    """(key, observed, p): (1 + replicates at or above the observed value) / (1 + replicates)."""
    j = replicates.join(observed.select(*key, F.col(x).alias("__o")), key)
    return j.groupBy(*key).agg(F.first("__o").alias("observed"), ((F.count(F.when(F.col(x) >= F.col("__o"), 1)) + 1) / (F.count(F.lit(1)) + 1)).alias("p"))


def interval(replicates: DataFrame, x: str, level: float = 0.95, key: tuple[str, ...] | list[str] = ()) -> DataFrame:
    a = (1 - level) / 2
    return replicates.groupBy(*key).agg(F.percentile(x, F.lit(a)).alias("lo"), F.percentile(x, F.lit(0.5)).alias("median"), F.percentile(x, F.lit(1 - a)).alias("hi"), F.count(x).alias("n"))


def reality_check(returns: DataFrame, strategy: str, r: str, ts: str, replicates: int, *, seed: int = 1) -> DataFrame:
    """White, superior-predictive-ability (masks and centrings) and step-down p-values from joint resamples.

    ``p_spa_lower`` takes the largest studentised resample over all strategies, ``p_spa`` over those
    with t at or over -sqrt(2 ln ln n), ``p_spa_upper`` over those with a mean of 0 or more, so
    lower >= spa >= upper. ``p_hansen_lower``, ``p_hansen`` and ``p_hansen_upper`` keep all strategies and
    shift poor ones by their t instead (Hansen 2005), so lower <= hansen <= upper.
    ``returns`` is long: (strategy, ts, r); times that miss a strategy are left out.
    Replicates draw times, so strategies keep their dependence. p-values are
    (k + 1) / (replicates + 1). (strategy, mean, t, p_reality, p_spa_lower, p_spa,
    p_spa_upper, p_hansen_lower, p_hansen, p_hansen_upper, p_step).
    """
    x = returns.where(F.col(r).isNotNull()).groupBy(F.col(ts).alias("__ts"), F.col(strategy).alias("strategy")).agg(F.first(r).cast("double").alias("x"))
    m = x.select("strategy").distinct().count()
    times = x.groupBy("__ts").agg(F.count(F.lit(1)).alias("__m")).where(F.col("__m") == m).select("__ts")
    times = _numbered(times, ["__ts"], [])  # one narrow row a time
    rows = x.join(times, "__ts")
    means = rows.groupBy("strategy").agg(F.avg("x").alias("mean"), F.count(F.lit(1)).alias("n"))
    draws = stationary_draws(times, replicates, key=[], at="__at", n="__n", seed=seed)
    drawn = draws.join(rows.select(F.col("__at").alias("at"), "strategy", "x"), "at").groupBy("strategy", "replicate").agg(F.avg("x").alias("y"))
    d = drawn.join(means, "strategy").withColumn("d", F.sqrt("n") * (F.col("y") - F.col("mean")))
    sds = d.groupBy("strategy").agg(F.greatest(F.lit(1e-12), F.stddev_samp("d")).alias("s"))
    one = means.join(sds, "strategy").withColumns({"v": F.sqrt("n") * F.col("mean"), "t": F.sqrt("n") * F.col("mean") / F.col("s")})
    bound = -F.sqrt(2 * F.log(F.log(F.greatest(F.col("n"), F.lit(16)))))
    one = one.withColumns({
        "shift_lower": F.least("t", F.lit(0.0)), "shift": F.when(F.col("t") <= bound, F.col("t")).otherwise(0.0),
        "fair": F.col("t") >= -F.sqrt(2 * F.log(F.greatest(F.lit(1.0), F.log(F.greatest(F.col("n"), F.lit(3)))))),
        "rank": F.row_number().over(Window.orderBy(F.col("t").desc(), "strategy")),  # one row a strategy
    })
    z = d.select("strategy", "replicate", "d").join(one, "strategy").withColumn("z", F.col("d") / F.col("s"))
    zero = F.lit(0.0)
    best = z.groupBy("replicate").agg(
        F.max("d").alias("b"), F.greatest(zero, F.max(F.col("z") + F.col("shift_lower"))).alias("b_lower"), F.greatest(zero, F.max(F.col("z") + F.col("shift"))).alias("b_mid"), F.greatest(zero, F.max("z")).alias("b_upper"), F.max("v").alias("v"),
        F.greatest(zero, F.max("t")).alias("t_best"), F.max("z").alias("m_all"), F.max(F.when(F.col("fair"), F.col("z"))).alias("m_fair"), F.max(F.when(F.col("mean") >= 0, F.col("z"))).alias("m_good"),
        F.max("t").alias("t_max"),
    )
    p = lambda hit: (F.count(F.when(hit, 1)) + 1) / (F.count(F.lit(1)) + 1)
    joint = best.agg(
        p(F.col("b") >= F.col("v")).alias("p_reality"), p(F.col("b_lower") >= F.col("t_best")).alias("p_hansen_lower"), p(F.col("b_mid") >= F.col("t_best")).alias("p_hansen"),
        p(F.col("b_upper") >= F.col("t_best")).alias("p_hansen_upper"), p(F.col("m_all") >= F.col("t_max")).alias("p_spa_lower"), p(F.col("m_fair") >= F.col("t_max")).alias("p_spa"),
        p(F.col("m_good") >= F.col("t_max")).alias("p_spa_upper"),
    )
    rest = Window.partitionBy("replicate").orderBy(F.desc("rank")).rowsBetween(Window.unboundedPreceding, 0)
    step = z.withColumn("__b", F.max("z").over(rest)).groupBy("strategy", "rank").agg(p(F.col("__b") >= F.col("t")).alias("__p"))
    step = step.withColumn("p_step", F.max("__p").over(Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    out = one.select("strategy", "mean", "t").join(step.select("strategy", "p_step"), "strategy").join(F.broadcast(joint))
    return out.select("strategy", "mean", "t", "p_reality", "p_spa_lower", "p_spa", "p_spa_upper", "p_hansen_lower", "p_hansen", "p_hansen_upper", "p_step")


def cluster_bootstrap(groups: DataFrame, replicates: int, *, order: list[str], seed: int = 1) -> DataFrame:
    """(replicate, mean) resampling whole groups by their sums ``s`` and counts ``n``; one narrow row a group."""
    rows = _numbered(groups.select(*order, "s", F.col("n").alias("c")), order, [])
    d = rows.select(F.col("__at").alias("p"), "__n").withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    d = d.withColumn("at", _draw("c", seed, "replicate", "p") % F.col("__n"))
    j = d.join(rows.select(F.col("__at").alias("at"), "s", "c"), "at")
    return j.groupBy("replicate").agg((F.sum("s") / F.sum("c")).alias("mean"))
