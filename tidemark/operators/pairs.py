"""Pairs: spreads, cointegration measures and their calibration."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.inference import normal_cdf
from tidemark.operators.joins import symbol_pairs


def pair_regression(prices: DataFrame, value: str = "lp", *, extra: list[str] | None = None, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Slope, intercept, R2 and population residual deviation of va on vb, by pair."""
    return regress(symbol_pairs(prices, value, key=key, ts=ts), extra or [])


def regress(pairs: DataFrame, extra: list[str]) -> DataFrame:
    g = pairs.groupBy("a", "b", *extra).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope("va", "vb").alias("beta"), F.regr_intercept("va", "vb").alias("alpha"), F.regr_r2("va", "vb").alias("r2"), F.var_pop("va").alias("__v"),
    )
    return g.withColumn("resid_sd", F.sqrt(F.greatest(F.lit(0.0), F.col("__v") * (1 - F.col("r2"))))).drop("__v")


def residuals(pairs: DataFrame, fits: DataFrame, *, on: list[str]) -> DataFrame:
    return pairs.join(fits.select(*on, "alpha", "beta", "resid_sd"), on).withColumn("resid", F.col("va") - F.col("alpha") - F.col("beta") * F.col("vb"))


def dickey_fuller(resid: DataFrame, x: str, *, key: list[str], ts: str = "ts") -> DataFrame:
    """(key, n, rho, t, half_life): change on level with a constant, from sums.

    ``rho`` is the slope, the coefficient of the residual on itself less one, and ``t`` its t
    with n - 2 degrees of freedom; half-life is ln 0.5 / ln(1 + rho) rows where -1 < rho < 0.
    """
    w = Window.partitionBy(*key).orderBy(ts)
    d = resid.withColumn("__l", F.lag(x).over(w)).where(F.col("__l").isNotNull() & F.col(x).isNotNull()).withColumn("__d", F.col(x) - F.col("__l"))
    s = d.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.regr_sxx("__d", "__l").alias("__sxx"), F.regr_sxy("__d", "__l").alias("__sxy"), F.regr_syy("__d", "__l").alias("__syy"))
    s = s.withColumn("rho", F.col("__sxy") / F.nullif(F.col("__sxx"), F.lit(0.0)))
    s2 = (F.col("__syy") - F.col("rho") * F.col("__sxy")) / F.nullif(F.col("n") - 2, F.lit(0))
    s = s.withColumn("t", F.col("rho") / F.nullif(F.sqrt(s2 / F.nullif(F.col("__sxx"), F.lit(0.0))), F.lit(0.0)))
    return s.withColumn("half_life", F.when((F.col("rho") < 0) & (F.col("rho") > -1), -F.log(F.lit(2.0)) / F.log(1 + F.col("rho")))).drop("__sxx", "__sxy", "__syy")


def unit_root_lags(resid: DataFrame, x: str, lags: int, *, key: list[str], ts: str = "ts") -> DataFrame:
    """(key, n, rho, t, p): augmented Dickey-Fuller with a constant and ``lags`` lagged changes.

    Each row adds to the Gram matrix of (1, level, lagged changes, change), sums that merge in
    any order; one small system is solved for each key. ``p`` is MacKinnon's (1994) approximation for
    one series with a constant. Keys with no more rows than coefficients give null statistics.
    """
    w = Window.partitionBy(*key).orderBy(ts)
    d = resid.where(F.col(x).isNotNull()).select(*key, ts, F.col(x).cast("double").alias("__x"))
    d = d.withColumn("__x", F.col("__x") - F.avg("__x").over(Window.partitionBy(*key)))
    d = d.withColumns({"__l": F.lag("__x").over(w)}).withColumn("__d", F.col("__x") - F.col("__l"))
    names = ["__l", *[f"__d{j}" for j in range(1, lags + 1)], "__d"]
    d = d.withColumns({f"__d{j}": F.lag("__d", j).over(w) for j in range(1, lags + 1)}).where(F.col(names[-2]).isNotNull())
    k = len(names)
    terms = [F.lit(1.0), *[F.col(c) for c in names]]
    cells = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    g = d.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(terms[i] * terms[j]) for i, j in cells]).alias("__g"))
    schema = T.StructType([*[f for f in g.schema.fields if f.name != "__g"], *[T.StructField(c, T.DoubleType()) for c in ("rho", "t")]])

    def solve(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            rho, t = [], []
            for n, cells_of in zip(pdf["n"], pdf["__g"]):
                m = np.zeros((k + 1, k + 1))
                for (i, j), v in zip(cells, cells_of):
                    m[i, j] = m[j, i] = v
                free = n - k
                if free <= 0 or np.linalg.matrix_rank(m[:k, :k]) < k:
                    rho.append(None)
                    t.append(None)
                    continue
                inverse = np.linalg.inv(m[:k, :k])
                beta = inverse @ m[:k, k]
                s2 = max(0.0, m[k, k] - beta @ m[:k, k]) / free
                rho.append(float(beta[1]))
                t.append(float(beta[1] / np.sqrt(s2 * inverse[1, 1])) if s2 > 0 else None)
            yield pdf.drop(columns="__g").assign(rho=pd.array(rho, "Float64"), t=pd.array(t, "Float64"))

    return g.mapInPandas(solve, schema).withColumn("p", unit_root_p(F.col("t")))


#: MacKinnon (1994), one series with a constant: bounds of t, where the two polynomials meet, and their coefficients.
_T_LEAST, _T_MOST, _T_MEET = -18.83, 2.74, -1.61
_P_LOW = [2.1659, 1.4412, 0.038269]
_P_HIGH = [1.7339, 0.93202, -0.12745, -0.010368]


def unit_root_p(t: Column) -> Column:
    """Approximate p-value of a unit-root t."""
    poly = lambda c: sum((F.lit(v) * F.pow(t, F.lit(float(i))) for i, v in enumerate(c)), F.lit(0.0))
    return F.when(t > _T_MOST, 1.0).when(t < _T_LEAST, 0.0).when(t <= _T_MEET, normal_cdf(poly(_P_LOW))).when(t > _T_MEET, normal_cdf(poly(_P_HIGH)))


def half_life(df: DataFrame, x: str, *, key: list[str], ts: str = "ts") -> DataFrame:
    """-ln 2 / ln(1 + slope of change on level), with a constant."""
    w = Window.partitionBy(*key).orderBy(ts)
    d = df.withColumn("__l", F.lag(x).over(w)).withColumn("__d", F.col(x) - F.col("__l"))
    g = d.groupBy(*key).agg(F.regr_slope("__d", "__l").alias("slope"))
    return g.withColumn("half_life", F.when((F.col("slope") < 0) & (F.col("slope") > -1), -F.log(F.lit(2.0)) / F.log(1 + F.col("slope"))))


def shuffled_panel(prices: DataFrame, r: str, seed: int, *, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Each key's returns in a seeded order on its own times: marginals stay, links go."""
    at = prices.where(F.col(r).isNotNull()).withColumn("__i", F.row_number().over(Window.partitionBy(key).orderBy(ts)))
    mixed = at.select(key, F.col(r).alias("shuffled"), F.row_number().over(Window.partitionBy(key).orderBy(F.md5(F.concat_ws(":", F.lit(seed), F.unix_timestamp(ts), key)), ts)).alias("__i"))
    out = at.select(key, ts, "__i").join(mixed, [key, "__i"]).drop("__i")
    return out.withColumn("lp", F.sum("shuffled").over(Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)))


def trailing_refit(pairs: DataFrame, days: int, *, ts: str = "ts", least: int = 20) -> DataFrame:
    """Residual and z of each day's rows under the regression of the ``days`` days before it.

    A day of a pair is one row of sums about the pair's means; a fit adds the sums of its days,
    so no row is copied. Days with under ``least`` rows before them have no fit.
    """
    day = F.floor(F.unix_timestamp(ts) / 86_400)
    centre = pairs.groupBy("a", "b").agg(F.avg("va").alias("__ma"), F.avg("vb").alias("__mb"))
    rows = pairs.withColumn("__d", day)
    y, x = F.col("va") - F.col("__ma"), F.col("vb") - F.col("__mb")
    sums = rows.join(centre, ["a", "b"]).where("va IS NOT NULL AND vb IS NOT NULL").groupBy("a", "b", "__d").agg(
        F.count(F.lit(1)).alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * x).alias("sxx"), F.sum(x * y).alias("sxy"), F.sum(y * y).alias("syy"), F.first("__ma").alias("__ma"), F.first("__mb").alias("__mb"),
    )
    asked = rows.select("a", "b", "__d").distinct()
    past = Window.partitionBy("a", "b").orderBy("__d").rangeBetween(-days, -1)
    total = asked.join(sums, ["a", "b", "__d"], "left")
    total = total.select("a", "b", "__d", *[F.sum(c).over(past).alias(c) for c in ("n", "sx", "sy", "sxx", "sxy", "syy")], *[F.max(c).over(Window.partitionBy("a", "b")).alias(c) for c in ("__ma", "__mb")])
    n, sxx = F.col("n"), F.col("sxx") - F.col("sx") * F.col("sx") / F.col("n")
    sxy, syy = F.col("sxy") - F.col("sx") * F.col("sy") / n, F.col("syy") - F.col("sy") * F.col("sy") / n
    fits = total.where(n >= least).withColumn("beta", sxy / F.nullif(sxx, F.lit(0.0)))
    fits = fits.withColumns({"alpha": F.col("__ma") + F.col("sy") / n - F.col("beta") * (F.col("__mb") + F.col("sx") / n), "resid_sd": F.sqrt(F.greatest(F.lit(0.0), syy - F.col("beta") * sxy) / n)})
    rows = rows.join(fits.select("a", "b", "__d", "alpha", "beta", "resid_sd"), ["a", "b", "__d"])
    resid = F.col("va") - F.col("alpha") - F.col("beta") * F.col("vb")
    return rows.withColumn("resid", resid).withColumn("z", resid / F.nullif(F.col("resid_sd"), F.lit(0.0))).drop("__d")


def funding_index(bars: DataFrame, funding: DataFrame, *, key: str = "symbol", ts: str = "ts", rate: str = "rate") -> DataFrame:
    """``bars`` with ``funding_paid``: what a long position has paid by each bar."""
    from tidemark.operators.joins import asof_join

    w = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    paid = funding.withColumn("funding_paid", F.sum(rate).over(w))
    return asof_join(bars, paid.select(key, ts, "funding_paid"), ["funding_paid"], key=[key], ts=ts).withColumn("funding_paid", F.coalesce("funding_paid", F.lit(0.0)))


def weighted_spread(prices: DataFrame, weights: dict[str, float], x: Column, *, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """(ts, spread): sum of weight times ``x`` over the legs, at times that have all of them."""
    w = F.lit(0.0)
    for leg, v in weights.items():
        w = F.when(F.col(key) == leg, float(v)).otherwise(w)
    g = prices.where(F.col(key).isin(*weights)).groupBy(ts).agg(F.count(x).alias("__n"), F.sum(w * x).alias("spread"))
    return g.where(F.col("__n") == len(weights)).drop("__n")


def null_cutoff(shuffled_stats: DataFrame, q: float) -> DataFrame:
    """The q-quantile of a statistic under the shuffled panel."""
    return shuffled_stats.agg(F.percentile("t", F.lit(q)).alias("cutoff"))


def reversion_curve(resid: DataFrame, z: str, horizons: list[int], width: float, *, key: list[str], ts: str = "ts") -> DataFrame:
    """Mean forward move of the residual by z bin and horizon."""
    w = Window.partitionBy(*key).orderBy(ts)
    d = resid.withColumn("bin", F.floor(F.col(z) / width).cast("int"))
    d = d.withColumns({f"__m{h}": F.lead("resid", h).over(w) - F.col("resid") for h in horizons})
    one = d.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), *[F.avg(f"__m{h}").alias(f"m{h}") for h in horizons])
    return one.select("bin", "n", F.explode(F.array(*[F.struct(F.lit(h).alias("horizon"), F.col(f"m{h}").alias("move")) for h in horizons])).alias("e")).select("bin", "n", "e.*")


def persistence(selected: DataFrame, k: int, *, on: list[str] = ["a", "b"], window: str = "w") -> DataFrame:  # noqa: B006
    """Share of pairs chosen in a window that are chosen again k windows later, and the base rate."""
    later = selected.select(*on, (F.col(window) - k).alias(window), F.col("chosen").alias("again"))
    both = selected.join(later, [*on, window])
    return both.agg(F.avg(F.when(F.col("chosen"), F.col("again").cast("double"))).alias("survival"), F.avg(F.col("again").cast("double")).alias("base_rate"), F.count(F.lit(1)).alias("n"))


def pair_trades(resid: DataFrame, z: str, entry: float, target: float, stop: float, most: int, *, key: list[str], ts: str = "ts") -> DataFrame:
    """Non-overlapping trades on |z| >= entry, left at target, stop or after ``most`` rows."""
    from pyspark.sql import types as T

    from tidemark.operators.scans import ordered_scan

    def machine():
        s = {"side": 0, "n": 0, "x0": 0.0, "trade": 0}

        def step(zv, x):
            if s["side"]:
                s["n"] += 1
                if zv is not None and (abs(zv) <= target or abs(zv) >= stop or s["n"] >= most or zv * s["side"] > 0):
                    pnl, s["side"] = (x - s["x0"]) * s["was"], 0
                    return (s["trade"], pnl, s["n"])
            elif zv is not None and entry <= abs(zv) < stop:
                s.update(side=-1 if zv > 0 else 1, was=-1.0 if zv > 0 else 1.0, n=0, x0=x, trade=s["trade"] + 1)
            return (None, None, None)

        return step

    out = T.StructType([T.StructField("trade", T.LongType()), T.StructField("pnl", T.DoubleType()), T.StructField("held", T.LongType())])
    return ordered_scan(resid, [ts], [z, "resid"], machine, out, key=key).where("trade IS NOT NULL")


def leave_one_out(trades: DataFrame, pnl: str, group: list[str]) -> DataFrame:
    """Mean pnl without each group, its share, and a t with errors clustered by group."""
    g = trades.groupBy(*group).agg(F.sum(pnl).alias("s"), F.count(pnl).alias("n"))
    total = g.agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"))
    g = g.join(F.broadcast(total)).withColumn("mean", F.col("all_s") / F.col("all_n"))
    se = g.agg((F.sqrt(F.sum(F.pow(F.col("s") - F.col("n") * F.col("mean"), 2))) / F.first("all_n")).alias("se"))
    g = g.join(F.broadcast(se))
    without = (F.col("all_s") - F.col("s")) / F.nullif(F.col("all_n") - F.col("n"), F.lit(0))
    return g.select(*group, "n", without.alias("mean_without"), F.try_divide(F.col("s"), F.abs("all_s")).alias("share"), (F.col("mean") / F.nullif(F.col("se"), F.lit(0.0))).alias("cluster_t"))


def top_pairs(stats: DataFrame, t_cut: Column, lo: float, hi: float, k: int, *, by: str = "t", window: list[str] | None = None) -> DataFrame:
    """Formation rule: t under the cutoff, half-life in a band, the k smallest t."""
    ok = stats.where((F.col(by) <= t_cut) & F.col("half_life").between(lo, hi))
    return ok.withColumn("rank", F.row_number().over(Window.partitionBy(*(window or [F.lit(1)])).orderBy(by, "a", "b"))).where(F.col("rank") <= k)
