"""Rolling, cross-sectional and rank windows; all are Column expressions or lazy frames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tidemark.operators.grid import ordered, up_to_now


def last_k(k: int, key: list[str], ts: str = "ts") -> WindowSpec:
    return ordered(key, ts).rowsBetween(-(k - 1), 0)


def rolling(fn: Callable[[Column], Column], x: Column, w: WindowSpec, least: int) -> Column:
    """``fn`` over the window once it holds ``least`` non-null values."""
    return F.when(F.count(x).over(w) >= least, fn(x).over(w))


def zscore(x: Column, w: WindowSpec, least: int) -> Column:
    return (x - rolling(F.avg, x, w, least)) / F.nullif(rolling(F.stddev_samp, x, w, least), F.lit(0.0))


def rolling_quantile(x: Column, q: float, w: WindowSpec, least: int) -> Column:
    """Linear-interpolated quantile; exact, O(frame) per row."""
    return rolling(lambda c: F.percentile(c, F.lit(q)), x, w, least)


def rolling_rank_pct(x: Column, w: WindowSpec, least: int) -> Column:
    """Average-tie rank of the last value among the window, over its count."""
    xs = F.collect_list(x).over(w)
    less = F.size(F.filter(xs, lambda v: v < x))
    equal = F.size(F.filter(xs, lambda v: v == x))
    return F.when(F.size(xs) >= least, (less + (equal + 1) / 2) / F.size(xs))


def weighted_average(x: Column, k: int, key: list[str], ts: str = "ts") -> Column:
    """Weights 1..k, the newest heaviest; null until the window is full."""
    xs = F.collect_list(x).over(last_k(k, key, ts))
    total = F.aggregate(F.zip_with(xs, F.sequence(F.lit(1), F.lit(k)), lambda v, i: v * i), F.lit(0.0), lambda a, v: a + v)
    return F.when(F.size(xs) == k, total / (k * (k + 1) / 2))


def mean_abs_deviation(x: Column, w: WindowSpec, k: int) -> Column:
    xs = F.collect_list(x).over(w)
    mean = F.aggregate(xs, F.lit(0.0), lambda a, v: a + v) / F.size(xs)
    return F.when(F.size(xs) == k, F.aggregate(F.transform(xs, lambda v: F.abs(v - mean)), F.lit(0.0), lambda a, v: a + v) / F.size(xs))


def log_return(x: str, key: list[str], ts: str = "ts", k: int = 1) -> Column:
    """ln(x / x[k rows ago]); null unless both are positive."""
    prev = F.lag(x, k).over(ordered(key, ts))
    return F.when((F.col(x) > 0) & (prev > 0), F.log(F.col(x) / prev))


def simple_return(x: str, key: list[str], ts: str = "ts", k: int = 1) -> Column:
    return F.try_divide(F.col(x), F.lag(x, k).over(ordered(key, ts))) - 1


def forward_return(x: str, key: list[str], ts: str = "ts", k: int = 1) -> Column:
    return F.try_divide(F.lead(x, k).over(ordered(key, ts)), F.col(x)) - 1


def running_product(r: Column, key: list[str], ts: str = "ts") -> Column:
    return F.product(1 + F.coalesce(r, F.lit(0.0))).over(up_to_now(key, ts))


def rank_pct(df: DataFrame, x: str, out: str, key: list[str]) -> DataFrame:
    """Average-tie rank within a key over its count of non-null values."""
    w = Window.partitionBy(*key).orderBy(x)
    same = Window.partitionBy(*key, x)
    n = F.count(x).over(Window.partitionBy(*key))
    nulls = F.count(F.lit(1)).over(Window.partitionBy(*key)) - n
    return df.withColumn(out, F.when(F.col(x).isNotNull(), (F.rank().over(w) - nulls + (F.count(F.lit(1)).over(same) - 1) / 2) / n))


def quantile_cut(df: DataFrame, x: str, n: int, out: str, key: list[str]) -> DataFrame:
    """Bin 0..n-1 by value cut points of each key; right-closed, equal edges merge."""
    qs = [i / n for i in range(n + 1)]
    edges = df.groupBy(*key).agg(F.array_distinct(F.percentile(x, F.array(*[F.lit(q) for q in qs]))).alias("__e"))
    joined = df.join(edges, key) if key else df.join(F.broadcast(edges))
    inner = F.slice("__e", 2, F.greatest(F.size("__e") - 2, F.lit(0)))
    return joined.withColumn(out, F.when(F.col(x).isNotNull(), F.size(F.filter(inner, lambda e: F.col(x) > e)))).drop("__e")


def fixed_cut(x: Column, edges: list[float]) -> Column:
    """Bin i for edges[i] < x <= edges[i+1]; null outside."""
    out = F.lit(None).cast("int")
    for i in range(len(edges) - 2, -1, -1):
        out = F.when((x > edges[i]) & (x <= edges[i + 1]), i).otherwise(out)
    return out


def runs(df: DataFrame, flag: str, out: str, key: list[str], ts: str = "ts") -> DataFrame:
    """Number of the run of equal ``flag`` values a row lies in, from 1."""
    w = ordered(key, ts)
    change = F.when(F.lag(flag).over(w).eqNullSafe(F.col(flag)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return df.withColumn("__ch", change).withColumn(out, F.sum("__ch").over(up_to_now(key, ts))).drop("__ch")


def swing_points(df: DataFrame, k: int, key: list[str], ts: str = "ts", high: str = "high", low: str = "low") -> DataFrame:
    """Strict, unique extremes of the k rows on both sides; known k rows later."""
    w = ordered(key, ts)
    around = w.rowsBetween(-k, k)
    full = F.count(F.lit(1)).over(around) == 2 * k + 1
    top, bottom = F.max(high).over(around), F.min(low).over(around)
    out = df.withColumns({"__top": top, "__bottom": bottom, "__full": full, "idx": F.row_number().over(w) - 1})
    n_top = F.size(F.filter(F.collect_list(high).over(around), lambda v: v == F.col("__top")))
    n_bottom = F.size(F.filter(F.collect_list(low).over(around), lambda v: v == F.col("__bottom")))
    out = out.withColumn("is_high", F.col("__full") & (F.col(high) == F.col("__top")) & (n_top == 1))
    out = out.withColumn("is_low", F.col("__full") & (F.col(low) == F.col("__bottom")) & (n_bottom == 1))
    return out.withColumn("confirmed_idx", F.col("idx") + k).drop("__top", "__bottom", "__full")


def cross_section(df: DataFrame, x: str, ts: str = "ts", least: int = 1) -> DataFrame:
    """Mean, sample deviation, z and median of ``x`` over all keys at a time."""
    w = Window.partitionBy(ts)
    n = F.count(x).over(w)
    ok = lambda c: F.when(n >= least, c)
    out = df.withColumns({"cs_mean": ok(F.avg(x).over(w)), "cs_std": ok(F.stddev_samp(x).over(w)), "cs_median": ok(F.percentile(x, F.lit(0.5)).over(w))})
    return out.withColumn("cs_z", (F.col(x) - F.col("cs_mean")) / F.nullif(F.col("cs_std"), F.lit(0.0)))


def long_short_ranks(df: DataFrame, x: str, k: int, every: int, *, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Top k long and bottom k short with 0.5 / k each, set every ``every`` times, held between."""
    times = df.select(ts).distinct().withColumn("__i", F.row_number().over(Window.orderBy(ts)) - 1)
    at = df.where(F.col(x).isNotNull()).join(times.where(F.col("__i") % every == 0), ts)
    up = F.row_number().over(Window.partitionBy(ts).orderBy(F.col(x).desc(), key))
    down = F.row_number().over(Window.partitionBy(ts).orderBy(F.col(x).asc(), key))
    n = F.count(F.lit(1)).over(Window.partitionBy(ts))
    legs = at.select(key, ts, F.when(n < 2 * k, 0.0).when(up <= k, 0.5 / k).when(down <= k, -0.5 / k).otherwise(0.0).alias("__pos"))
    held = df.join(times, ts).join(legs, [key, ts], "left")
    held = held.withColumn("__pos", F.when((F.col("__i") % every == 0) & F.col("__pos").isNull(), 0.0).otherwise(F.col("__pos")))
    pos = F.coalesce(F.last("__pos", ignorenulls=True).over(up_to_now([key], ts)), F.lit(0.0))
    return held.withColumn("position", pos).drop("__i", "__pos")


def gross_cap(df: DataFrame, cap: float, *, position: str = "position", ts: str = "ts") -> DataFrame:
    """Positions scaled so that their absolute sum at a time stays within ``cap``."""
    gross = F.sum(F.abs(position)).over(Window.partitionBy(ts))
    return df.withColumn(position, F.col(position) * F.least(F.lit(1.0), F.coalesce(F.try_divide(F.lit(cap), gross), F.lit(1.0))))


def leave_one_out_index(bars: DataFrame, k: int, *, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Per bar: the other symbols' return, weighted by lagged rolling dollar volume."""
    w = last_k(k, [key], ts)
    out = bars.withColumn("r", log_return("close", [key], ts)).withColumn("dv", F.sum(F.col("close") * F.col("volume")).over(w))
    out = out.withColumn("dv", F.lag("dv").over(ordered([key], ts))).where("r IS NOT NULL AND dv IS NOT NULL")
    at = Window.partitionBy(ts)
    out = out.withColumn("weight", F.try_divide(F.col("dv"), F.sum("dv").over(at)))
    total = F.sum(F.col("weight") * F.col("r")).over(at)
    return out.withColumn("others", F.try_divide(total - F.col("weight") * F.col("r"), 1 - F.col("weight")))


def top_k(df: DataFrame, by: list[Column], k: int, key: list[str]) -> DataFrame:
    """First k rows of each key in the given order."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(*by))).where(F.col("rank") <= k)


def every_kth(df: DataFrame, k: int, key: list[str], ts: str = "ts") -> DataFrame:
    """Rows 0, k, 2k, ... of each key."""
    return df.withColumn("__i", F.row_number().over(ordered(key, ts)) - 1).where(F.col("__i") % k == 0).drop("__i")
