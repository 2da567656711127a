"""From positions to returns, equity, trades and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.grid import ordered, up_to_now
from tidemark.operators.joins import asof_join, reindex_ffill
from tidemark.operators.rolling import last_k, running_product, runs


def densify(bars: DataFrame, signals: DataFrame, *, key: list[str], ts: str = "ts", seq: str | None = None, lo: float = -1.0, hi: float = 1.0) -> DataFrame:
    """Positions on every bar: the last signal at a time wins, held forward, 0 at the head, clipped."""
    w = Window.partitionBy(*key, ts).orderBy(F.col(seq).desc() if seq else F.col("position").desc())
    one = signals.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*key, ts, "position")
    held = reindex_ffill(bars, one, ["position"], key=key, ts=ts)
    return held.withColumn("position", F.greatest(F.lit(lo), F.least(F.lit(hi), F.coalesce("position", F.lit(0.0)))))


def zero_stale(df: DataFrame, seconds: int, *, position: str = "position", price: str = "close", key: list[str], ts: str = "ts") -> DataFrame:
    """No position where the last price is older than ``seconds``."""
    last = F.last(F.when(F.col(price).isNotNull(), F.unix_timestamp(ts)), ignorenulls=True).over(up_to_now(key, ts))
    return df.withColumn(position, F.when(F.unix_timestamp(ts) - last <= seconds, F.col(position)).otherwise(0.0))


def account(df: DataFrame, cost: float | Column = 0.0, *, position: str = "position", price: str = "close", key: list[str], ts: str = "ts") -> DataFrame:
    """net = position before * return - |change| * cost; equity compounds it from 1.

    Positions of this bar earn from the next bar on.
    """
    w = ordered(key, ts)
    r = F.coalesce(F.try_divide(F.col(price), F.lag(price).over(w)) - 1, F.lit(0.0))
    moved = F.abs(F.col(position) - F.lag(position, 1, 0.0).over(w))
    df = df.withColumns({"gross": F.lag(position, 1, 0.0).over(w) * r, "cost": moved * (F.lit(cost) if isinstance(cost, float) else cost)})
    df = df.withColumn("net", F.col("gross") - F.col("cost"))
    return df.withColumn("equity", running_product(F.col("net"), key, ts))


def round_trips(df: DataFrame, *, position: str = "position", ret: str = "net", key: list[str], ts: str = "ts") -> DataFrame:
    """One row per stretch of equal non-zero position: times, direction, bars, compounded pnl."""
    r = runs(df, position, "__run", key, ts).where(F.col(position) != 0)
    return r.groupBy(*key, "__run").agg(
        F.min(ts).alias("entry"), F.max(ts).alias("exit"), F.first(position).alias("position"), F.count(F.lit(1)).alias("bars"), (F.product(1 + F.col(ret)) - 1).alias("pnl"),
    ).drop("__run").withColumn("direction", F.when(F.col("position") > 0, "long").otherwise("short"))


def funding_cashflow(funding: DataFrame, bars: DataFrame, *, key: list[str], ts: str = "ts", notional: str = "notional", rate: str = "rate") -> DataFrame:
    """Cash paid at each funding time on the notional held by then, with its running sum."""
    met = asof_join(funding, bars, [notional], key=key, ts=ts, how="inner")
    paid = met.withColumn("paid", F.col(notional) * F.col(rate))
    return paid.withColumn("paid_to_date", F.sum("paid").over(up_to_now(key, ts)))


def spot_hedge(df: DataFrame, cost: float, *, notional: str = "notional", price: str = "close", key: list[str], ts: str = "ts") -> DataFrame:
    """Profit and cost of a spot leg that mirrors the notional."""
    w = ordered(key, ts)
    r = F.coalesce(F.try_divide(F.col(price), F.lag(price).over(w)) - 1, F.lit(0.0))
    return df.withColumns({"hedge_pnl": -F.coalesce(F.lag(notional).over(w), F.lit(0.0)) * r, "hedge_cost": F.abs(F.col(notional) - F.coalesce(F.lag(notional).over(w), F.lit(0.0))) * cost})


def cost_bps(df: DataFrame, *, base: float, spread: str | None = None, order: float = 0.0, k: float = 0.0, cap: float = 50.0, floor: float = 0.5, depth_bars: int = 60, key: list[str], ts: str = "ts") -> DataFrame:
    """Cost per side: flat fee, half the spread, and impact k * order / rolling depth, clipped.

    Depth only looks back; where it is missing at the head the floor applies.
    """
    depth = F.avg(F.col("close") * F.col("volume")).over(last_k(depth_bars, key, ts))
    half = F.coalesce(F.col(spread) / 2, F.lit(0.0)) if spread else F.lit(0.0)
    impact = F.coalesce(k * order / F.nullif(depth, F.lit(0.0)), F.lit(0.0))
    return df.withColumn("cost_bps", F.greatest(F.lit(floor), F.least(F.lit(cap), base + half + impact)))


def benchmark(bars: DataFrame, *, key: str = "symbol", ts: str = "ts", price: str = "close") -> DataFrame:
    """Equal-weight buy and hold: mean over symbols of price over first price."""
    first = F.first(price).over(up_to_now([key], ts))
    return bars.withColumn("__g", F.try_divide(F.col(price), first)).groupBy(ts).agg(F.avg("__g").alias("benchmark"))


def leverage_grid(returns: DataFrame, r: str, levels: list[float], *, key: list[str], ts: str = "ts") -> DataFrame:
    """Growth of 1 under each leverage; once at or below 0 it stays 0."""
    d = returns.withColumn("leverage", F.explode(F.array(*[F.lit(x) for x in levels])))
    k = [*key, "leverage"]
    g = 1 + F.col("leverage") * F.coalesce(F.col(r), F.lit(0.0))
    d = d.withColumn("__g", g).withColumn("__dead", F.max((F.col("__g") <= 0).cast("int")).over(up_to_now(k, ts)))
    live = F.product(F.when(F.col("__g") > 0, F.col("__g")).otherwise(1.0)).over(up_to_now(k, ts))
    return d.withColumn("value", F.when(F.col("__dead") == 1, 0.0).otherwise(live)).drop("__g", "__dead")


def portfolio(equity: DataFrame, capital: DataFrame, *, key: str = "strategy", ts: str = "ts") -> DataFrame:
    """Capital-weighted sum of daily strategy equities, aligned forward, then backward at the head."""
    from tidemark.operators.joins import outer_align

    day = equity.groupBy(key, F.date_trunc("day", ts).alias(ts)).agg(F.max_by("equity", ts).alias("equity"))
    start = day.groupBy(key).agg(F.min_by("equity", ts).alias("__e0"))
    scaled = day.join(start, key).join(capital, key).withColumn("value", F.col("equity") / F.col("__e0") * F.col("capital"))
    return outer_align(scaled.select(key, ts, "value"), "value", key=key, ts=ts).groupBy(ts).agg(F.sum("value").alias("value"))
