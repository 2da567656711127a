"""Order books and trade flow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.grid import ordered, up_to_now


def nested_book(df: DataFrame, depth: int, *, side: str, out: str) -> DataFrame:
    """``{side}_px_i``, ``{side}_sz_i`` columns as one array of (px, sz), missing levels dropped."""
    levels = F.array(*[F.struct(F.col(f"{side}_px_{i}").alias("px"), F.col(f"{side}_sz_{i}").alias("sz")) for i in range(depth)])
    return df.withColumn(out, F.filter(levels, lambda x: x["px"].isNotNull() & x["sz"].isNotNull()))


def wide_book(df: DataFrame, depth: int, *, levels: str, side: str) -> DataFrame:
    at = lambda i, f: F.try_element_at(levels, F.lit(i + 1))[f]
    return df.withColumns({f"{side}_{f}_{i}": at(i, f) for i in range(depth) for f in ("px", "sz")})


def depth(levels: str, n: int) -> Column:
    return F.aggregate(F.slice(levels, 1, n), F.lit(0.0), lambda a, x: a + x["sz"])


def mid(bids: str = "bids", asks: str = "asks") -> Column:
    return (F.col(bids)[0]["px"] + F.col(asks)[0]["px"]) / 2


def spread_bps(bids: str = "bids", asks: str = "asks") -> Column:
    return (F.col(asks)[0]["px"] - F.col(bids)[0]["px"]) / F.nullif(mid(bids, asks), F.lit(0.0)) * 1e4


def imbalance(n: int, bids: str = "bids", asks: str = "asks") -> Column:
    """(bid - ask) / (bid + ask) size over n levels; null without size."""
    b, a = depth(bids, n), depth(asks, n)
    return (b - a) / F.nullif(b + a, F.lit(0.0))


def wall(levels: str, reference: Column, band: float, *, above: bool) -> Column:
    """Size within a band of the reference price."""
    inside = (lambda x: x["px"] <= reference * (1 + band)) if above else (lambda x: x["px"] >= reference * (1 - band))
    return F.aggregate(F.filter(F.col(levels), inside), F.lit(0.0), lambda a, x: a + x["sz"])


def premium_bps(mark: Column, index: Column) -> Column:
    return (mark - index) / F.nullif(index, F.lit(0.0)) * 1e4


def signed_volume(side: str = "side", amount: str = "amount") -> Column:
    return F.when(F.col(side) == "buy", F.col(amount)).when(F.col(side) == "sell", -F.col(amount)).otherwise(F.lit(0.0))


def cumulative_delta(trades: DataFrame, *, key: list[str], ts: str = "ts", side: str = "side", amount: str = "amount") -> DataFrame:
    return trades.withColumn("cvd", F.sum(signed_volume(side, amount)).over(up_to_now(key, ts)))


def regime_label(dp: Column, doi: Column) -> Column:
    """Four labels by the signs of price and open-interest change; zero counts as down."""
    return (
        F.when(dp.isNull() | doi.isNull(), F.lit(None).cast("string"))
        .when((dp > 0) & (doi > 0), "new longs").when((dp > 0), "short covering").when(doi > 0, "new shorts").otherwise("long unwinding")
    )


def plain_symbol(symbol: Column) -> Column:
    """Upper case, without separators."""
    return F.regexp_replace(F.upper(F.trim(symbol)), "[-/_:]", "")


#: The names that users give the four streams.
STREAM_NAMES = {"orderbook": ("orderbook", "book", "ob", "depth"), "trades": ("trades", "trade", "tape"), "ticker": ("ticker", "bbo", "tick"), "liquidations": ("liquidations", "liq", "liqs")}


def stream_name(token: Column) -> Column:
    """Canonical stream of an alias; null where there is none."""
    t = F.lower(F.trim(token))
    out = F.lit(None).cast("string")
    for name, others in STREAM_NAMES.items():
        out = F.when(t.isin(*others), name).otherwise(out)
    return out


def seconds_to_funding(ts: Column, every: int = 28_800) -> Column:
    return F.lit(every) - F.unix_timestamp(ts) % every


def lagged_cross_correlation(df: DataFrame, x: str, y: str, reach: int, *, key: list[str], ts: str = "ts") -> DataFrame:
    """corr(x, y shifted by k) for k = -reach..reach; positive k means x leads."""
    w = ordered(key, ts)
    ks = list(range(-reach, reach + 1))
    wide = df.withColumns({f"__k{i}": F.lead(y, k).over(w) if k >= 0 else F.lag(y, -k).over(w) for i, k in enumerate(ks)})
    one = wide.groupBy(*key).agg(*[F.corr(F.col(x), F.col(f"__k{i}")).alias(f"c{i}") for i in range(len(ks))])
    return one.select(*key, F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"c{i}").alias("corr")) for i, k in enumerate(ks)])).alias("e")).select(*key, "e.*")


def footprint(trades: DataFrame, seconds: int, tick: float, flag: float, *, key: list[str], ts: str = "ts") -> DataFrame:
    """Volume and net delta by time bin and price bin; large deltas are flagged."""
    t = trades.withColumns({"t": (F.floor(F.unix_timestamp(ts) / seconds) * seconds).cast("long"), "px": F.floor(F.col("price") / tick) * tick})
    g = t.groupBy(*key, "t", "px").agg(F.sum("amount").alias("volume"), F.sum(signed_volume()).alias("delta"))
    return g.withColumn("big", F.abs("delta") >= flag)


def heat_grid(books: DataFrame, levels: str, seconds: int, tick: float, *, key: list[str], ts: str = "ts") -> DataFrame:
    """Mean resting size by time bin and price bin."""
    x = books.select(*key, (F.floor(F.unix_timestamp(ts) / seconds) * seconds).cast("long").alias("t"), F.explode(levels).alias("l"))
    return x.groupBy(*key, "t", (F.floor(F.col("l.px") / tick) * tick).alias("px")).agg(F.avg("l.sz").alias("size"))


def force_and_barrier(grid: DataFrame, wall: str, bought: str, k: int, seconds: int, *, key: list[str], ts: str = "ts") -> DataFrame:
    """Rate of buying over the last ``k`` steps and the seconds it needs to eat the wall."""
    w = ordered(key, ts).rowsBetween(-(k - 1), 0)
    rate = F.when(F.count(F.lit(1)).over(w) == k, F.sum(F.coalesce(F.col(bought), F.lit(0.0))).over(w) / (k * seconds))
    return grid.withColumn("buy_rate", rate).withColumn("seconds_to_eat", F.col(wall) / F.nullif(F.col("buy_rate"), F.lit(0.0)))


def feed_statistics(rows: DataFrame, *, key: list[str], ts: str = "ts") -> DataFrame:
    """Coverage, gaps and rate of a feed."""
    from pyspark.sql import Window

    s = F.col(ts).cast("double")
    gap = s - F.lag(s).over(Window.partitionBy(*key).orderBy(ts))
    d = rows.withColumn("__g", gap)
    return d.groupBy(*key).agg(
        F.count(F.lit(1)).alias("rows"), (F.max(s) - F.min(s)).alias("span_s"), F.percentile("__g", F.lit(0.5)).alias("median_gap"), F.percentile("__g", F.lit(0.95)).alias("p95_gap"),
        (F.count(F.lit(1)) / F.nullif((F.max(s) - F.min(s)) / 60, F.lit(0.0))).alias("rows_per_minute"),
    )


def roll_spread(bars: DataFrame, width: str, *, key: list[str], ts: str = "ts", least: int = 30, floor_bps: float = 0.5) -> DataFrame:
    """Spread per bucket from the lag-1 covariance of returns, or the high-low range.

    The lag does not cross buckets. ``fallback`` marks the range proxy.
    """
    from pyspark.sql import Window

    from tidemark.operators.grid import bucket

    b = bars.withColumn("__b", bucket(F.col(ts), width))
    w = Window.partitionBy(*key, "__b").orderBy(ts)
    b = b.withColumn("__r", F.try_divide(F.col("close"), F.lag("close").over(w)) - 1)
    b = b.withColumn("__r0", F.lag("__r").over(w))
    g = b.groupBy(*key, "__b").agg(F.covar_samp("__r", "__r0").alias("cov"), F.count("__r").alias("n"), F.avg(F.try_divide(F.col("high") - F.col("low"), F.col("close"))).alias("hl"))
    good = (F.col("n") >= least) & (F.col("cov") < 0)
    raw = F.when(good, 2 * F.sqrt(-F.col("cov")) * 1e4).otherwise(F.col("hl") * 0.5 * 1e4)
    return g.select(*key, F.col("__b").alias("bucket_start"), F.greatest(F.lit(floor_bps), raw).alias("spread_bps"), F.col("n").alias("n_bars"), (~F.coalesce(good, F.lit(False))).alias("fallback"))
