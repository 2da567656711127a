"""Resampling, grids and fills over keyed, time-ordered tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ordered(key: list[str], ts: str = "ts"):
    return Window.partitionBy(*key).orderBy(ts)


def up_to_now(key: list[str], ts: str = "ts"):
    return ordered(key, ts).rowsBetween(Window.unboundedPreceding, 0)


def bucket(ts: str | Column, width: str) -> Column:
    """Start of the epoch-aligned bucket, for widths that divide a day, or 'month', 'year'."""
    if width in ("month", "year", "week", "day", "hour"):
        return F.date_trunc(width, ts)
    return F.window(ts, width)["start"]


def resample_ohlcv(ticks: DataFrame, width: str, *, key: list[str], ts: str = "ts", price: str = "price", volume: str = "volume", tie: str | None = None) -> DataFrame:
    """Open, high, low, close and volume per bucket; empty buckets are absent.

    Left-closed and left-labelled. ``tie`` orders rows with equal time.
    """
    order = F.struct(ts, tie) if tie else F.col(ts)
    return (
        ticks.withColumn("__b", bucket(F.col(ts), width))
        .groupBy(*key, "__b")
        .agg(
            F.min_by(price, order).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"),
            F.max_by(price, order).alias("close"), F.sum(volume).alias("volume"),
        )
        .withColumnRenamed("__b", ts)
    )


def resample(df: DataFrame, width: str, aggs: dict[str, Column], *, key: list[str], ts: str = "ts") -> DataFrame:
    """Any aggregates per (key, bucket)."""
    return df.groupBy(*key, bucket(F.col(ts), width).alias("__b")).agg(*[c.alias(n) for n, c in aggs.items()]).withColumnRenamed("__b", ts)


def rebar(bars: DataFrame, width: str, *, key: list[str], ts: str = "ts") -> DataFrame:
    """Coarser bars from finer ones."""
    return resample(
        bars, width,
        {"open": F.min_by("open", ts), "high": F.max("high"), "low": F.min("low"), "close": F.max_by("close", ts), "volume": F.sum("volume")},
        key=key, ts=ts,
    )


def spine(df: DataFrame, seconds: int, *, key: list[str], ts: str = "ts") -> DataFrame:
    """Every grid time from a key's first to its last, as (key, ts)."""
    span = df.groupBy(*key).agg(F.min(F.unix_timestamp(ts)).alias("a"), F.max(F.unix_timestamp(ts)).alias("b"))
    first = F.floor(F.col("a") / seconds) * seconds
    return span.select(*key, F.explode(F.sequence(first.cast("long"), F.col("b"), F.lit(seconds).cast("long"))).alias("__s")).select(*key, F.timestamp_seconds("__s").alias(ts))


def last_on_grid(ticks: DataFrame, seconds: int, value: str, *, key: list[str], ts: str = "ts", tie: str | None = None) -> DataFrame:
    """Last value at or before the end of every grid step, carried forward."""
    order = F.struct(ts, tie) if tie else F.col(ts)
    step = F.timestamp_seconds((F.floor(F.unix_timestamp(ts) / seconds) * seconds).cast("long"))
    seen = ticks.groupBy(*key, step.alias("__t")).agg(F.max_by(value, order).alias(value)).withColumnRenamed("__t", ts)
    grid = spine(ticks, seconds, key=key, ts=ts).join(seen, [*key, ts], "left")
    return grid.withColumn(value, F.last(value, ignorenulls=True).over(up_to_now(key, ts)))


def forward_fill(df: DataFrame, cols: list[str], *, key: list[str], ts: str = "ts", most_rows: int | None = None) -> DataFrame:
    """Carry the last non-null value forward, at most ``most_rows`` rows."""
    w = up_to_now(key, ts)
    out = df
    if most_rows is not None:
        out = out.withColumn("__rn", F.row_number().over(ordered(key, ts)))
    for c in cols:
        filled = F.last(c, ignorenulls=True).over(w)
        if most_rows is not None:
            at = F.last(F.when(F.col(c).isNotNull(), F.col("__rn")), ignorenulls=True).over(w)
            filled = F.when(F.col("__rn") - at <= most_rows, filled)
        out = out.withColumn(f"__f_{c}", filled)
    for c in cols:
        out = out.withColumn(c, F.col(f"__f_{c}")).drop(f"__f_{c}")
    return out.drop("__rn")


def higher_timeframe(bars: DataFrame, width: str, aggs: dict[str, Column], *, key: list[str], ts: str = "ts") -> DataFrame:
    """Completed values of a coarser grid on fine bars.

    The coarse row before the current one is joined where a bar's time equals the
    coarse time, and carried forward; a missing boundary bar loses that value.
    """
    coarse = resample(bars, width, aggs, key=key, ts=ts)
    w = ordered(key, ts)
    lagged = coarse.select(*key, ts, *[F.lag(n).over(w).alias(f"htf_{n}") for n in aggs])
    return forward_fill(bars.join(lagged, [*key, ts], "left"), [f"htf_{n}" for n in aggs], key=key, ts=ts)


def daily_pivots(bars: DataFrame, *, key: list[str], ts: str = "ts") -> DataFrame:
    """P, R1, S1, R2, S2 of the previous calendar day, by day; a day after a gap has none."""
    day = resample(bars, "day", {"h": F.max("high"), "l": F.min("low"), "c": F.max_by("close", ts)}, key=key, ts=ts)
    prev = day.withColumn(ts, F.col(ts) + F.expr("INTERVAL 1 DAY"))
    p = (F.col("h") + F.col("l") + F.col("c")) / 3
    levels = prev.select(*key, ts, p.alias("p"), (2 * p - F.col("l")).alias("r1"), (2 * p - F.col("h")).alias("s1"),
                         (p + F.col("h") - F.col("l")).alias("r2"), (p - F.col("h") + F.col("l")).alias("s2"))
    return day.select(*key, ts).join(levels, [*key, ts], "left")


def coarsest_width(rows: int, cap: int = 5000, minutes: tuple[int, ...] = (1, 5, 15, 60, 240, 1440)) -> int:
    """Smallest width in minutes under which ``rows`` one-minute bars stay within ``cap`` points."""
    return next((m for m in minutes if rows / m <= cap), minutes[-1])


def panel(df: DataFrame, value: str, symbols: list[str] | None = None, *, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Wide table, one column per symbol, all of the data where none are named; for export only."""
    return df.groupBy(ts).pivot(key, symbols).agg(F.first(value))
