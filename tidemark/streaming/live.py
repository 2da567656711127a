"""Structured Streaming forms of the live metrics.

Event time is the exchange's; every windowed result states a watermark. A window is
emitted once the watermark passes its end.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.orderflow import regime_label, signed_volume

#: Rows of a symbol that ``throttle`` takes up before it sorts them into those it holds.
THROTTLE_ROWS = 1 << 18


def file_stream(spark: SparkSession, path: str, schema: str, *, fmt: str = "parquet", files_per_batch: int = 8) -> DataFrame:
    """A typed stream over arriving files."""
    return spark.readStream.schema(schema).format(fmt).option("maxFilesPerTrigger", files_per_batch).load(path)


def with_event_time(df: DataFrame, late: str = "10 seconds") -> DataFrame:
    return df.withColumns({"ts": F.timestamp_millis("ts_exchange"), "arrived": F.timestamp_millis("ts_local")}).withWatermark("ts", late)


def bars(trades: DataFrame, width: str) -> DataFrame:
    """Tumbling open, high, low, close, volume; the tie of equal times is the trade id."""
    order = F.struct("ts", "id")
    g = trades.groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("amount").alias("volume")
    )
    return g.select("symbol", F.col("w.start").alias("ts"), "open", "high", "low", "close", "volume")


def trailing_flow(trades: DataFrame, width: str = "60 seconds", slide: str = "1 second") -> DataFrame:
    """Signed volume, buy share and rate over a sliding window."""
    g = trades.groupBy("symbol", F.window("ts", width, slide).alias("w")).agg(
        F.sum(signed_volume()).alias("cvd"), F.sum(F.when(F.col("side") == "buy", F.col("amount")).otherwise(0.0)).alias("bought"), F.sum("amount").alias("volume"), F.count(F.lit(1)).alias("trades")
    )
    seconds = F.unix_timestamp("w.end") - F.unix_timestamp("w.start")
    return g.select("symbol", F.col("w.end").alias("ts"), "cvd", (F.col("bought") / F.nullif(F.col("volume"), F.lit(0.0))).alias("buy_fraction"), (F.col("trades") / seconds).alias("trades_per_second"))


def open_interest_regime(ticker: DataFrame, width: str = "60 seconds") -> DataFrame:
    """Change of price and open interest within a window and its label; one sample gives null."""
    g = ticker.groupBy("symbol", F.window("ts", width).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.min_by("last", "ts").alias("p0"), F.max_by("last", "ts").alias("p1"), F.min_by("open_interest", "ts").alias("o0"), F.max_by("open_interest", "ts").alias("o1")
    )
    dp, doi = F.when(F.col("n") >= 2, F.col("p1") - F.col("p0")), F.when(F.col("n") >= 2, F.col("o1") - F.col("o0"))
    return g.select("symbol", F.col("w.start").alias("ts"), dp.alias("d_price"), doi.alias("d_open_interest"), regime_label(dp, doi).alias("regime"))


def latest_quote(ticker: DataFrame) -> DataFrame:
    """Current state per symbol, for update mode."""
    g = ticker.groupBy("symbol").agg(F.max_by(F.struct("ts", "last", "bid", "ask", "mark", "index", "funding_rate", "open_interest"), "ts").alias("q"))
    mid = (F.col("q.bid") + F.col("q.ask")) / 2
    return g.select(
        "symbol", "q.ts", "q.last", mid.alias("mid"), ((F.col("q.ask") - F.col("q.bid")) / F.nullif(mid, F.lit(0.0)) * 1e4).alias("spread_bps"), "q.open_interest", "q.funding_rate",
        ((F.col("q.mark") - F.col("q.index")) / F.nullif(F.col("q.index"), F.lit(0.0)) * 1e4).alias("premium_bps"),
    )


def feed_statistics(rows: DataFrame, width: str = "60 seconds") -> DataFrame:
    g = rows.groupBy("symbol", F.window("ts", width).alias("w")).agg(F.count(F.lit(1)).alias("rows"), F.avg(F.col("arrived").cast("double") - F.col("ts").cast("double")).alias("lag_s"))
    return g.select("symbol", F.col("w.start").alias("ts"), "rows", "lag_s", (F.col("rows") / (F.unix_timestamp("w.end") - F.unix_timestamp("w.start"))).alias("rows_per_second"))


def trigger_clusters(triggers: DataFrame, gap: str = "10 minutes") -> DataFrame:
    """Session windows over trigger rows; a row exactly at the gap still joins."""
    g = triggers.groupBy("symbol", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("k"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return g.select("symbol", "first", "last", "k")


def bridge(trades: DataFrame, ticker: DataFrame, width: str = "60 seconds") -> DataFrame:
    """Trade flow and ticker state of the same windows, by a stream-stream join."""
    t = trades.groupBy("symbol", F.window("ts", width).alias("w")).agg(F.sum(signed_volume()).alias("cvd"))
    q = ticker.groupBy("symbol", F.window("ts", width).alias("w")).agg(F.max_by("last", "ts").alias("price"), F.max_by("open_interest", "ts").alias("open_interest"))
    return t.join(q, ["symbol", "w"]).select("symbol", F.col("w.start").alias("ts"), "cvd", "price", "open_interest")


def running_delta(trades: DataFrame) -> DataFrame:
    """Signed volume since the start of the session, one row per symbol and batch."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        total, n = state.get if state.exists else (0.0, 0)
        for p in parts:
            total += float((p["amount"] * p["side"].map({"buy": 1.0, "sell": -1.0}).fillna(0.0)).sum())
            n += len(p)
        state.update((total, n))
        yield pd.DataFrame({"symbol": [key[0]], "cvd": [total], "trades": [n]})

    return trades.select("symbol", "side", "amount").groupBy("symbol").applyInPandasWithState(update, "symbol string, cvd double, trades long", "cvd double, trades long", "update", GroupStateTimeout.NoTimeout)


def throttle(books: DataFrame, millis: int = 250) -> DataFrame:
    """At most one snapshot per symbol in each interval since the last one let through.

    A symbol's rows of a batch come in parts and in any order, and each choice depends on all earlier times, so
    the batch's times (8 bytes for each different one) are sorted together before the first is let through.
    """

    def pick(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        arranged = np.unique if millis > 0 else np.sort  # of rows at one time only the first can pass
        held, new = np.empty(0, np.int64), []
        for p in parts:
            t = p["ts_exchange"].dropna().to_numpy(np.int64)
            new.append(t if last is None else t[t - last >= millis])
            if sum(map(len, new)) > max(len(held), THROTTLE_ROWS):
                held, new = arranged(np.concatenate([held, *new])), []
        held, keep, i = arranged(np.concatenate([held, *new])), [], 0
        while i < len(held):
            last = int(held[i])
            keep.append(last)
            i = int(np.searchsorted(held, last + millis)) if millis > 0 else i + 1
        if keep:
            yield pd.DataFrame({"symbol": key[0], "ts_exchange": keep})
            state.update((last,))

    return books.select("symbol", "ts_exchange").groupBy("symbol").applyInPandasWithState(pick, "symbol string, ts_exchange long", "last long", "append", GroupStateTimeout.NoTimeout)


def metric_registry() -> dict[str, Callable[[], object]]:
    """Name -> aggregate expression, made when a session runs."""
    return {
        "cvd": lambda: F.sum(signed_volume()), "volume": lambda: F.sum("amount"), "trades": lambda: F.count(F.lit(1)), "vwap": lambda: F.sum(F.col("price") * F.col("amount")) / F.nullif(F.sum("amount"), F.lit(0.0)),
        "buy_fraction": lambda: F.sum(F.when(F.col("side") == "buy", F.col("amount")).otherwise(0.0)) / F.nullif(F.sum("amount"), F.lit(0.0)), "last": lambda: F.max_by("price", "ts"), "high": lambda: F.max("price"),
        "low": lambda: F.min("price"), "largest": lambda: F.max("amount"), "mean_size": lambda: F.avg("amount"), "sells": lambda: F.count(F.when(F.col("side") == "sell", 1)), "buys": lambda: F.count(F.when(F.col("side") == "buy", 1)),
        "range_bps": lambda: (F.max("price") - F.min("price")) / F.nullif(F.min("price"), F.lit(0.0)) * 1e4,
    }


def windowed_metrics(trades: DataFrame, names: list[str], width: str = "60 seconds") -> DataFrame:
    made = metric_registry()
    g = trades.groupBy("symbol", F.window("ts", width).alias("w")).agg(*[made[n]().alias(n) for n in names])
    return g.select("symbol", F.col("w.start").alias("ts"), *names)


def tee(stream: DataFrame, path: str, checkpoint: str, serve: Callable[[DataFrame, int], None]):
    """Record every batch as Parquet and serve it, from one stream.

    A batch has a folder of its own, so one that runs again replaces its rows.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        batch.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
        serve(batch, epoch)
        batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)


def capture(stream: DataFrame, path: str, checkpoint: str, every: str | None = "60 seconds"):
    """Rolling Parquet capture by symbol; without ``every`` what is there now, then it ends."""
    writer = stream.writeStream.format("parquet").partitionBy("symbol").option("path", path).option("checkpointLocation", checkpoint)
    return writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)
