"""Queries that write a store in the shared folder and read it back, and live state."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import grid, joins, orderflow
from tidemark.operators.folds import folds_table, train_test
from tidemark.plans.base import BARS, KEY, TICKS, W, bars, out, query, rounded, shared_paths, table, ticks
from tidemark.sources import market
from tidemark.streaming import live

START, END = datetime(2024, 1, 10), datetime(2024, 1, 20)
SPAN = "t >= epoch(TIMESTAMP '2024-01-10') AND t < epoch(TIMESTAMP '2024-01-20')"


def stored(spark, rows: DataFrame, schema: str) -> str:
    """Path of a month store of ``rows``."""
    (path,) = shared_paths(spark, "months")
    market.write_months(rows, path)
    return path


@query("month_store_scan", out(BARS, "symbol t", "open high low close volume", f"SELECT * FROM bars WHERE symbol IN ('click', 'view') AND {SPAN}"))
def month_store_scan(spark, sf):
    """A span of two symbols from a month-partitioned store."""
    path = stored(spark, bars(spark, sf), market.BARS)
    return market.scan(spark, path, market.BARS, symbols=["click", "view"], start=START, end=END).drop("month")


@query("store_symbols", "WITH " + BARS + " SELECT DISTINCT symbol FROM bars")
def store_symbols(spark, sf):
    return market.symbols(market.scan(spark, stored(spark, bars(spark, sf), market.BARS), market.BARS))


@query("funding_store_scan", out(BARS, "symbol t", "rate", f"SELECT symbol, t, (close - open) / 1000 AS rate FROM bars WHERE t % 28800 = 0 AND {SPAN}"))
def funding_store_scan(spark, sf):
    """Funding rates from their store; a store that is absent adds no rows."""
    f = bars(spark, sf).where(F.unix_timestamp("ts") % 28800 == 0).select("symbol", "ts", ((F.col("close") - F.col("open")) / 1000).alias("rate"))
    path = stored(spark, f, market.FUNDING)
    absent = market.scan(spark, f"{path}-absent", market.FUNDING)
    return market.scan(spark, path, market.FUNDING, start=START, end=END).unionByName(absent).drop("month")


@query("interest_store_scan", out(BARS, "symbol t", "open_interest", f"SELECT * FROM (SELECT symbol, t, sum(volume) OVER w AS open_interest FROM bars {W}) WHERE {SPAN}"))
def interest_store_scan(spark, sf):
    o = bars(spark, sf).select("symbol", "ts", F.sum("volume").over(grid.up_to_now(KEY)).alias("open_interest"))
    return market.scan(spark, stored(spark, o, market.OPEN_INTEREST), market.OPEN_INTEREST, start=START, end=END).drop("month")


@query("spread_store_scan", out(BARS, "symbol t n_bars fallback", "spread_bps", f"SELECT symbol, t, volume::INT AS n_bars, volume < 20 AS fallback, (high - low) / nullif(close, 0) * 1e4 AS spread_bps FROM bars WHERE {SPAN}"))
def spread_store_scan(spark, sf):
    s = bars(spark, sf).select("symbol", "ts", (F.try_divide(F.col("high") - F.col("low"), F.col("close")) * 1e4).alias("spread_bps"), F.col("volume").cast("int").alias("n_bars"), (F.col("volume") < 20).alias("fallback"))
    return market.scan(spark, stored(spark, s, market.SPREADS), market.SPREADS, start=START, end=END).drop("month")


@query("feature_cache_upsert", out(BARS, "symbol t", "x", "SELECT symbol, t, CASE WHEN t >= epoch(TIMESTAMP '2024-01-15') THEN close * 2 ELSE close END AS x FROM bars"))
def feature_cache_upsert(spark, sf):
    """A feature written, then written again from the 15th on: the later write wins."""
    schema = "symbol string, month string, ts timestamp, x double"
    f = bars(spark, sf).select("symbol", "ts", F.col("close").alias("x"))
    path = stored(spark, f, schema)
    again = f.where(F.col("ts") >= F.lit(datetime(2024, 1, 15))).withColumn("x", F.col("x") * 2)
    shared_dir(spark)
    market.upsert_months(spark, path, schema, again, key=KEY)
    return market.scan(spark, path, schema).drop("month")


def shared_dir(spark) -> None:
    """Checkpoints go to the shared folder."""
    if not spark.sparkContext.getCheckpointDir() and not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(shared_paths(spark, "checkpoints")[0])


@query("tick_session_scan", out(TICKS, "event_id lag_ms", "price amount", "SELECT event_id, event_id % 7 AS lag_ms, price, amount FROM ticks WHERE symbol = 'click'"))
def tick_session_scan(spark, sf):
    """One symbol's trades of a recorded session, with the delay of their arrival."""
    (root,) = shared_paths(spark, "sessions")
    t = ticks(spark, sf)
    at = F.unix_millis("ts")
    rows = t.select(
        F.lit("s1").alias("session"), F.lit("trades").alias("stream"), "symbol", at.alias("ts_exchange"), (at + F.col("event_id") % 7).alias("ts_local"), "price", "amount", F.col("event_id").cast("string").alias("id")
    )
    rows.write.partitionBy("session", "stream", "symbol").parquet(root)
    got = market.tick_session(spark, root, "s1", "trades", "click")
    return got.select(F.col("id").cast("long").alias("event_id"), (F.unix_millis("arrived") - F.unix_millis("ts")).alias("lag_ms"), "price", "amount")


@query("run_history_lines", "SELECT c_custkey AS iter, round(c_acctbal, 6) AS score, c_nationkey::VARCHAR AS note FROM customer WHERE c_custkey % 10 <> 3")
def run_history_lines(spark, sf):
    """A run history of JSON lines; each tenth line is cut off and skipped."""
    (path,) = shared_paths(spark, "history")
    c = table(spark, sf, "customer")
    line = F.to_json(F.struct(F.col("c_custkey").cast("long").alias("iter"), F.col("c_acctbal").alias("score"), F.col("c_nationkey").cast("string").alias("note")))
    c.select(F.when(F.col("c_custkey") % 10 == 3, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    return market.run_history(spark, path, "iter long, score double, note string").where("iter IS NOT NULL")


@query("event_book_saved", "WITH " + BARS + " SELECT count(*) AS rows, count(DISTINCT symbol) AS symbols, epoch(min(to_timestamp(t)))::BIGINT AS first, epoch(max(to_timestamp(t)))::BIGINT AS last, '{\"k\": 2}' AS params FROM bars WHERE volume >= 30")
def event_book_saved(spark, sf):
    """The manifest beside a saved event book."""
    (path,) = shared_paths(spark, "book")
    e = bars(spark, sf).where("volume >= 30").select(F.col("symbol").alias("sym"), F.col("ts").alias("entry_ts"), "close")
    market.save_book(e, path, {"k": 2})
    m = spark.read.schema("rows long, symbols long, first timestamp, last timestamp, params string").json(f"{path}/manifest")
    return m.select("rows", "symbols", "first", "last", "params")


@query("rolling_capture", out(TICKS, "symbol n", "amount", "SELECT symbol, count(*) AS n, sum(amount) AS amount FROM ticks GROUP BY 1"))
def rolling_capture(spark, sf):
    """What a capture of the trade stream has recorded, by symbol."""
    from tidemark.plans.model_queries import trade_stream

    path, state = shared_paths(spark, "capture", "state")
    live.capture(trade_stream(spark, sf), path, state, None).start().awaitTermination()
    return spark.read.parquet(path).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount"))


def quotes(spark, sf) -> DataFrame:
    """A ticker stream over the events: quotes around the price."""
    from tidemark.plans.model_queries import trade_stream

    p, i = F.col("price"), F.col("id")
    return trade_stream(spark, sf).select(
        "symbol", F.struct("ts", "id").alias("at"), F.col("ts"), p.alias("last"), (p * 0.999).alias("bid"), (p * 1.001).alias("ask"), (p * (1 + (i % 5) / 1000)).alias("mark"), p.alias("index"), (i % 9 / 10000).alias("funding_rate"), (i % 1000).cast("double").alias("open_interest"),
    )


@query("latest_quotes", out("last_ AS (SELECT event_type AS symbol, epoch(date_trunc('second', max(ts)))::BIGINT AS t, last(value ORDER BY ts) AS p, last(event_id ORDER BY ts) AS i FROM events GROUP BY 1)", "symbol t", "last mid spread_bps open_interest funding_rate premium_bps", "SELECT symbol, t, p AS last, (p * 0.999 + p * 1.001) / 2 AS mid, (p * 1.001 - p * 0.999) / nullif((p * 0.999 + p * 1.001) / 2, 0) * 1e4 AS spread_bps, (i % 1000)::DOUBLE AS open_interest, i % 9 / 10000 AS funding_rate, (p * (1 + i % 5 / 1000) - p) / nullif(p, 0) * 1e4 AS premium_bps FROM last_", 4))
def latest_quotes(spark, sf):
    """State per symbol after the last batch of a ticker stream."""
    from tidemark.plans.model_queries import drained

    d = drained(live.latest_quote(quotes(spark, sf)), "update")
    cols = ["ts", "last", "mid", "spread_bps", "open_interest", "funding_rate", "premium_bps"]
    one = d.groupBy("symbol").agg(F.max_by(F.struct(*cols), "batch").alias("q")).select("symbol", "q.*")
    return one.select("symbol", "ts", *[rounded(c, 4).alias(c) for c in cols[1:]])


@query("stream_feed_statistics", out(TICKS, "symbol t rows", "lag_s rows_per_second", "SELECT symbol, (s // 3600 * 3600)::BIGINT AS t, count(*) AS rows, avg(event_id % 7) AS lag_s, count(*) / 3600 AS rows_per_second FROM ticks GROUP BY symbol, s // 3600 HAVING s // 3600 * 3600 + 3600 <= (SELECT max(s) - 600 FROM ticks)"))
def stream_feed_statistics(spark, sf):
    """Rows, rate and delay of a feed by hour."""
    from tidemark.plans.model_queries import drained, trade_stream

    s = trade_stream(spark, sf).withColumn("arrived", F.timestamp_seconds(F.col("ts").cast("double") + F.col("id") % 7))
    return drained(live.feed_statistics(s, "1 hour"))


@query("stream_all_metrics", out(TICKS + ", tr AS (SELECT *, user_id % 2 = 0 AS buy FROM ticks)", "symbol t trades sells buys", "cvd volume vwap buy_fraction last high low largest mean_size range_bps", "SELECT symbol, (s // 3600 * 3600)::BIGINT AS t, count(*) AS trades, count(*) FILTER (NOT buy) AS sells, count(*) FILTER (buy) AS buys, sum(CASE WHEN buy THEN amount ELSE -amount END) AS cvd, sum(amount) AS volume, sum(price * amount) / nullif(sum(amount), 0) AS vwap, sum(CASE WHEN buy THEN amount ELSE 0 END) / nullif(sum(amount), 0) AS buy_fraction, last(price ORDER BY ts) AS last, max(price) AS high, min(price) AS low, max(amount) AS largest, avg(amount) AS mean_size, (max(price) - min(price)) / nullif(min(price), 0) * 1e4 AS range_bps FROM tr GROUP BY symbol, s // 3600 HAVING s // 3600 * 3600 + 3600 <= (SELECT max(s) - 600 FROM ticks)"))
def stream_all_metrics(spark, sf):
    """Every metric of the registry, by hour."""
    from tidemark.plans.model_queries import drained, trade_stream

    return drained(live.windowed_metrics(trade_stream(spark, sf), list(live.metric_registry()), "1 hour"))


@query("typed_streams", "WITH " + TICKS + " SELECT symbol, count(*) AS n, round(sum(price), 4) AS total FROM ticks GROUP BY 1")
def typed_streams(spark, sf):
    """A typed stream over recorded trade files, with event time from the exchange's clock."""
    from tidemark.plans.model_queries import drained

    (root,) = shared_paths(spark, "tape")
    at = F.unix_millis("ts")
    t = ticks(spark, sf).select(at.alias("ts_exchange"), at.alias("ts_local"), "symbol", "price", "amount", F.lit("buy").alias("side"), F.col("event_id").cast("string").alias("id"))
    t.repartition(4).write.parquet(root)
    s = live.with_event_time(live.file_stream(spark, root, market.TRADES))
    return drained(s.select("symbol", "ts", "price")).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), rounded(F.sum("price"), 4).alias("total"))


@query("auto_width_bars", out(TICKS + ", m AS (SELECT symbol, s // 60 AS m FROM ticks GROUP BY 1, 2), c AS (SELECT max(n) AS n FROM (SELECT count(*) AS n FROM m GROUP BY symbol)), k AS (SELECT CASE WHEN n <= 500 THEN 60 WHEN n / 5 <= 500 THEN 300 WHEN n / 15 <= 500 THEN 900 WHEN n / 60 <= 500 THEN 3600 WHEN n / 240 <= 500 THEN 14400 ELSE 86400 END AS w FROM c)", "symbol t", "close", "SELECT symbol, (s // w * w)::BIGINT AS t, last(price ORDER BY ts, event_id) AS close FROM ticks CROSS JOIN k GROUP BY symbol, s // w, w"))
def auto_width_bars(spark, sf):
    """Bars at the finest width that stays within 500 points a symbol."""
    n = bars(spark, sf, "1 minute").groupBy("symbol").count().agg(F.max("count")).first()[0] or 0
    return bars(spark, sf, f"{grid.coarsest_width(n, 500)} minutes").select("symbol", "ts", "close")


@query("train_test_with_embargo", "WITH " + BARS + " SELECT symbol, CASE WHEN t < epoch(TIMESTAMP '2024-01-22') THEN 'train' ELSE 'oos' END AS role, count(*) AS n FROM bars WHERE t >= epoch(TIMESTAMP '2024-01-01') AND t < epoch(TIMESTAMP '2024-01-31') AND NOT (t >= epoch(TIMESTAMP '2024-01-22') AND t < epoch(TIMESTAMP '2024-01-24')) GROUP BY 1, 2")
def train_test_with_embargo(spark, sf):
    """Rows of a 70 % train span and of what follows it after two days."""
    from datetime import timedelta

    rows = train_test(datetime(2024, 1, 1), datetime(2024, 1, 31), 0.7, timedelta(days=2))
    f = folds_table(spark, [(a, b, c, d) for a, b, c, d in rows])
    return joins.assign_folds(bars(spark, sf), f).groupBy("symbol", "role").agg(F.count(F.lit(1)).alias("n"))


@query("ragged_tail_cut", "WITH " + BARS + " SELECT symbol, max(t) AS last_t, count(*) AS n FROM bars WHERE t <= (SELECT min(m) FROM (SELECT max(t) AS m FROM bars GROUP BY symbol)) GROUP BY 1")
def ragged_tail_cut(spark, sf):
    """Rows up to the time that every symbol reaches."""
    b = bars(spark, sf)
    ends = b.groupBy("symbol").agg(F.max("ts").alias("m")).agg(F.min("m").alias("__cut"))  # one row
    d = b.join(F.broadcast(ends)).where("ts <= __cut")
    return d.groupBy("symbol").agg(F.unix_timestamp(F.max("ts")).alias("last_t"), F.count(F.lit(1)).alias("n"))


@query("symbol_names", "SELECT event_id, replace(replace(replace(upper(event_type || '-usdt'), '-', ''), '/', ''), '_', '') AS symbol, CASE WHEN event_type IN ('click', 'view') THEN 'trades' ELSE 'orderbook' END AS stream FROM events")
def symbol_names(spark, sf):
    """Venue symbols in one form, and stream aliases by their canonical name."""
    e = table(spark, sf, "events")
    alias = F.when(F.col("event_type").isin("click", "view"), " Tape ").otherwise("depth")
    return e.select("event_id", orderflow.plain_symbol(F.concat("event_type", F.lit("-usdt"))).alias("symbol"), orderflow.stream_name(alias).alias("stream"))


@query("premium_and_clock", out(TICKS, "event_id seconds_left", "premium_bps", "SELECT event_id, 28800 - s % 28800 AS seconds_left, (price * 1.001 - price) / nullif(price, 0) * 1e4 AS premium_bps FROM ticks"))
def premium_and_clock(spark, sf):
    t = ticks(spark, sf)
    return t.select("event_id", orderflow.seconds_to_funding(F.col("ts")).alias("seconds_left"), orderflow.premium_bps(F.col("price") * 1.001, F.col("price")).alias("premium_bps"))


@query("book_heat_grid", out(BARS + ", lv AS (SELECT symbol, (t // 14400 * 14400)::BIGINT AS t, close - i AS px, volume / i AS sz FROM bars CROSS JOIN range(1, 6) r(i))", "symbol t", "px size", "SELECT symbol, t, floor(px / 5) * 5 AS px, avg(sz) AS size FROM lv GROUP BY symbol, t, floor(px / 5)"))
def book_heat_grid(spark, sf):
    """Mean resting size by four hours and five price units."""
    b = bars(spark, sf).withColumn("levels", F.array(*[F.struct((F.col("close") - i).alias("px"), (F.col("volume") / i).alias("sz")) for i in range(1, 6)]))
    return orderflow.heat_grid(b, "levels", 14400, 5.0, key=KEY)
