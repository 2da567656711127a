"""Queries: combinatorial folds, parameter sweeps, meta-labels and streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import events, folds, inference, joins, meta, metrics, rolling, sweep
from tidemark.operators.grid import ordered
from tidemark.plans.base import BARS, HOUR_PPY, KEY, ORACLES, RETS, TICKS, bars, out, query, shared_paths, table, with_returns
from tidemark.streaming import live


@query("combinatorial_paths", out(RETS + ", g AS (SELECT *, (t - epoch(TIMESTAMP '2024-01-01')::BIGINT) // 432000 AS grp FROM rets), p AS (SELECT row_number() OVER (ORDER BY a.i, b.i) - 1 AS fold, a.i AS x, b.i AS y FROM range(6) a(i) JOIN range(6) b(i) ON a.i < b.i)", "fold role n", "sharpe", "SELECT fold::VARCHAR AS fold, CASE WHEN grp IN (x, y) THEN 'oos' ELSE 'train' END AS role, count(r) AS n, avg(r) / stddev_samp(r) * sqrt(8760) AS sharpe FROM g CROSS JOIN p GROUP BY 1, 2"))
def combinatorial_paths(spark, sf):
    """Sharpe in and out of sample on each of the 15 choices of two test groups of six."""
    rows = folds.combinatorial_folds(datetime(2024, 1, 1), datetime(2024, 1, 31), 6, 2)
    f = spark.createDataFrame([(n, r, str(a), str(b)) for n, r, a, b in rows], "fold string, role string, a string, b string").select("fold", "role", F.col("a").cast("timestamp").alias("start"), F.col("b").cast("timestamp").alias("end"))
    d = joins.assign_folds(with_returns(spark, sf), f)
    return d.groupBy("fold", "role").agg(F.count("r").alias("n"), metrics.sharpe(F.col("r"), HOUR_PPY).alias("sharpe"))


@query("parameter_sweep", out(BARS + ", z AS (SELECT symbol, t, close, (close - avg(close) OVER k) / nullif(stddev_samp(close) OVER k, 0) AS z, lead(close) OVER (PARTITION BY symbol ORDER BY t) / nullif(close, 0) - 1 AS f FROM bars WINDOW k AS (PARTITION BY symbol ORDER BY t ROWS 19 PRECEDING)), c AS (SELECT * FROM (VALUES (0::BIGINT, 0.5::DOUBLE), (1, 1.0), (2, 1.5)) v(candidate, entry))", "candidate symbol n", "mean", "SELECT candidate, symbol, count(*) AS n, avg(-sign(z) * f) AS mean FROM z CROSS JOIN c WHERE abs(z) >= entry AND f IS NOT NULL GROUP BY 1, 2"))
def parameter_sweep(spark, sf):
    """Every candidate threshold over every symbol in one plan."""
    b = bars(spark, sf)
    w = rolling.last_k(20, KEY)
    b = b.withColumns({"z": rolling.zscore(F.col("close"), w, 1), "f": rolling.forward_return("close", KEY)})
    d = sweep.with_candidates(b, sweep.grid(spark, {"entry": [0.5, 1.0, 1.5]}))
    return d.where("abs(z) >= entry AND f IS NOT NULL").groupBy("candidate", "symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(-F.signum("z") * F.col("f")).alias("mean"))


@query("symbol_scan", "WITH " + BARS + " SELECT symbol, count(*) AS n, round(max(close), 6) AS top, NULL AS error FROM bars GROUP BY 1")
def symbol_scan(spark, sf):
    import pandas as pd
    from pyspark.sql import types as T

    class Top:
        def __init__(self, symbol: str):
            self.n, self.top = 0, None

        def add(self, rows: pd.DataFrame) -> None:
            self.n += len(rows)
            self.top = max(x for x in (self.top, rows["close"].max()) if x is not None)

        def rows(self) -> pd.DataFrame:
            return pd.DataFrame({"n": [self.n], "top": [self.top]})

    return sweep.scan_symbols(bars(spark, sf), Top, T.StructType([T.StructField("n", T.LongType()), T.StructField("top", T.DoubleType())]))


def labelled_events(spark, sf) -> DataFrame:
    b = events.indexed(with_returns(spark, sf), key=KEY)
    w = ordered(KEY)
    b = b.withColumns({"f_ret": F.lag("r").over(w), "f_vol": F.lag(F.stddev_samp("r").over(rolling.last_k(24, KEY))).over(w), "f_volume": F.lag("volume").over(w)})
    e = b.where("volume >= 25").select(F.concat_ws("-", "symbol", F.col("idx").cast("string")).alias("eid"), "symbol", "ts", "idx", "close", "f_ret", "f_vol", "f_volume")
    lab = events.triple_barrier(e, b, 12, F.lit(0.5), F.lit(0.5), key=KEY, event_id="eid")
    return e.join(meta.meta_labels(lab), "eid").select("eid", "symbol", "ts", "f_ret", "f_vol", "f_volume", "ret", "y")


@query("meta_label_quality")
def meta_label_quality(spark, sf):
    """Logistic meta-labels fitted on the first 20 days, judged on the rest."""
    e = labelled_events(spark, sf)
    cut = F.lit("2024-01-21").cast("timestamp")
    model = meta.fit_meta(e.where(F.col("ts") < cut), ["f_ret", "f_vol", "f_volume"])
    rest = e.where(F.col("ts") >= cut)
    scored = meta.predict(model, rest) if model else rest.withColumn("p", F.lit(0.5))
    return meta.precision_recall(scored, "p", "y")


@query("meta_label_trees")
def meta_label_trees(spark, sf):
    e = labelled_events(spark, sf)
    return meta.expanding_forest(e, ["f_ret", "f_vol", "f_volume"], "ret", order="ts").groupBy("slice").agg(F.count(F.lit(1)).alias("n"), F.corr("score", "ret").alias("corr"))


@query("behaviour_clusters")
def behaviour_clusters(spark, sf):
    """Users grouped by their standardised behaviour."""
    e = table(spark, sf, "events").groupBy("user_id").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.count(F.lit(1)).cast("double").alias("n"), F.avg((F.col("event_type") == "purchase").cast("double")).alias("buys"))
    return meta.behaviour_clusters(e.na.fill(0.0), ["mean", "sd", "n", "buys"], 4).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.avg("mean").alias("mean"))


def trade_stream(spark, sf) -> DataFrame:
    raw = spark.readStream.schema(table(spark, sf, "events").schema).parquet(f"{sf}/event[s].parquet")  # a pattern may be a file or a folder
    return raw.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), (F.col("user_id") % 10 + 1).cast("double").alias("amount"),
        F.when(F.col("user_id") % 2 == 0, "buy").otherwise("sell").alias("side"), F.col("event_id").alias("id"),
    ).withWatermark("ts", "10 minutes")


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into a table in the shared folder."""
    spark = stream.sparkSession
    path, state = shared_paths(spark, "stream", "state")
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", state).trigger(availableNow=True).start()
    else:
        q = stream.writeStream.outputMode(mode).foreachBatch(lambda batch, i: batch.withColumn("batch", F.lit(i)).write.mode("append").parquet(path)).option("checkpointLocation", state).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema if mode == "append" else stream.schema.add("batch", "long")).parquet(path)


LATE = "(SELECT max(s) - 600 FROM ticks)"
SIDED = TICKS + ", tr AS (SELECT *, CASE WHEN user_id % 2 = 0 THEN amount ELSE -amount END AS sv FROM ticks)"


@query("stream_bars", out(TICKS, "symbol t", "open high low close volume", f"SELECT symbol, (s // 3600 * 3600)::BIGINT AS t, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close, sum(amount) AS volume FROM ticks GROUP BY symbol, s // 3600 HAVING s // 3600 * 3600 + 3600 <= {LATE}"))
def stream_bars(spark, sf):
    """Closed hourly bars from a stream equal the batch bars."""
    return drained(live.bars(trade_stream(spark, sf), "1 hour"))


@query("stream_metrics", out(SIDED, "symbol t trades buys", "cvd vwap", f"SELECT symbol, (s // 3600 * 3600)::BIGINT AS t, count(*) AS trades, count(*) FILTER (sv > 0) AS buys, sum(sv) AS cvd, sum(price * amount) / sum(amount) AS vwap FROM tr GROUP BY symbol, s // 3600 HAVING s // 3600 * 3600 + 3600 <= {LATE}"))
def stream_metrics(spark, sf):
    return drained(live.windowed_metrics(trade_stream(spark, sf), ["cvd", "trades", "buys", "vwap"], "1 hour"))


@query("stream_trailing_flow", out(SIDED + ", h AS (SELECT *, unnest([s // 3600, s // 3600 + 1]) AS k FROM tr)", "symbol t", "cvd buy_fraction trades_per_second", f"SELECT symbol, ((k + 1) * 3600)::BIGINT AS t, sum(sv) AS cvd, sum(amount) FILTER (sv > 0) / sum(amount) AS buy_fraction, count(*) / 7200 AS trades_per_second FROM h GROUP BY symbol, k HAVING (k + 1) * 3600 <= {LATE}").replace("sum(amount) FILTER (sv > 0) /", "coalesce(sum(amount) FILTER (sv > 0), 0) /"))
def stream_trailing_flow(spark, sf):
    return drained(live.trailing_flow(trade_stream(spark, sf), "2 hours", "1 hour"))


@query("stream_clusters", "WITH " + TICKS + ", c AS (SELECT symbol, ts, s, CASE WHEN ts - lag(ts) OVER (PARTITION BY symbol ORDER BY ts) <= INTERVAL 1 HOUR THEN 0 ELSE 1 END AS n FROM ticks WHERE price > 50), g AS (SELECT *, sum(n) OVER (PARTITION BY symbol ORDER BY ts ROWS UNBOUNDED PRECEDING) AS c FROM c) SELECT symbol, min(s) AS first, max(s) AS last, count(*) AS k FROM g GROUP BY symbol, c HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM ticks WHERE price > 50)")
def stream_clusters(spark, sf):
    """Session windows over large prints; the filter runs before the watermark, which follows these prints."""
    return drained(live.trigger_clusters(trade_stream(spark, sf).where("price > 50"), "1 hour"))


@query("stream_running_delta", "WITH " + SIDED + " SELECT symbol, round(sum(sv), 6) AS cvd, count(*) AS trades FROM tr GROUP BY 1")
def stream_running_delta(spark, sf):
    """State per symbol after the last batch."""
    d = drained(live.running_delta(trade_stream(spark, sf)), "update")
    return d.groupBy("symbol").agg(F.max_by("cvd", "batch").alias("cvd"), F.max_by("trades", "batch").alias("trades"))


@query("stream_throttle", "WITH RECURSIVE n AS MATERIALIZED (SELECT event_type AS symbol, epoch_ms(ts) AS ms, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn FROM events), k AS (SELECT symbol, rn, ms AS kept, 1 AS hit FROM n WHERE rn = 1 UNION ALL SELECT n.symbol, n.rn, CASE WHEN n.ms - k.kept >= 600000 THEN n.ms ELSE k.kept END, (n.ms - k.kept >= 600000)::INT FROM k JOIN n ON n.symbol = k.symbol AND n.rn = k.rn + 1) SELECT symbol, sum(hit)::BIGINT AS n FROM k GROUP BY 1")
def stream_throttle(spark, sf):
    """One snapshot per symbol in ten minutes since the last one."""
    b = trade_stream(spark, sf).select("symbol", F.unix_millis("ts").alias("ts_exchange"))
    return drained(live.throttle(b, 600_000)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


def ticker_stream(spark, sf) -> DataFrame:
    return trade_stream(spark, sf).select("symbol", "ts", F.col("price").alias("last"), (F.col("id") % 1000).cast("double").alias("open_interest"))


CLOSED = f"HAVING s // 3600 * 3600 + 3600 <= {LATE}"


@query("stream_bridge", out(SIDED, "symbol t", "cvd price open_interest", f"SELECT symbol, (s // 3600 * 3600)::BIGINT AS t, sum(sv) AS cvd, last(price ORDER BY ts) AS price, last(event_id % 1000 ORDER BY ts)::DOUBLE AS open_interest FROM tr GROUP BY symbol, s // 3600 {CLOSED}"))
def stream_bridge(spark, sf):
    """Trade flow beside the ticker's state, window by window, from two streams."""
    return drained(live.bridge(trade_stream(spark, sf), ticker_stream(spark, sf), "1 hour"))


@query("stream_regime", out(TICKS + ", g AS (SELECT symbol, s // 3600 AS h, count(*) AS n, last(price ORDER BY ts) - first(price ORDER BY ts) AS dp, (last(event_id % 1000 ORDER BY ts) - first(event_id % 1000 ORDER BY ts))::DOUBLE AS doi FROM ticks GROUP BY symbol, s // 3600 " + CLOSED + ")", "symbol t regime", "d_price d_open_interest", "SELECT symbol, (h * 3600)::BIGINT AS t, CASE WHEN n >= 2 THEN dp END AS d_price, CASE WHEN n >= 2 THEN doi END AS d_open_interest, CASE WHEN n < 2 THEN NULL WHEN dp > 0 AND doi > 0 THEN 'new longs' WHEN dp > 0 THEN 'short covering' WHEN doi > 0 THEN 'new shorts' ELSE 'long unwinding' END AS regime FROM g"))
def stream_regime(spark, sf):
    return drained(live.open_interest_regime(ticker_stream(spark, sf), "1 hour"))


@query("stream_tee", "WITH " + TICKS + " SELECT symbol, count(*) AS recorded, round(sum(amount), 6) AS amount, count(*) AS served FROM ticks GROUP BY 1")
def stream_tee(spark, sf):
    """Rows recorded and rows served from one stream agree."""
    recorded, served, state = shared_paths(spark, "recorded", "served", "state")

    def serve(batch: DataFrame, epoch: int) -> None:
        batch.groupBy("symbol").agg(F.count(F.lit(1)).alias("served")).write.mode("overwrite").parquet(f"{served}/epoch={epoch}")

    live.tee(trade_stream(spark, sf), recorded, state, serve).trigger(availableNow=True).start().awaitTermination()
    kept = spark.read.parquet(recorded).groupBy("symbol").agg(F.count(F.lit(1)).alias("recorded"), F.sum("amount").alias("amount"))
    return kept.join(spark.read.parquet(served).groupBy("symbol").agg(F.sum("served").alias("served")), "symbol")


NULLED = RETS + ", x AS (SELECT * FROM (SELECT symbol, t, sign(r) AS side, lead(r) OVER (PARTITION BY symbol ORDER BY t) AS f FROM rets) WHERE side IS NOT NULL AND f IS NOT NULL), a AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM x), b AS (SELECT symbol, side, row_number() OVER (PARTITION BY symbol ORDER BY md5('1:' || t), t) AS i FROM x)"


@query("matched_null", out(NULLED, "symbol n", "mean null_mean", "SELECT a.symbol, count(*) AS n, avg(a.side * f) AS mean, avg(b.side * f) AS null_mean FROM a JOIN b ON a.symbol = b.symbol AND a.i = b.i GROUP BY 1"))
def matched_null(spark, sf):
    """A signal's mean return beside that of the same signals dealt to other bars."""
    d = with_returns(spark, sf).withColumns({"side": F.signum("r"), "f": F.lead("r").over(ordered(KEY)), "t": F.unix_timestamp("ts")}).where("side IS NOT NULL AND f IS NOT NULL").select("symbol", "t", "side", "f")
    null = inference.permuted(d.withColumn("null_side", F.col("side")), ["null_side"], key=KEY, order="t")
    return null.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("side") * F.col("f")).alias("mean"), F.avg(F.col("null_side") * F.col("f")).alias("null_mean"))


@query("matched_null_levels", out(BARS + ", d AS (SELECT *, lag(high, 1) OVER w AS level FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t)), e AS (SELECT *, level * (1 + 0.02 * (2 * (('0x' || substr(md5('1:' || t), 1, 8))::BIGINT / 4294967295.0) - 1)) AS moved FROM d WHERE level IS NOT NULL)", "symbol n touched moved_touched", "", "SELECT symbol, count(*) AS n, count(*) FILTER (level BETWEEN low AND high) AS touched, count(*) FILTER (moved BETWEEN low AND high) AS moved_touched FROM e GROUP BY 1"))
def matched_null_levels(spark, sf):
    """Bars that touch the last bar's high, and those that touch it moved at random."""
    d = bars(spark, sf).withColumns({"level": F.lag("high").over(ordered(KEY)), "t": F.unix_timestamp("ts")}).where("level IS NOT NULL")
    d = inference.displaced(d.withColumn("moved", F.col("level")), "moved", "t")

    def touched(c: str):
        return F.count(F.when(F.col(c).between(F.col("low"), F.col("high")), 1))

    return d.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), touched("level").alias("touched"), touched("moved").alias("moved_touched"))


@query("meta_labels", f"SELECT eid, CASE WHEN label = 1 THEN 1 ELSE 0 END AS y FROM ({ORACLES['triple_barrier']})")
def meta_labels(spark, sf):
    """Whether an event's own direction reached its profit barrier first."""
    from tidemark.plans.event_queries import busy, indexed

    lab = events.triple_barrier(busy(spark, sf), indexed(spark, sf), 24, F.lit(0.8), F.lit(0.5), key=KEY, event_id="eid")
    return meta.meta_labels(lab).select("eid", "y")
