"""Queries: sources, grids, filters and joins."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import book, grid, joins, rolling
from tidemark.plans.base import BARS, KEY, RETS, TICKS, TRADES, bars, out, query, table, ticks, trades, with_returns
from tidemark.sources import market


@query("ohlcv_hourly", out(BARS, "symbol t", "open high low close volume", "SELECT * FROM bars"))
def ohlcv_hourly(spark, sf):
    return bars(spark, sf)


@query("rebar_daily", out(BARS, "symbol t", "open high low close volume", "SELECT symbol, (t // 86400 * 86400)::BIGINT AS t, first(open ORDER BY t) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY t) AS close, sum(volume) AS volume FROM bars GROUP BY symbol, t // 86400"))
def rebar_daily(spark, sf):
    return grid.rebar(bars(spark, sf), "day", key=KEY)


@query("bars_15m", out(TICKS, "symbol t", "open high low close volume", "SELECT symbol, (s // 900 * 900)::BIGINT AS t, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY ts, event_id) AS close, sum(amount) AS volume FROM ticks GROUP BY symbol, s // 900"))
def bars_15m(spark, sf):
    return bars(spark, sf, "15 minutes")


@query("top_by_volume", out(BARS, "symbol", "quote_volume", "SELECT symbol, sum(close * volume) AS quote_volume FROM bars WHERE t >= epoch(TIMESTAMP '2024-01-05') AND t < epoch(TIMESTAMP '2024-01-20') GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"))
def top_by_volume(spark, sf):
    """Top three symbols by traded value in [start, end)."""
    b = bars(spark, sf).where((F.col("ts") >= F.lit("2024-01-05").cast("timestamp")) & (F.col("ts") < F.lit("2024-01-20").cast("timestamp")))
    return b.groupBy("symbol").agg(F.sum(F.col("close") * F.col("volume")).alias("quote_volume")).orderBy(F.desc("quote_volume"), "symbol").limit(3)


@query("alive_symbols", "WITH " + BARS + " SELECT symbol, count(*) AS rows FROM bars GROUP BY 1 HAVING count(*) >= 0.9 * 720")
def alive_symbols(spark, sf):
    return bars(spark, sf).groupBy("symbol").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") >= 0.9 * 720)


@query("month_coverage", "WITH " + BARS + " SELECT symbol, min(t) AS first, max(t) AS last, count(DISTINCT strftime(to_timestamp(t) AT TIME ZONE 'UTC', '%Y-%m')) AS n_months FROM bars GROUP BY 1")
def month_coverage(spark, sf):
    return market.coverage(bars(spark, sf)).drop("months")


@query("complete_symbols", "WITH " + BARS + " SELECT symbol FROM bars GROUP BY 1 HAVING bool_or(t < epoch(TIMESTAMP '2024-02-01'))")
def complete_symbols(spark, sf):
    return market.complete_symbols(bars(spark, sf), ["2024-01"])


@query("completeness_audit", "WITH " + BARS + " SELECT symbol, epoch(TIMESTAMP '2024-01-01')::BIGINT AS month, count(*) AS rows, 744::BIGINT AS expected, count(*) >= 744 * 0.995 AS complete FROM bars GROUP BY 1")
def completeness_audit(spark, sf):
    return market.completeness(bars(spark, sf), 3600, 0.005)


@query("clean_first_per_minute", "WITH " + TICKS + ", m AS (SELECT symbol, (s // 60 * 60)::BIGINT AS t, event_id, row_number() OVER (PARTITION BY symbol, s // 60 ORDER BY event_id) AS rn FROM ticks) SELECT symbol, t, event_id FROM m WHERE rn = 1")
def clean_first_per_minute(spark, sf):
    """Duplicates in a minute: the first by id stays."""
    m = ticks(spark, sf).select("symbol", F.date_trunc("minute", "ts").alias("ts"), "event_id")
    return market.clean(m, key=KEY, tie="event_id")


@query("panel_export", out(BARS, "t", "click error purchase signup view", "SELECT t, " + ", ".join(f"max(close) FILTER (symbol = '{s}') AS {s}" for s in ("click", "error", "purchase", "signup", "view")) + " FROM bars GROUP BY t"))
def panel_export(spark, sf):
    return grid.panel(bars(spark, sf), "close")


@query("window_labels", "WITH " + BARS + " SELECT symbol, CASE WHEN t < epoch(TIMESTAMP '2024-01-10') THEN 'TRAIN' WHEN t < epoch(TIMESTAMP '2024-01-20') THEN 'VALID' WHEN t < epoch(TIMESTAMP '2024-01-28') THEN 'TEST' ELSE 'OUT' END AS label, count(*) AS n FROM bars GROUP BY 1, 2")
def window_labels(spark, sf):
    from tidemark.operators.folds import label_windows

    return bars(spark, sf).groupBy("symbol", label_windows(F.col("ts"), "2024-01-10", "2024-01-20", "2024-01-28").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query("session_hours", "WITH " + TICKS + " SELECT symbol, count(*) AS n FROM ticks WHERE hour(ts) + minute(ts) / 60.0 >= 7.5 AND hour(ts) + minute(ts) / 60.0 < 11 GROUP BY 1")
def session_hours(spark, sf):
    clock = F.hour("ts") + F.minute("ts") / 60
    return ticks(spark, sf).where((clock >= 7.5) & (clock < 11)).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query("every_12th_bar", "WITH " + BARS + " SELECT symbol, t FROM (SELECT symbol, t, row_number() OVER (PARTITION BY symbol ORDER BY t) - 1 AS i FROM bars) WHERE i % 12 = 0")
def every_12th_bar(spark, sf):
    return rolling.every_kth(bars(spark, sf), 12, KEY).select("symbol", "ts")


@query("staged_guard", "SELECT count(*) AS input, count(*) FILTER (l_shipdate >= TIMESTAMP '1996-01-01') AS dated, count(*) FILTER (l_shipdate >= TIMESTAMP '1996-01-01' AND l_quantity >= 10) AS active, count(*) FILTER (l_shipdate >= TIMESTAMP '1996-01-01' AND l_quantity >= 10 AND l_returnflag IN ('A', 'N')) AS universe FROM lineitem")
def staged_guard(spark, sf):
    li = table(spark, sf, "lineitem")
    return book.staged(li, [("dated", F.col("l_shipdate") >= F.lit("1996-01-01").cast("timestamp")), ("active", F.col("l_quantity") >= 10), ("universe", F.col("l_returnflag").isin("A", "N"))])[1]


@query("in_intervals", "WITH " + BARS + " SELECT symbol, count(*) AS n FROM bars WHERE (t >= epoch(TIMESTAMP '2024-01-03') AND t < epoch(TIMESTAMP '2024-01-06')) OR (t >= epoch(TIMESTAMP '2024-01-05') AND t < epoch(TIMESTAMP '2024-01-09')) GROUP BY 1")
def in_intervals(spark, sf):
    spans = spark.createDataFrame([("2024-01-03", "2024-01-06"), ("2024-01-05", "2024-01-09")], "a string, b string").select(F.col("a").cast("timestamp").alias("start"), F.col("b").cast("timestamp").alias("end"))
    return joins.in_any_interval(bars(spark, sf), spans).groupBy("symbol").agg(F.count(F.lit(1)).alias("n"))


@query(
    "asof_funding",
    out(BARS, "event_id symbol", "price bar_close", "SELECT l.event_id, l.symbol, l.price, b.close AS bar_close FROM ticks l ASOF LEFT JOIN (SELECT symbol, to_timestamp(t) AT TIME ZONE 'UTC' AS bt, close FROM bars) b ON l.symbol = b.symbol AND l.ts >= b.bt"),
)
def asof_funding(spark, sf):
    """Backward as-of: every tick with the bar that began at or before it."""
    t = ticks(spark, sf).select("symbol", "ts", "event_id", "price")
    b = bars(spark, sf).select("symbol", "ts", F.col("close").alias("bar_close"))
    return joins.asof_join(t, b, ["bar_close"], key=KEY).select("event_id", "symbol", "price", "bar_close")


@query(
    "asof_other_symbol",
    out(TICKS, "event_id", "price ref", "SELECT l.event_id, l.price, r.price AS ref FROM (SELECT * FROM ticks WHERE symbol = 'purchase') l ASOF JOIN (SELECT ts, price FROM ticks WHERE symbol = 'click') r ON l.ts > r.ts"),
)
def asof_other_symbol(spark, sf):
    """Strictly earlier match on another stream; unmatched rows vanish."""
    t = ticks(spark, sf)
    left = t.where("symbol = 'purchase'").select("ts", "event_id", "price")
    right = t.where("symbol = 'click'").select("ts", "event_id", F.col("price").alias("ref"))
    return joins.asof_join(left.withColumn("g", F.lit(1)), right.withColumn("g", F.lit(1)), ["ref"], key=["g"], tie="event_id", how="inner", strict=True).select("event_id", "price", "ref")


@query(
    "higher_timeframe_lag",
    out(BARS, "symbol t", "close htf_close", "SELECT b.symbol, b.t, b.close, last_value(d.prev IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.t) AS htf_close FROM bars b LEFT JOIN (SELECT symbol, t, lag(c) OVER (PARTITION BY symbol ORDER BY t) AS prev FROM (SELECT symbol, (t // 14400 * 14400)::BIGINT AS t, last(close ORDER BY t) AS c FROM bars GROUP BY symbol, t // 14400)) d ON b.symbol = d.symbol AND b.t = d.t"),
)
def higher_timeframe_lag(spark, sf):
    return grid.higher_timeframe(bars(spark, sf), "4 hours", {"close": F.max_by("close", "ts")}, key=KEY).select("symbol", "ts", "close", "htf_close")


@query("symbol_pair_join", "WITH " + BARS + " SELECT a.symbol AS a, b.symbol AS b, count(*) AS n, round(sum(a.close * b.close), 6) AS cross_sum FROM bars a JOIN bars b ON a.t = b.t AND a.symbol < b.symbol GROUP BY 1, 2")
def symbol_pair_join(spark, sf):
    return joins.symbol_pairs(bars(spark, sf), "close").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("va") * F.col("vb")).alias("cross_sum"))


@query("accounted_join", "SELECT (SELECT count(*) FROM orders) AS rows_before, (SELECT count(*) FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey) AS rows_after")
def accounted_join(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_custkey").alias("custkey"), "o_totalprice")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("custkey"), "c_nationkey")
    return joins.joined_with_accounting(o, c, ["custkey"], "inner", narrowing=True)[1]


@query(
    "outer_aligned",
    out(BARS, "symbol t", "close", "SELECT symbol, t, coalesce(f, first_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS close FROM (SELECT s.symbol, x.t, b.close, last_value(b.close IGNORE NULLS) OVER (PARTITION BY s.symbol ORDER BY x.t) AS f FROM (SELECT DISTINCT symbol FROM bars) s CROSS JOIN (SELECT DISTINCT t FROM bars) x LEFT JOIN bars b ON b.symbol = s.symbol AND b.t = x.t)"),
)
def outer_aligned(spark, sf):
    return joins.outer_align(bars(spark, sf), "close")


@query(
    "fold_assignment",
    out(RETS, "fold role symbol n", "mean", "SELECT f.fold, f.role, symbol, count(r) AS n, avg(r) AS mean FROM rets JOIN (SELECT i::VARCHAR AS fold, 'train' AS role, epoch(TIMESTAMP '2024-01-01') + i * 5 * 86400 AS a, epoch(TIMESTAMP '2024-01-11') + i * 5 * 86400 AS b FROM range(4) x(i) UNION ALL SELECT i::VARCHAR, 'oos', epoch(TIMESTAMP '2024-01-11') + i * 5 * 86400, epoch(TIMESTAMP '2024-01-16') + i * 5 * 86400 FROM range(4) x(i)) f ON t >= f.a AND t < f.b GROUP BY 1, 2, 3"),
)
def fold_assignment(spark, sf):
    from datetime import datetime, timedelta

    from tidemark.operators import folds

    rows = folds.walk_forward(datetime(2024, 1, 1), datetime(2024, 1, 31), 4, timedelta(days=10))
    table_ = spark.createDataFrame([(f, r, str(a), str(b)) for f, r, a, b in rows], "fold string, role string, a string, b string")
    table_ = table_.select("fold", "role", F.col("a").cast("timestamp").alias("start"), F.col("b").cast("timestamp").alias("end"))
    return joins.assign_folds(with_returns(spark, sf), table_).groupBy("fold", "role", "symbol").agg(F.count("r").alias("n"), F.avg("r").alias("mean"))


@query("users_in_many_types", "SELECT user_id, count(DISTINCT event_type) AS folds FROM events GROUP BY 1 HAVING count(DISTINCT event_type) > 1")
def users_in_many_types(spark, sf):
    return joins.seen_in_many(table(spark, sf, "events"), ["user_id"], "event_type")


@query("radius_pairs", out("p AS (SELECT o_custkey AS pid, avg(o_totalprice) / 100000.0 AS x, count(*) / 10.0 AS y FROM orders GROUP BY 1)", "p q", "distance", "SELECT a.pid AS p, b.pid AS q, sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) AS distance FROM p a JOIN p b ON a.pid < b.pid WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= 0.02"))
def radius_pairs(spark, sf):
    """Customers with as many orders and near mean prices; sums run in order of the rows of the files, as SQL's do, since ties of the last decimal depend on it."""
    o = Window.partitionBy("o_custkey").orderBy("file", "row")
    rows = table(spark, sf, "orders").select("o_custkey", "o_totalprice", F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    rows = rows.select("o_custkey", "o_totalprice", F.row_number().over(o).alias("i"), F.sum("o_totalprice").over(o.rowsBetween(Window.unboundedPreceding, 0)).alias("s"))
    p = rows.groupBy(F.col("o_custkey").alias("pid")).agg((F.try_divide(F.max_by("s", "i"), F.count("o_totalprice")) / 100000.0).alias("x"), (F.count(F.lit(1)) / 10.0).alias("y"))
    return joins.within_radius(p, ["x", "y"], 0.02)


@query("breadth", "WITH " + TICKS + " SELECT event_id, count(*) OVER (ORDER BY s RANGE BETWEEN 1800 PRECEDING AND CURRENT ROW) AS breadth FROM ticks")
def breadth(spark, sf):
    """Events of all symbols in the half hour up to each one."""
    return joins.trailing_count(ticks(spark, sf), 1800).select("event_id", "breadth")


@query("grid_last_10m", out(TICKS, "symbol t", "price", "SELECT g.symbol, g.t, last_value(x.p IGNORE NULLS) OVER (PARTITION BY g.symbol ORDER BY g.t) AS price FROM (SELECT symbol, unnest(range(min(s) // 600 * 600, max(s) + 1, 600))::BIGINT AS t FROM ticks GROUP BY 1) g LEFT JOIN (SELECT symbol, s // 600 * 600 AS t, last(price ORDER BY ts, event_id) AS p FROM ticks GROUP BY 1, 2) x ON g.symbol = x.symbol AND g.t = x.t"))
def grid_last_10m(spark, sf):
    return grid.last_on_grid(ticks(spark, sf).select("symbol", "ts", "price", "event_id"), 600, "price", key=KEY, tie="event_id")


@query("fill_with_limit", out(BARS, "symbol t", "close", "SELECT symbol, t, CASE WHEN rn - seen <= 3 THEN c END AS close FROM (SELECT symbol, t, rn, last_value(CASE WHEN close < 40 THEN close END IGNORE NULLS) OVER w AS c, last_value(CASE WHEN close < 40 THEN rn END IGNORE NULLS) OVER w AS seen FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY t) AS rn FROM bars) WINDOW w AS (PARTITION BY symbol ORDER BY t))"))
def fill_with_limit(spark, sf):
    b = bars(spark, sf).select("symbol", "ts", F.when(F.col("close") < 40, F.col("close")).alias("close"))
    return grid.forward_fill(b, ["close"], key=KEY, most_rows=3)


@query("day_pivots", out(BARS, "symbol t", "p r1 s1 r2 s2", "SELECT d.symbol, d.t, (y.h + y.l + y.c) / 3 AS p, 2 * ((y.h + y.l + y.c) / 3) - y.l AS r1, 2 * ((y.h + y.l + y.c) / 3) - y.h AS s1, (y.h + y.l + y.c) / 3 + y.h - y.l AS r2, (y.h + y.l + y.c) / 3 - y.h + y.l AS s2 FROM (SELECT DISTINCT symbol, (t // 86400 * 86400)::BIGINT AS t FROM bars) d LEFT JOIN (SELECT symbol, t // 86400 * 86400 AS t, max(high) AS h, min(low) AS l, last(close ORDER BY t) AS c FROM bars GROUP BY 1, 2) y ON y.symbol = d.symbol AND y.t = d.t - 86400"))
def day_pivots(spark, sf):
    return grid.daily_pivots(bars(spark, sf), key=KEY)


@query("participation", out(TRADES, "trade_id", "notional participation_pct", "SELECT trade_id, notional, notional / nullif(sum(notional) OVER (PARTITION BY symbol, date_trunc('day', entry)), 0) * 100 AS participation_pct FROM trades"))
def participation(spark, sf):
    from tidemark.operators.metrics import capacity

    t = trades(spark, sf)
    day = t.groupBy("symbol", F.date_trunc("day", "entry").alias("ts")).agg(F.sum("notional").alias("close")).withColumn("volume", F.lit(1.0))
    return capacity(t, day).select("trade_id", "notional", "participation_pct")


@query("union_dedup_last", "SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1")
def union_dedup_last(spark, sf):
    """Union of two legs, the last row of each key stays."""
    o = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    both = o.where("o_orderkey % 2 = 0").unionByName(o.where("o_orderkey % 2 = 1"))
    return market.clean(both.withColumn("one", F.lit(1)), key=["o_custkey"], ts="one", tie="o_orderkey", last=True).select("o_custkey", "o_orderkey")


@query("merged_busy_spans", "WITH " + TICKS + ", s AS (SELECT symbol, s AS a, s + 1800 AS b FROM ticks), m AS (SELECT *, max(b) OVER (PARTITION BY symbol ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s), g AS (SELECT *, sum(CASE WHEN reach IS NULL OR a > reach THEN 1 ELSE 0 END) OVER (PARTITION BY symbol ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT symbol, min(a) AS a, max(b) AS b FROM g GROUP BY symbol, g")
def merged_busy_spans(spark, sf):
    from tidemark.operators.folds import merged_spans

    s = ticks(spark, sf).select("symbol", F.unix_timestamp("ts").alias("a"), (F.unix_timestamp("ts") + 1800).alias("b"))
    return merged_spans(s, key=KEY, start="a", end="b")


@query("users_with_large_errors_only", "SELECT user_id FROM events WHERE event_type = 'error' AND value > 80 EXCEPT SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 80")
def users_with_large_errors_only(spark, sf):
    e = table(spark, sf, "events")
    return e.where("event_type = 'error' AND value > 80").select("user_id").subtract(e.where("event_type = 'purchase' AND value > 80").select("user_id"))


@query("common_times", "WITH " + BARS + " SELECT t FROM bars WHERE symbol = 'click' INTERSECT SELECT t FROM bars WHERE symbol = 'view'")
def common_times(spark, sf):
    b = bars(spark, sf)
    return b.where("symbol = 'click'").select("ts").intersect(b.where("symbol = 'view'").select("ts"))


@query("props_json", "SELECT event_type AS symbol, count(*) AS n, sum((props->>'k')::BIGINT) AS k_sum FROM events GROUP BY 1")
def props_json(spark, sf):
    """Field access in JSON text."""
    t = ticks(spark, sf).withColumn("k", F.from_json("props", "k bigint")["k"])
    return t.groupBy("symbol").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("k_sum"))


@query("causality_of_zscore", "SELECT 0::BIGINT AS changed")
def causality_of_zscore(spark, sf):
    """Rows before the cutoff that change when the future is nulled: none."""

    def transform(b):
        return b.withColumn("z", rolling.zscore(F.col("close"), rolling.last_k(20, KEY), 20))

    d = joins.causality_diff(transform, bars(spark, sf), ["close"], F.lit("2024-01-15").cast("timestamp"), ["z"], key=KEY)
    return d.agg(F.count(F.lit(1)).alias("changed"))
