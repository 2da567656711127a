"""Tables that queries share, in Spark and as SQL text, and the query registry."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.grid import resample_ohlcv
from tidemark.operators.rolling import log_return
from tidemark.operators.shared import checkpoint_root

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEY = ["symbol"]
HOUR_PPY = 8760.0


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; its doubles are rounded and its times become epoch seconds."""

    def register(fn: Query) -> Query:
        QUERIES[name] = lambda spark, sf_dir: tidy(fn(spark, sf_dir))
        if sql:
            ORACLES[name] = sql
        return fn

    return register


def rounded(c: Column | str, digits: int) -> Column:
    """A double to ``digits`` decimals as SQL does it: scaled, to the whole number, scaled back.

    ``F.round`` judges the shortest decimal text instead, so it differs where a product is a tie that the text just misses.
    """
    x = F.col(c) if isinstance(c, str) else c
    scaled = x * 10.0**digits
    return F.when(F.abs(scaled) < float("inf"), F.round(scaled) / 10.0**digits).otherwise(x)


def tidy(df: DataFrame, digits: int = 6) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            c = rounded(c, digits)
        elif isinstance(f.dataType, T.FloatType):
            c = F.round(c, digits)
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)):
            c = F.unix_timestamp(c.cast("timestamp"))
        cols.append(c.alias("t" if f.name == "ts" else f.name))
    return df.select(*cols)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_paths(spark: SparkSession, *kinds: str) -> list[str]:
    """New paths in the folder that all executors share; a local one only where Spark runs on this machine."""
    root = checkpoint_root(spark)
    return [f"{root}/{kind}-{uuid.uuid4().hex}" for kind in kinds]


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(symbol, ts, price, amount, user_id, event_id, props) from events."""
    e = table(spark, sf_dir, "events")
    return e.select(
        F.col("event_type").alias("symbol"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("price"), (F.col("user_id") % 10 + 1).cast("double").alias("amount"), "user_id", "event_id", "props"
    )


def bars(spark: SparkSession, sf_dir: str, width: str = "hour") -> DataFrame:
    return resample_ohlcv(ticks(spark, sf_dir), width, key=KEY, volume="amount", tie="event_id")


def with_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bars(spark, sf_dir).withColumn("r", log_return("close", KEY))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trade ledger: one row per line item; pnl is price times (discount - 0.05)."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("", "l_returnflag", "l_linestatus").alias("symbol"), F.col("l_shipdate").cast("timestamp").alias("entry"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("trade_id"), "l_linenumber",
        F.col("l_extendedprice").alias("notional"), rounded(F.col("l_extendedprice") * (F.col("l_discount") - 0.05), 4).alias("pnl"), F.col("l_quantity").alias("hours"),
    )


TICKS = "ticks AS (SELECT event_type AS symbol, ts, epoch(date_trunc('second', ts))::BIGINT AS s, value AS price, (user_id % 10 + 1)::DOUBLE AS amount, user_id, event_id, props FROM events)"
BARS = (
    TICKS + ", bars AS (SELECT symbol, epoch(date_trunc('hour', ts))::BIGINT AS t, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low, "
    "last(price ORDER BY ts, event_id) AS close, sum(amount) AS volume FROM ticks GROUP BY 1, 2)"
)
LOGR = "CASE WHEN close > 0 AND lag(close) OVER w > 0 THEN ln(close / lag(close) OVER w) END"
RETS = BARS + f", rets AS (SELECT *, {LOGR} AS r FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY t))"
TRADES = (
    "trades AS (SELECT l_returnflag || l_linestatus AS symbol, l_shipdate AS entry, l_orderkey * 10 + l_linenumber AS trade_id, l_linenumber, l_extendedprice AS notional, "
    "round(l_extendedprice * (l_discount - 0.05), 4) AS pnl, l_quantity AS hours FROM lineitem)"
)
W = "WINDOW w AS (PARTITION BY symbol ORDER BY t)"


def out(ctes: str, ids: str, doubles: str, body: str, digits: int = 6) -> str:
    """SELECT ids, rounded doubles FROM (body)."""
    cols = [*ids.split(), *[f"round({c}, {digits}) AS {c}" for c in doubles.split()]]
    return f"WITH {'RECURSIVE ' if 'UNION ALL SELECT n.' in ctes else ''}{ctes} SELECT {', '.join(cols)} FROM ({body})"


def ewm_sql(source: str, x: str, alpha: float | str, name: str, first: str | None = None) -> str:
    """CTEs ``name``_n and ``name`` (symbol, t, rn, y): the recursive mean of ``x`` where it is not null."""
    return (
        f"{name}_n AS (SELECT symbol, t, {x} AS x, row_number() OVER (PARTITION BY symbol ORDER BY t) AS rn FROM {source} WHERE {x} IS NOT NULL), "
        f"{name} AS (SELECT symbol, t, rn, x::DOUBLE AS y FROM {name}_n WHERE rn = 1 UNION ALL SELECT n.symbol, n.t, n.rn, (1 - {alpha}) * e.y + {alpha} * n.x FROM {name} e JOIN {name}_n n ON n.symbol = e.symbol AND n.rn = e.rn + 1)"
    )
