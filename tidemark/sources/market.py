"""Market tables on disk: month-partitioned scans, sinks, coverage and audits."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BARS = "symbol string, month string, ts timestamp, open double, high double, low double, close double, volume double"
FUNDING = "symbol string, month string, ts timestamp, rate double"
OPEN_INTEREST = "symbol string, month string, ts timestamp, open_interest double"
SPREADS = "symbol string, month string, ts timestamp, spread_bps double, n_bars int, fallback boolean"
TRADES = "ts_exchange long, ts_local long, symbol string, price double, amount double, side string, id string"
TICKER = "ts_exchange long, ts_local long, symbol string, last double, bid double, bid_size double, ask double, ask_size double, mark double, index double, funding_rate double, open_interest double, base_volume double, quote_volume double"
LIQUIDATIONS = "ts_exchange long, ts_local long, symbol string, side string, price double, amount double"


def book_schema(depth: int = 25) -> str:
    sides = [f"{s}_{f}_{i} double" for i in range(depth) for s in ("bid", "ask") for f in ("px", "sz")]
    return "ts_exchange long, ts_local long, symbol string, " + ", ".join(sides)


def write_months(df: DataFrame, path: str, *, ts: str = "ts", mode: str = "append") -> None:
    """Zstd Parquet by symbol and month; re-writing a month replaces only that month."""
    out = df.withColumn("month", F.date_format(ts, "yyyy-MM")).repartition("symbol", "month").sortWithinPartitions("symbol", "month", ts)
    out.write.mode(mode).option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "month").parquet(path)


def scan(spark: SparkSession, path: str, schema: str, *, symbols: list[str] | None = None, start: datetime | None = None, end: datetime | None = None) -> DataFrame:
    """Rows with start <= ts < end; months and symbols outside are never opened.

    A path without data gives an empty, typed table.
    """
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)
    if symbols is not None:
        df = df.where(F.col("symbol").isin(symbols))
    if start is not None:
        df = df.where((F.col("month") >= start.strftime("%Y-%m")) & (F.col("ts") >= F.lit(start)))
    if end is not None:
        df = df.where((F.col("month") <= end.strftime("%Y-%m")) & (F.col("ts") < F.lit(end)))
    return df


def symbols(df: DataFrame, key: str = "symbol") -> DataFrame:
    return df.select(key).distinct()


def coverage(df: DataFrame, *, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """First and last time and the months present, per symbol."""
    m = F.date_format(ts, "yyyy-MM")
    return df.groupBy(key).agg(F.min(ts).alias("first"), F.max(ts).alias("last"), F.count_distinct(m).alias("n_months"), F.array_sort(F.collect_set(m)).alias("months"))


def complete_symbols(df: DataFrame, months: list[str], *, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Symbols with data in every wanted month."""
    want = F.array(*[F.lit(m) for m in months])
    return coverage(df, key=key, ts=ts).where(F.size(F.array_except(want, "months")) == 0).select(key)


def completeness(df: DataFrame, seconds: int, tolerance: float, *, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Rows against the expected number of each calendar month."""
    month = F.date_trunc("month", ts)
    g = df.groupBy(key, month.alias("month")).agg(F.count(F.lit(1)).alias("rows"))
    expected = F.dayofmonth(F.last_day("month")) * (86_400 // seconds)
    return g.withColumn("expected", expected.cast("long")).withColumn("complete", F.col("rows") >= F.col("expected") * (1 - tolerance))


def clean(df: DataFrame, *, key: list[str], ts: str = "ts", tie: str, start: datetime | None = None, end: datetime | None = None, last: bool = False) -> DataFrame:
    """One row per (key, time): the first (or last) by ``tie``; clipped to [start, end)."""
    order = F.col(tie).desc() if last else F.col(tie).asc()
    out = df.withColumn("__r", F.row_number().over(Window.partitionBy(*key, ts).orderBy(order))).where("__r = 1").drop("__r")
    if start is not None:
        out = out.where(F.col(ts) >= F.lit(start))
    return out.where(F.col(ts) < F.lit(end)) if end is not None else out


def tick_session(spark: SparkSession, root: str, session: str, stream: str, symbol: str) -> DataFrame:
    """Part files of one stream; times as timestamps, arrival order kept in ``ts_local``."""
    df = spark.read.parquet(f"{root}/session={session}/stream={stream}/symbol={symbol}")
    return df.withColumns({"ts": F.timestamp_millis("ts_exchange"), "arrived": F.timestamp_millis("ts_local")})


def run_history(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; broken lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def upsert_months(spark: SparkSession, path: str, schema: str, fresh: DataFrame, *, key: list[str], ts: str = "ts") -> None:
    """Merge rows in, the newest write winning; only the months touched are rewritten."""
    months = fresh.withColumn("month", F.date_format(ts, "yyyy-MM")).select("symbol", "month").distinct()
    old = scan(spark, path, schema).join(months, ["symbol", "month"], "left_semi").drop("month").withColumn("__seq", F.lit(0))
    merged = clean(old.unionByName(fresh.withColumn("__seq", F.lit(1))), key=key, ts=ts, tie="__seq", last=True).drop("__seq")
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if shared is None:
        raise ValueError("set spark.checkpoint.dir: the months are read and replaced")
    write_months(merged.checkpoint(), path, ts=ts, mode="overwrite")


def save_book(df: DataFrame, path: str, params: dict) -> DataFrame:
    """Write an event book and a one-row manifest beside it."""
    import json

    df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    manifest = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("sym").alias("symbols"), F.min("entry_ts").alias("first"), F.max("entry_ts").alias("last")).withColumns(
        {"schema": F.lit(df.schema.json()), "params": F.lit(json.dumps(params, sort_keys=True))}
    )
    manifest.coalesce(1).write.mode("overwrite").json(f"{path}/manifest")
    return rows
