"""Named features and research tools.

A feature is a function of bars with a name, the features it builds on and a look-back.
``compute`` reads from the longest look-back before the start, so that windows are full
at the start, and cuts the padding off again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.shared import cut


@dataclass(frozen=True)
class Feature:
    name: str
    make: Callable[[DataFrame], DataFrame]
    deps: tuple[str, ...] = ()
    lookback: timedelta = timedelta(0)


FEATURES: dict[str, Feature] = {}


def feature(name: str, *, deps: tuple[str, ...] = (), lookback: timedelta = timedelta(0)):
    """Register ``make(df)``, which adds the column ``name`` to bars that hold ``deps``."""

    def register(make: Callable[[DataFrame], DataFrame]):
        if name in FEATURES and FEATURES[name].make is not make:
            raise ValueError(f"feature {name} exists already")
        FEATURES[name] = Feature(name, make, deps, lookback)
        return make

    return register


def resolved(names: list[str]) -> list[Feature]:
    """The features and what they build on, in order; a cycle or an unknown name raises."""
    out: list[Feature] = []
    state: dict[str, int] = {}

    def visit(name: str) -> None:
        if state.get(name) == 2:
            return
        if state.get(name) == 1:
            raise ValueError(f"features build on each other: {name}")
        if name not in FEATURES:
            raise KeyError(f"no such feature: {name}")
        state[name] = 1
        for d in FEATURES[name].deps:
            visit(d)
        state[name] = 2
        out.append(FEATURES[name])

    for n in names:
        visit(n)
    return out


def warm_up(names: list[str]) -> timedelta:
    """Look-back of the features with that of all they build on."""

    def own(name: str) -> timedelta:
        f = FEATURES[name]
        return f.lookback + max((own(d) for d in f.deps), default=timedelta(0))

    resolved(names)
    return max((own(n) for n in names), default=timedelta(0))


def compute(bars: DataFrame, names: list[str], start: datetime, end: datetime, *, keys: list[str], ts: str = "ts") -> DataFrame:
    """(keys, ts, names) of start <= ts < end, from bars padded by the warm-up."""
    df = bars.where((F.col(ts) >= F.lit(start - warm_up(names))) & (F.col(ts) < F.lit(end)))
    for f in resolved(names):
        df = f.make(df)
    return df.where(F.col(ts) >= F.lit(start)).select(*keys, ts, *names)


_COVERAGE = "feature string, key string, period timestamp, upto timestamp"


def _periods(start: datetime, end: datetime, unit: str) -> list[tuple[datetime, datetime]]:
    """Calendar days, weeks (from Monday) or months that [start, end) touches, as half-open spans."""
    day = start.replace(hour=0, minute=0, second=0, microsecond=0)
    at = day if unit == "day" else day - timedelta(days=day.weekday()) if unit == "week" else day.replace(day=1)
    out = []
    while at < end:
        after = at + timedelta(days=1 if unit == "day" else 7) if unit != "month" else (at.replace(day=28) + timedelta(days=4)).replace(day=1)
        out.append((at, after))
        at = after
    return out


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at ``path``, empty where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def read_through(bars: DataFrame, names: list[str], start: datetime, end: datetime, root: str, *, key: str = "symbol", ts: str = "ts", unit: str = "month") -> DataFrame:
    """(key, ts, names) of start <= ts < end, kept under ``root``: only what is missing there is computed.

    ``root/values`` has a partition for each (feature, period), ``root/coverage`` a row for each
    (feature, key, period) with the time up to which it was computed. A period of a key that reaches
    what is asked is read; others are computed, from their start and with warm-up, and replace what
    is there. Coverage follows the values, so a write that fails is done again. One writer at a time.
    """
    spark = bars.sparkSession
    spans = _periods(start, end, unit)
    values = f"feature string, period string, {key} string, {ts} timestamp, value double"
    wanted = spark.createDataFrame([(n, a, min(b, end)) for n in names for a, b in spans], "feature string, period timestamp, until timestamp")
    span = bars.where((F.col(ts) >= F.lit(spans[0][0])) & (F.col(ts) < F.lit(end)))
    owned = span.select(F.col(key).cast("string").alias("key"), F.date_trunc(unit, ts).alias("period")).distinct()
    covered = _stored(spark, f"{root}/coverage", _COVERAGE).groupBy("feature", "key", "period").agg(F.max("upto").alias("upto"))
    missing = owned.join(F.broadcast(wanted), "period").join(covered, ["feature", "key", "period"], "left").where("upto IS NULL OR upto < until")
    missing = cut(missing.select("feature", "key", "period", "until"))  # a row for each key and period at most
    todo = [r["feature"] for r in missing.select("feature").distinct().collect()]
    if todo:
        first = missing.agg(F.min("period")).first()[0]
        asked = bars.join(F.broadcast(missing.select(F.col("key").alias(key)).distinct()), key, "left_semi")
        made = compute(asked, todo, first, end, keys=[key], ts=ts).withColumn("period", F.date_trunc(unit, ts))
        long = made.select(F.col(key).cast("string").alias(key), ts, "period", F.explode(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in todo])).alias("e"))
        long = long.select("e.feature", "period", key, ts, "e.value")
        fresh = long.join(missing.withColumnRenamed("key", key), ["feature", key, "period"], "left_semi")
        touched = missing.select("feature", F.date_format("period", "yyyy-MM-dd").alias("period"), F.col("key").alias(key)).distinct()
        partitions = touched.select("feature", "period").distinct()
        kept = _stored(spark, f"{root}/values", values).join(partitions, ["feature", "period"], "left_semi").join(touched, ["feature", "period", key], "left_anti")
        rows = kept.unionByName(fresh.withColumn("period", F.date_format("period", "yyyy-MM-dd")))
        cut(rows).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("feature", "period").parquet(f"{root}/values")
        missing.withColumnRenamed("until", "upto").write.mode("append").parquet(f"{root}/coverage")
    found = _stored(spark, f"{root}/values", values)
    found = found.where(F.col("feature").isin(names) & F.col("period").isin([a.strftime("%Y-%m-%d") for a, _ in spans]) & (F.col(ts) >= F.lit(start)) & (F.col(ts) < F.lit(end)))
    found = found.join(owned.select(F.col("key").alias(key)).distinct(), key, "left_semi")  # others may keep keys there too
    return found.groupBy(key, ts).agg(*[F.max(F.when(F.col("feature") == n, F.col("value"))).alias(n) for n in names])


TOOLS: dict[str, Callable[..., DataFrame]] = {}


def research_tool(name: str):
    """Register a tool: a function of rows that returns a metrics table; it only ever sees train rows."""

    def register(fn: Callable[..., DataFrame]):
        TOOLS[name] = fn
        return fn

    return register


def train_only(df: DataFrame, train_end: datetime, holdout_start: datetime, ts: str = "ts") -> DataFrame:
    """Rows before the earlier of the two times."""
    return df.where(F.col(ts) < F.lit(min(train_end, holdout_start)))


def run_tool(name: str, df: DataFrame, train_end: datetime, holdout_start: datetime, *, ts: str = "ts", **params) -> DataFrame:
    """(tool, metric, value, ...) of a tool over train rows."""
    got = TOOLS[name](train_only(df, train_end, holdout_start, ts), **params)
    return got.withColumn("tool", F.lit(name))
