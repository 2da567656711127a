"""Event book: columns that say when their value is known, and its audit.

Each column's metadata holds ``asof_min``, minutes after entry at which it is known;
0 or less is causal, more is an outcome.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REQUIRED = ("sym", "signal_ts", "entry_ts", "frac")


def declare(df: DataFrame, asof: dict[str, int]) -> DataFrame:
    out = df
    for name, minutes in asof.items():
        out = out.withMetadata(name, {**out.schema[name].metadata, "asof_min": minutes})
    return out


def asof(df: DataFrame) -> dict[str, int]:
    return {f.name: f.metadata["asof_min"] for f in df.schema.fields if "asof_min" in f.metadata}


def add(df: DataFrame, name: str, value: Column, uses: list[str], minutes: int | None = None) -> DataFrame:
    """A derived column, known when the last of its inputs is."""
    known = asof(df)
    latest = max((known[u] for u in uses), default=0)
    if minutes is not None and minutes < latest:
        raise ValueError(f"{name} uses a column known only {latest} minutes after entry")
    return declare(df.withColumn(name, value), {name: latest if minutes is None else minutes})


def causal_filter(df: DataFrame, cond: Column, uses: list[str]) -> DataFrame:
    """Filter by columns known at entry only; null conditions drop the row."""
    known = asof(df)
    late = [u for u in uses if known.get(u, 1) > 0]
    if late:
        raise ValueError(f"not known at entry: {late}")
    read = {c for c in df.columns if _reads(df, cond, c)}
    if read - set(uses):
        raise ValueError(f"the condition reads undeclared columns: {sorted(read - set(uses))}")
    return df.where(F.coalesce(cond, F.lit(False)))


def _reads(df: DataFrame, cond: Column, name: str) -> bool:
    """Does the condition still resolve without the column?"""
    from pyspark.errors import AnalysisException

    try:
        df.drop(name).select(cond.alias("__c")).schema
    except AnalysisException:
        return True
    return False


def audit(df: DataFrame, start: str, end: str) -> DataFrame:
    """Counts of what a book must not hold, in one pass plus one grouping."""
    missing = [c for c in REQUIRED if c not in df.columns]
    undeclared = [c for c in df.columns if c not in asof(df) and c not in REQUIRED]
    bad = lambda c: F.count(F.when(c, 1))
    one = df.agg(
        F.count(F.lit(1)).alias("rows"), bad(F.col("entry_ts") <= F.col("signal_ts")).alias("entry_not_after_signal"), bad(F.col("frac").isNull() | (F.col("frac") > 1)).alias("bad_frac"),
        bad(~F.coalesce((F.col("entry_ts") >= F.lit(start).cast("timestamp")) & (F.col("entry_ts") < F.lit(end).cast("timestamp")), F.lit(False))).alias("outside_windows"),
        bad(F.col("sym").isNull()).alias("no_symbol"),
    )
    twice = df.groupBy("sym", "entry_ts").agg(F.count(F.lit(1)).alias("n")).where("n > 1").agg(F.count(F.lit(1)).alias("duplicates"))
    return one.join(F.broadcast(twice)).withColumns({"missing_columns": F.lit(len(missing)), "undeclared_columns": F.lit(len(undeclared))})


def staged(df: DataFrame, stages: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    """(rows that pass all stages, counts after each stage) from one conditional pass."""
    passed = F.lit(True)
    counts = [F.count(F.lit(1)).alias("input")]
    for name, cond in stages:
        passed = passed & F.coalesce(cond, F.lit(False))
        counts.append(F.count(F.when(passed, 1)).alias(name))
    return df.where(passed), df.agg(*counts)
