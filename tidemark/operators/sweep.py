"""Parameter grids, sweeps and per-symbol scans."""

from __future__ import annotations

from collections.abc import Callable
from itertools import product

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def grid(spark: SparkSession, space: dict[str, list]) -> DataFrame:
    """(candidate, one column per parameter) of every combination; driver-sized."""
    rows = [(i, *map(float, c)) for i, c in enumerate(dict.fromkeys(product(*space.values())))]
    return spark.createDataFrame(rows, "candidate long, " + ", ".join(f"{n} double" for n in space))


def linear_axis(lo: float, hi: float, n: int, *, whole: bool = False) -> list[float]:
    xs = [lo + (hi - lo) * i / max(1, n - 1) for i in range(n)]
    return sorted({round(x) for x in xs}) if whole else xs


def with_candidates(df: DataFrame, candidates: DataFrame) -> DataFrame:
    """Every row under every candidate; the (small) grid is broadcast."""
    return df.join(F.broadcast(candidates))


def candidate_score(cells: DataFrame, metric: str, trades: str, *, least_trades: float = 30.0) -> DataFrame:
    """Mean less half the deviation over folds, less a penalty for few trades."""
    g = cells.groupBy("candidate").agg(F.avg(metric).alias("mean"), F.coalesce(F.stddev_samp(metric), F.lit(0.0)).alias("std"), F.avg(trades).alias("trades"))
    few = F.greatest(F.lit(0.0), (least_trades - F.col("trades")) / least_trades)
    return g.withColumn("score", F.col("mean") - 0.5 * F.col("std") - few)


def top_share(df: DataFrame, score: str, share: float) -> DataFrame:
    """Rows whose score reaches the (1 - share) quantile."""
    q = df.agg(F.percentile(score, F.lit(1 - share)).alias("__q"))
    return df.join(F.broadcast(q)).where(F.col(score) >= F.col("__q")).drop("__q")


def scan_symbols(df: DataFrame, scanner: Callable[[str], object], schema: T.StructType, *, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Rows of ``scanner(symbol)`` per symbol; a failure becomes a row with ``error``, others go on.

    A scanner has ``add(rows)``, called with batches in time order, and ``rows()``; what
    it holds is its own matter, the symbol's rows are never gathered.
    """
    out = T.StructType([T.StructField(key, T.StringType()), *schema.fields, T.StructField("error", T.StringType())])
    names = [f.name for f in schema.fields]

    def finish(symbol, own, error) -> pd.DataFrame:
        if error is None:
            try:
                return own.rows().assign(**{key: symbol, "error": None})[[key, *names, "error"]]
            except Exception as e:  # reported, not hidden
                error = f"{type(e).__name__}: {e}"
        return pd.DataFrame([{key: symbol, **dict.fromkeys(names), "error": error}])

    def run(parts):
        at, own, error, begun = None, None, None, False
        for pdf in parts:
            change = pdf[key].ne(pdf[key].shift()) & ~(pdf[key].isna() & pdf[key].shift().isna())
            for _, rows in pdf.groupby(change.cumsum(), sort=False):
                symbol = rows[key].iloc[0]
                if not begun or symbol != at:
                    if begun:
                        yield finish(at, own, error)
                    at, error, begun = symbol, None, True
                    try:
                        own = scanner(symbol)
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                if error is None:
                    try:
                        own.add(rows)
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
        if begun:
            yield finish(at, own, error)

    return df.repartition(key).sortWithinPartitions(key, ts).mapInPandas(run, out)
