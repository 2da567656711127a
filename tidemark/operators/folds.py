"""Splits, purged folds and overfit statistics."""

from __future__ import annotations

from datetime import datetime, timedelta
from itertools import combinations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

Row = tuple[str, str, datetime, datetime]


def train_test(start: datetime, end: datetime, share: float, embargo: timedelta = timedelta(0)) -> list[Row]:
    """One train and one out-of-sample interval, half-open, with a gap between."""
    cut = start + (end - start) * share
    if cut + embargo >= end:
        raise ValueError("the embargo leaves no out-of-sample time")
    return [("0", "train", start, cut), ("0", "oos", cut + embargo, end)]


def walk_forward(start: datetime, end: datetime, n: int, train: timedelta, *, expanding: bool = False, embargo: timedelta = timedelta(0)) -> list[Row]:
    """``n`` successive out-of-sample intervals after the first training span."""
    step = (end - start - train) / n
    if step <= embargo:
        raise ValueError("the embargo leaves no out-of-sample time")
    out: list[Row] = []
    for i in range(n):
        cut = start + train + step * i
        out += [(str(i), "train", start if expanding else cut - train, cut), (str(i), "oos", cut + embargo, cut + step)]
    return out


def merge_intervals(spans: list[tuple]) -> list[tuple]:
    out: list[list] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return [tuple(x) for x in out]


def subtract_intervals(spans: list[tuple], holes: list[tuple]) -> list[tuple]:
    out = []
    for a, b in merge_intervals(spans):
        for x, y in merge_intervals(holes):
            if y <= a or x >= b:
                continue
            if x > a:
                out.append((a, x))
            a = max(a, y)
        if a < b:
            out.append((a, b))
    return out


def combinatorial_folds(start: datetime, end: datetime, n: int, k: int, *, purge: timedelta = timedelta(0), embargo: timedelta = timedelta(0)) -> list[Row]:
    """All C(n, k) choices of test groups; train is the rest less purge and embargo."""
    step = (end - start) / n
    groups = [(start + step * i, start + step * (i + 1)) for i in range(n)]
    out: list[Row] = []
    for p, chosen in enumerate(combinations(range(n), k)):
        test = merge_intervals([groups[i] for i in chosen])
        holes = [(a - purge, b + embargo) for a, b in test]
        train = subtract_intervals([g for i, g in enumerate(groups) if i not in chosen], holes)
        out += [(str(p), "oos", a, b) for a, b in test] + [(str(p), "train", a, b) for a, b in train]
    return out


def folds_table(spark: SparkSession, rows: list[Row]) -> DataFrame:
    return spark.createDataFrame(rows, "fold string, role string, start timestamp, end timestamp")


def merged_spans(spans: DataFrame, *, key: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Union of intervals per key, through the running maximum of ends."""
    w = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    s = spans.withColumn("__n", F.coalesce((F.col(start) > reach).cast("int"), F.lit(1))).withColumn("__g", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return s.groupBy(*key, "__g").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__g")


def label_windows(ts, train_end: str, valid_end: str, test_end: str):
    """TRAIN, VALID, TEST or OUT; lower bounds belong to the later window."""
    return F.when(ts < F.lit(train_end).cast("timestamp"), "TRAIN").when(ts < F.lit(valid_end).cast("timestamp"), "VALID").when(ts < F.lit(test_end).cast("timestamp"), "TEST").otherwise("OUT")


def overfit_statistics(trials: DataFrame, *, train: str, test: str, trial: str) -> DataFrame:
    """Rank agreement, regression of test on train, and how the best of train fares.

    ``logit`` is the negative log odds of the share of test values under that of the trial
    best in training (with half a trial for ties, clipped at half a trial from 0 and 1), so
    positive means overfit. Ranks break ties by trial. One row; all but ``n`` is null with
    fewer than four trials. Trials are driver-sized, their ranking is not partitioned.
    """
    t = trials.where(F.col(train).isNotNull() & F.col(test).isNotNull())
    t = t.withColumns({
        "__rt": F.row_number().over(Window.orderBy(train, trial)), "__ro": F.row_number().over(Window.orderBy(test, trial)), "__first": F.row_number().over(Window.orderBy(F.desc(train), trial)),
    })
    best = F.max(F.when(F.col("__first") == 1, F.col(test)))
    half = t.agg(F.percentile(train, F.lit(0.5)).alias("__mt"), F.percentile(test, F.lit(0.5)).alias("__mo"), F.count(F.lit(1)).alias("__n"), best.alias("__best"))
    t = t.join(F.broadcast(half))
    top = F.col(train) >= F.col("__mt")
    n, eps = F.first("__n"), 1 / (2 * F.first("__n"))
    under = (F.count(F.when(F.col(test) < F.col("__best"), 1)) + 0.5) / n
    under = F.greatest(eps, F.least(1 - eps, under))
    known = lambda c: F.when(n >= 4, c)
    return t.agg(
        F.count(F.lit(1)).alias("n"), known(F.corr("__rt", "__ro")).alias("spearman"), known(F.regr_slope(test, train)).alias("slope"), known(F.regr_intercept(test, train)).alias("intercept"),
        known(F.avg(F.when(top, (F.col(test) < F.col("__mo")).cast("double"))) * 100).alias("top_below_median_pct"), known(-F.log(under / (1 - under))).alias("logit"),
        known(F.max(train) - F.first("__best")).alias("best_gap"), known(F.first("__best") - F.first("__mo")).alias("best_over_median"),
        known(F.max(test) - F.first("__mo")).alias("selection_inflation"),
    )
