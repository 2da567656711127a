"""As-of, interval, pair and fold joins over public DataFrame operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.grid import forward_fill


def asof_join(
    left: DataFrame, right: DataFrame, cols: list[str], *, key: list[str], ts: str = "ts", right_ts: str | None = None, tie: str | None = None,
    block_seconds: int = 86_400, how: str = "left", strict: bool = False,
) -> DataFrame:
    """The last right row at or before each left row (before it, if ``strict``).

    Rows are dealt by (key, time block), so a hot key is many tasks; what the blocks
    before hand over is one row per block. A null inside the matched right row stays
    null: the payload travels as a struct.
    """
    block = lambda c: F.floor(F.unix_timestamp(c) / block_seconds)
    payload = F.struct(*[F.col(c) for c in cols])
    r_ts = right_ts or ts
    side_left = 0 if strict else 1
    r = right.select(*key, F.col(r_ts).alias("__t"), F.lit(1 - side_left).alias("__side"), (F.col(tie) if tie else F.lit(0)).cast("long").alias("__tie"), payload.alias("__p"))
    l_cols = left.columns
    le = left.select(*key, F.col(ts).alias("__t"), F.lit(side_left).alias("__side"), F.lit(0).cast("long").alias("__tie"), F.struct(*l_cols).alias("__l"))
    both = le.unionByName(r, allowMissingColumns=True).withColumn("__blk", block(F.col("__t")))
    w = Window.partitionBy(*key, "__blk").orderBy("__t", "__side", "__tie").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__m", F.last("__p", ignorenulls=True).over(w))
    ends = both.groupBy(*key, "__blk").agg(F.max_by("__p", F.when(F.col("__p").isNotNull(), F.struct("__t", "__tie"))).alias("__end"))
    before = Window.partitionBy(*key).orderBy("__blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = ends.select(*key, "__blk", F.last("__end", ignorenulls=True).over(before).alias("__carry"))
    hit = F.coalesce("__m", "__carry")
    out = seen.where("__l IS NOT NULL").join(carry, [*key, "__blk"]).withColumn("__hit", hit)
    if how == "inner":
        out = out.where("__hit IS NOT NULL")
    return out.select("__l.*", *[F.col(f"__hit.{c}").alias(c) for c in cols])


def reindex_ffill(grid: DataFrame, source: DataFrame, cols: list[str], *, key: list[str], ts: str = "ts") -> DataFrame:
    """Only source rows whose time is on the grid enter; non-null values carry forward."""
    return forward_fill(grid.join(source.select(*key, ts, *cols), [*key, ts], "left"), cols, key=key, ts=ts)


def range_join(points: DataFrame, intervals: DataFrame, *, key: list[str], at: str, start: str, end: str, width: int, how: str = "inner") -> DataFrame:
    """Points with start <= at < end, through buckets of ``width`` that make it an equi join."""
    p = points.withColumn("__b", F.floor(F.col(at) / width))
    i = intervals.withColumn("__b", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor((F.col(end) - 1) / width))))
    cond = [p[k] == i[k] for k in key] + [p["__b"] == i["__b"], p[at] >= i[start], p[at] < i[end]]
    joined = p.join(i, cond, how)
    for k in key:
        joined = joined.drop(i[k])
    return joined.drop(p["__b"]).drop(i["__b"]) if how == "inner" else joined.drop("__b")


#: Intervals that are broadcast at most; more are joined through time buckets.
MOST_INTERVALS = 10_000


def _inside(df: DataFrame, spans: DataFrame, ts: str, start: str, end: str, how: str) -> DataFrame:
    """``df`` joined to the intervals that hold its time, on the columns of ``spans`` as they are."""
    if spans.limit(MOST_INTERVALS + 1).count() <= MOST_INTERVALS:
        return df.join(F.broadcast(spans), (F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end)), how)
    day = lambda c: F.floor(F.unix_micros(c) / 86_400_000_000)
    p = df.withColumn("__b", day(F.col(ts).cast("timestamp")))
    i = spans.where(F.col(end) > F.col(start)).withColumn("__c", F.explode(F.sequence(day(F.col(start).cast("timestamp")), day(F.col(end).cast("timestamp")))))
    return p.join(i, (F.col("__b") == F.col("__c")) & (F.col(ts) >= F.col(start)) & (F.col(ts) < F.col(end)), how).drop("__b", "__c")


def in_any_interval(df: DataFrame, intervals: DataFrame, *, ts: str = "ts", start: str = "start", end: str = "end") -> DataFrame:
    """Rows inside at least one half-open interval."""
    return _inside(df, intervals.select(F.col(start).alias("__s"), F.col(end).alias("__e")), ts, "__s", "__e", "left_semi")


def assign_folds(df: DataFrame, folds: DataFrame, *, ts: str = "ts") -> DataFrame:
    """A row for each fold that holds the time; ``folds`` is (fold, role, start, end)."""
    return _inside(df, folds, ts, "start", "end", "inner").drop("start", "end")


def symbol_pairs(df: DataFrame, value: str, *, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """(a, b, ts, va, vb) of every two symbols at equal times, a < b."""
    a = df.select(F.col(key).alias("a"), ts, F.col(value).alias("va"))
    b = df.select(F.col(key).alias("b"), ts, F.col(value).alias("vb"))
    return a.join(b, ts).where("a < b")


def within_radius(points: DataFrame, dims: list[str], radius: float, *, pid: str = "pid", most_cells: int = 3) -> DataFrame:
    """(p, q) of points at most ``radius`` apart, p < q, joined through cells of twice that side in up to ``most_cells`` dimensions.

    Every point lies in one cell and also enters the cells that its reach touches, two a dimension. Pairs grow with the square
    of the points, so the tasks of the join are not merged by the bytes they read.
    """
    celled, side, reach = dims[:most_cells], 2 * radius, radius * (1 + 1e-9)  # the reach a little longer: rounding loses no pair at a cell's edge
    cells, parts = [f"__c{n}" for n in range(len(celled))], int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a = points.select(F.col(pid).alias("p"), *[F.col(d).alias(f"a_{d}") for d in dims], *[F.floor(F.col(d) / side).alias(c) for c, d in zip(cells, celled)])
    b = points.select(F.col(pid).alias("q"), *[F.col(d).alias(f"b_{d}") for d in dims])
    for c, d in zip(cells, celled):
        x = F.col(f"b_{d}")
        b = b.withColumn(c, F.explode(F.sequence(F.floor((x - reach) / side), F.floor((x + reach) / side))))
    gap = sum(((F.col(f"a_{d}") - F.col(f"b_{d}")) ** 2 for d in dims), F.lit(0.0))
    met = a.repartition(parts, *cells).join(b.repartition(parts, *cells), cells)
    return met.where("p < q").withColumn("distance", F.sqrt(gap)).where(F.col("distance") <= radius).select("p", "q", "distance")


def trailing_count(events: DataFrame, seconds: int, *, ts: str = "ts", block_seconds: int = 86_400) -> DataFrame:
    """``events`` with ``breadth``: rows of all keys in [t - seconds, t], both ends in.

    Every row also enters the blocks that its look-ahead reaches, so each block counts
    on its own and no task sees the whole series.
    """
    s = F.unix_timestamp(ts)
    own = F.floor(s / block_seconds)
    spread = events.withColumn("__s", s).withColumn("__own", own)
    spread = spread.withColumn("__blk", F.explode(F.sequence(F.col("__own"), F.floor((F.col("__s") + seconds) / block_seconds))))
    w = Window.partitionBy("__blk").orderBy("__s").rangeBetween(-seconds, 0)
    return spread.withColumn("breadth", F.count(F.lit(1)).over(w)).where("__blk = __own").drop("__s", "__own", "__blk")


def outer_align(df: DataFrame, value: str, *, key: str = "symbol", ts: str = "ts") -> DataFrame:
    """Every key at every time of any key, filled forward, then backward at the head."""
    grid = _all_times(df, key, ts)
    out = forward_fill(grid.join(df.select(key, ts, value), [key, ts], "left"), [value], key=[key], ts=ts)
    every = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # evaluated once a key
    return out.withColumn(value, F.coalesce(value, F.first(value, ignorenulls=True).over(every)))


def _all_times(df: DataFrame, key: str, ts: str, parts: int = 16) -> DataFrame:
    """(key, ts) of every key and every time, dealt over parts of the keys and parts of the times."""
    keys = df.select(key).distinct().groupBy(F.pmod(F.xxhash64(key), F.lit(parts)).alias("__g")).agg(F.collect_list(key).alias("__keys"))
    keys = keys.withColumn("__h", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    times = df.select(ts).distinct().withColumn("__h", F.pmod(F.xxhash64(ts), F.lit(parts)).cast("long")).withColumn("__g", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))))
    return times.join(keys, ["__g", "__h"]).select(F.explode("__keys").alias(key), ts)


def joined_with_accounting(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", *, narrowing: bool = False) -> tuple[DataFrame, DataFrame]:
    """(joined, counts): a join that reports rows before and after.

    Without ``narrowing`` only left joins are allowed, and columns must not clash.
    """
    clash = (set(left.columns) & set(right.columns)) - set(on)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    if how != "left" and not narrowing:
        raise ValueError("rows may vanish: say narrowing=True")
    out = left.join(right, on, how)
    counts = left.agg(F.count(F.lit(1)).alias("rows_before")).join(out.agg(F.count(F.lit(1)).alias("rows_after")))
    return out, counts


def seen_in_many(df: DataFrame, on: list[str], fold: str) -> DataFrame:
    """Keys that appear in more than one fold, with the number of folds."""
    return df.groupBy(*on).agg(F.count_distinct(fold).alias("folds")).where("folds > 1")


def poisoned(df: DataFrame, cols: list[str], cutoff: Column, *, ts: str = "ts") -> DataFrame:
    """``df`` with ``cols`` null from ``cutoff`` on."""
    return df.withColumns({c: F.when(F.col(ts) < cutoff, F.col(c)) for c in cols})


def causality_diff(transform, df: DataFrame, cols: list[str], cutoff: Column, out: list[str], *, key: list[str], ts: str = "ts", atol: float = 1e-9) -> DataFrame:
    """Rows before ``cutoff`` whose output changes when the input from it on is nulled."""
    a = transform(df).where(F.col(ts) < cutoff).select(*key, ts, *[F.col(c).alias(f"{c}_a") for c in out])
    b = transform(poisoned(df, cols, cutoff, ts=ts)).where(F.col(ts) < cutoff).select(*key, ts, *[F.col(c).alias(f"{c}_b") for c in out])
    differs = F.lit(False)
    for c in out:
        x, y = F.col(f"{c}_a").cast("double"), F.col(f"{c}_b").cast("double")
        differs = differs | ~F.coalesce((x.isNull() & y.isNull()) | (F.abs(x - y) <= atol), F.lit(False))
    return a.join(b, [*key, ts], "full").where(differs)
