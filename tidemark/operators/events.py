"""Event studies: clusters, forward paths, barriers, levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.grid import ordered, up_to_now
from tidemark.operators.joins import range_join
from tidemark.operators.touch import extremes_ahead, first_touch, last_place, values_at


def indexed(bars: DataFrame, *, key: list[str], ts: str = "ts") -> DataFrame:
    """``bars`` with ``idx`` 0, 1, 2, ... per key in time order."""
    return bars.withColumn("idx", (F.row_number().over(ordered(key, ts)) - 1).cast("long"))


def clusters(triggers: DataFrame, gap: float, *, at: str, key: list[str]) -> DataFrame:
    """(key, cluster, start, last, k): a trigger more than ``gap`` after the one before starts a cluster."""
    w = Window.partitionBy(*key).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(w) > gap).cast("int"), F.lit(1))
    c = triggers.withColumn("__n", new).withColumn("cluster", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return c.groupBy(*key, "cluster").agg(F.min(at).alias("start"), F.max(at).alias("last"), F.count(F.lit(1)).alias("k"))


def forward_path(events: DataFrame, bars: DataFrame, horizon: int, *, key: list[str], at: str = "idx", cols: list[str]) -> DataFrame:
    """Events x the ``horizon`` bars after each, with ``step`` 1..horizon.

    ``bars`` carry ``idx``. Buckets of the horizon's width turn it into an equi join.
    """
    e = events.withColumnRenamed(at, "__at").withColumn("__from", F.col("__at") + 1).withColumn("__to", F.col("__at") + 1 + horizon)
    b = bars.select(*key, F.col("idx").alias("__idx"), *[F.col(c).alias(f"f_{c}") for c in cols])
    j = range_join(b, e, key=key, at="__idx", start="__from", end="__to", width=max(1, horizon))
    return j.withColumn("step", F.col("__idx") - F.col("__at")).withColumnRenamed("__at", at).drop("__idx", "__from", "__to")


def triple_barrier(
    events: DataFrame, bars: DataFrame, horizon: int, up: str | Column, down: str | Column, *, key: list[str], event_id: str, price: str = "close", side: Column | None = None, by_path: bool = False,
) -> DataFrame:
    """First touch of +up or -down (returns in the event's direction) within the horizon.

    (event_id, label, touch_step, ret): 1 profit, -1 loss, 0 neither; a bar that
    touches both counts as profit. A null or non-positive width has no barriers. Events without
    a bar ahead are left out. ``by_path`` makes a row for each bar ahead instead of a search by blocks.
    """
    s = side if side is not None else F.lit(1.0)
    e = events.withColumns({"__u": up if isinstance(up, Column) else F.col(up), "__d": down if isinstance(down, Column) else F.col(down), "__s": s, "__p0": F.col(price)})
    if by_path:
        return _barriers_by_path(e, bars, horizon, key=key, event_id=event_id, price=price)
    ret = lambda p: (F.try_divide(p, F.col("__p0")) - 1) * F.col("__s")
    profit = lambda r: F.coalesce((F.col("__u") > 0) & (r >= F.col("__u")), F.lit(False))
    loss = lambda r: F.coalesce((F.col("__d") > 0) & (r <= -F.col("__d")), F.lit(False))
    hit = first_touch(e, bars, horizon, lambda k, _: profit(ret(k["hi"])) | profit(ret(k["lo"])) | loss(ret(k["hi"])) | loss(ret(k["lo"])), key=key, high=price, low=price, out="__x")
    hit = hit.join(last_place(bars, key=key, out="__last"), key).where(F.col("idx") < F.col("__last"))
    end = F.coalesce("__x", F.least(F.col("idx") + horizon, F.col("__last")))
    hit = values_at(hit.withColumn("__end", end), bars, {price: "__p"}, F.col("__end"), key=key)
    r = ret(F.col("__p"))
    label = F.when(F.col("__x").isNull(), 0).when(profit(r), 1).otherwise(-1)
    return hit.select(event_id, label.alias("label"), (F.col("__end") - F.col("idx")).alias("touch_step"), r.alias("ret"))


def _barriers_by_path(e: DataFrame, bars: DataFrame, horizon: int, *, key: list[str], event_id: str, price: str) -> DataFrame:
    p = forward_path(e, bars, horizon, key=key, cols=[price]).withColumn("__r", (F.try_divide(F.col(f"f_{price}"), F.col("__p0")) - 1) * F.col("__s"))
    a = p.groupBy(event_id).agg(
        F.min(F.when((F.col("__u") > 0) & (F.col("__r") >= F.col("__u")), F.col("step"))).alias("__pt"),
        F.min(F.when((F.col("__d") > 0) & (F.col("__r") <= -F.col("__d")), F.col("step"))).alias("__sl"),
        F.max("step").alias("__end"), F.map_from_entries(F.collect_list(F.struct("step", "__r"))).alias("__path"),
    )
    label = F.when(F.col("__pt").isNotNull() & (F.col("__sl").isNull() | (F.col("__pt") <= F.col("__sl"))), 1).when(F.col("__sl").isNotNull(), -1).otherwise(0)
    a = a.withColumn("label", label).withColumn("touch_step", F.when(F.col("label") == 1, F.col("__pt")).when(F.col("label") == -1, F.col("__sl")).otherwise(F.col("__end")))
    return a.withColumn("ret", F.element_at("__path", F.col("touch_step"))).drop("__pt", "__sl", "__end", "__path")


def first_barrier(events: DataFrame, bars: DataFrame, horizon: int, width: float, *, key: list[str], event_id: str) -> DataFrame:
    """Symmetric first touch on highs and lows: both in one bar is a loss; none is null."""
    e = events.withColumn("__p0", F.col("close"))
    up, down = (lambda p: p >= F.col("__p0") * (1 + width)), (lambda p: p <= F.col("__p0") * (1 - width))
    hit = first_touch(e, bars, horizon, lambda k, _: up(k["hi"]) | down(k["lo"]), key=key, out="__x")
    hit = hit.join(last_place(bars, key=key, out="__last"), key).where(F.col("idx") < F.col("__last"))
    hit = values_at(hit, bars, {"low": "__lo"}, F.col("__x"), key=key)
    return hit.select(event_id, F.when(F.col("__x").isNull(), None).when(down(F.col("__lo")), -1).otherwise(1).alias("label"))


def outcomes(events: DataFrame, bars: DataFrame, horizons: list[int], stop: float, *, key: list[str], event_id: str) -> DataFrame:
    """Short return at each horizon with a catastrophe stop on highs, and the adverse excursion."""
    e = events.withColumn("__p0", F.col("close"))
    most = max(horizons)
    hit = first_touch(e, bars, most, lambda k, _: k["hi"] >= F.col("__p0") * (1 + stop), key=key, out="__x")
    hit = extremes_ahead(hit, bars, most, key=key).where("ahead_high IS NOT NULL OR ahead_low IS NOT NULL")
    for h in horizons:
        hit = values_at(hit, bars, {"close": f"__c{h}"}, F.col("idx") + h, key=key)
    step = F.col("__x") - F.col("idx")
    return hit.select(
        event_id, step.alias("stop_step"), (F.try_divide(F.col("ahead_low"), F.col("__p0")) - 1).alias("worst_low"), (F.try_divide(F.col("ahead_high"), F.col("__p0")) - 1).alias("best_high"),
        *[F.when(step <= h, F.lit(-stop)).otherwise(1 - F.try_divide(F.col(f"__c{h}"), F.col("__p0"))).alias(f"pnl{h}") for h in horizons],
    )


def rollover_exit(events: DataFrame, bars: DataFrame, horizon: int, give_back: float, *, key: list[str], event_id: str) -> DataFrame:
    """Exit at the first close ``give_back`` under the running peak since entry."""
    e = events.withColumn("__p0", F.col("close"))
    p = forward_path(e, bars, horizon, key=key, cols=["close"])
    w = Window.partitionBy(event_id).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("peak", F.greatest(F.max("f_close").over(w), F.col("__p0")))
    hit = F.col("f_close") <= F.col("peak") * (1 - give_back)
    return p.groupBy(event_id).agg(
        F.min(F.when(hit, F.col("step"))).alias("exit_step"), F.min_by(F.try_divide(F.col("f_close"), F.col("__p0")) - 1, F.when(hit, F.col("step"))).alias("exit_ret"),
        (F.try_divide(F.max("f_close"), F.first("__p0")) - 1).alias("peak_ret"),
    )


def stall_exit(events: DataFrame, bars: DataFrame, horizon: int, m: int, *, key: list[str], event_id: str) -> DataFrame:
    """First step at which no new high came for ``m`` bars."""
    p = forward_path(events, bars, horizon, key=key, cols=["high", "close"])
    w = Window.partitionBy(event_id).orderBy("step").rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("__new", F.coalesce(F.col("f_high") > F.max("f_high").over(w), F.lit(True)))
    upto = Window.partitionBy(event_id).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("since", F.col("step") - F.last(F.when(F.col("__new"), F.col("step")), ignorenulls=True).over(upto))
    return p.groupBy(event_id).agg(F.min(F.when(F.col("since") >= m, F.col("step"))).alias("stall_step"))


def run_up_levels(events: DataFrame, bars: DataFrame, horizon: int, levels: list[float], *, key: list[str], event_id: str) -> DataFrame:
    """(event_id, level, cross_step): when the running high first reaches each level."""
    e = events.withColumn("__p0", F.col("close")).withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    hit = first_touch(e, bars, horizon, lambda k, _: F.try_divide(k["hi"], F.col("__p0")) - 1 >= F.col("level"), key=key, out="__x")
    hit = hit.join(last_place(bars, key=key, out="__last"), key).where(F.col("idx") < F.col("__last"))
    return hit.select(event_id, "level", (F.col("__x") - F.col("idx")).alias("cross_step"))


def mean_path(events: DataFrame, bars: DataFrame, before: int, after: int, *, key: list[str]) -> DataFrame:
    """Average price relative to the trigger bar's, by signed offset."""
    e = events.withColumn("__p0", F.col("close")).withColumn("__at", F.col("idx") - before - 1)
    p = forward_path(e.drop("idx"), bars, before + after + 1, key=key, at="__at", cols=["close"])
    offset = F.col("step") - before - 1
    return p.groupBy(offset.alias("offset")).agg(F.avg(F.try_divide(F.col("f_close"), F.col("__p0"))).alias("mean_rel"), F.count(F.lit(1)).alias("n"))


def fill_schedules(fills: DataFrame, schedule: DataFrame, *, event: str, order: str, price: str = "price") -> DataFrame:
    """Weighted entry and deployed fraction of each event under each (name, i, weight) schedule."""
    f = fills.withColumn("i", F.row_number().over(Window.partitionBy(event).orderBy(order)))
    return f.join(F.broadcast(schedule), "i").groupBy("name", event).agg(
        (F.sum(F.col("weight") * F.col(price)) / F.sum("weight")).alias("entry"), F.least(F.lit(1.0), F.sum("weight")).alias("deployed"), F.count(F.lit(1)).alias("fills")
    )


def levels_from_swings(swings: DataFrame, life: int, *, key: list[str]) -> DataFrame:
    """Each confirmed swing is a level from its confirmation for ``life`` bars."""
    s = swings.where("is_high OR is_low").withColumn("level", F.when(F.col("is_high"), F.col("high")).otherwise(F.col("low")))
    return s.select(*key, "level", F.col("confirmed_idx").cast("long").alias("from_idx"), (F.col("confirmed_idx") + life).cast("long").alias("to_idx"))


def level_touches(bars: DataFrame, levels: DataFrame, tol: float, *, key: list[str], width: int) -> DataFrame:
    """Bars inside a level's life whose close is within ``tol`` of it; the nearest level each."""
    j = range_join(bars, levels, key=key, at="idx", start="from_idx", end="to_idx", width=width)
    j = j.withColumn("distance", F.abs(F.col("close") - F.col("level")) / F.nullif(F.abs(F.col("level")), F.lit(0.0))).where(F.col("distance") <= tol)
    return j.withColumn("__r", F.row_number().over(Window.partitionBy(*key, "idx").orderBy("distance", "level", "from_idx"))).where("__r = 1").drop("__r")


def trendlines(swings: DataFrame, life: int, *, key: list[str]) -> DataFrame:
    """Lines through consecutive swing highs: slope per bar, known at the second's confirmation."""
    h = swings.where("is_high")
    w = Window.partitionBy(*key).orderBy("idx")
    h = h.withColumns({"i0": F.lag("idx").over(w), "p0": F.lag("high").over(w)}).where("i0 IS NOT NULL")
    return h.select(
        *key, "i0", "p0", F.col("idx").alias("i1"), F.col("high").alias("p1"), ((F.col("high") - F.col("p0")) / (F.col("idx") - F.col("i0"))).alias("slope"),
        F.col("confirmed_idx").cast("long").alias("from_idx"), (F.col("confirmed_idx") + life).cast("long").alias("to_idx"),
    )


def trendline_breaks(bars: DataFrame, lines: DataFrame, *, key: list[str], width: int) -> DataFrame:
    """First bar of a line's life that closes above it, and touches before that."""
    j = range_join(bars, lines, key=key, at="idx", start="from_idx", end="to_idx", width=width)
    j = j.withColumn("lv", F.col("p1") + F.col("slope") * (F.col("idx") - F.col("i1")))
    w = Window.partitionBy(*key, "i1")
    j = j.withColumn("break_idx", F.min(F.when(F.col("close") > F.col("lv"), F.col("idx"))).over(w))
    touch = (F.col("high") >= F.col("lv")) & (F.col("break_idx").isNull() | (F.col("idx") < F.col("break_idx")))
    return j.groupBy(*key, "i1").agg(F.first("break_idx").alias("break_idx"), F.count(F.when(touch, 1)).alias("touches"))


def stop_breaker(events: DataFrame, seconds: float, most: int, *, key: list[str], at: str, stopped: str, tie: list[str] | None = None) -> DataFrame:
    """Drop an event while ``most`` or more kept events of its key stopped in the last ``seconds``.

    ``seconds`` is in the unit of ``at``; events of equal ``at`` follow in the order of ``tie``.
    """
    from pyspark.sql import types as T

    from tidemark.operators.scans import ordered_scan

    def machine():
        recent: list[float] = []

        def step(s, stop):
            recent[:] = [x for x in recent if s - x <= seconds]
            keep = len(recent) < most
            if keep and stop:
                recent.append(s)
            return (keep,)

        return step

    return ordered_scan(events, [at, *(tie or [])], [at, stopped], machine, T.StructType([T.StructField("__k", T.BooleanType())]), key=key).where("__k").drop("__k")


def trigger_features(bars: DataFrame, *, day: int, key: list[str], ts: str = "ts") -> DataFrame:
    """Features of a trigger on every bar, from bars up to it; take the rows of the triggers.

    Returns over several horizons, acceleration, volume surges against the median of the
    ``day`` bars before, volatility, range, distance to the day's extremes, and the run
    of falling closes that ends here.
    """
    w = ordered(key, ts)
    back = lambda k: w.rowsBetween(-(k - 1), 0)
    c = F.col("close")
    ret = lambda k: F.try_divide(c, F.lag(c, k).over(w)) - 1
    rn = F.row_number().over(w)
    base = F.when(rn > day, F.percentile("volume", F.lit(0.5)).over(w.rowsBetween(-day, -1)))
    d = bars.withColumns({"__base": F.nullif(base, F.lit(0.0)), "__lr": F.when((c > 0) & (F.lag(c).over(w) > 0), F.log(c / F.lag(c).over(w))), "__fall": F.coalesce(c < F.lag(c).over(w), F.lit(False))})
    d = d.withColumn("__run", F.sum(F.when(F.col("__fall"), 0).otherwise(1)).over(up_to_now(key, ts)))
    return d.select(
        *bars.columns, *[ret(k).alias(f"r{k}") for k in (1, 3, 5, 15)], (ret(5) - (F.try_divide(F.lag(c, 5).over(w), F.lag(c, 10).over(w)) - 1)).alias("acceleration"),
        (F.sum("volume").over(back(15)) / (F.col("__base") * 15)).alias("surge15"), (F.col("volume") / F.col("__base")).alias("surge1"),
        F.when(F.count("__lr").over(back(60)) > 5, F.stddev_pop("__lr").over(back(60))).alias("volatility"), F.try_divide(F.max("high").over(back(5)) - F.min("low").over(back(5)), c).alias("range5"),
        (F.try_divide(c, F.max("high").over(back(day + 1))) - 1).alias("from_high"), (F.try_divide(c, F.min("low").over(back(day + 1))) - 1).alias("from_low"),
        (F.row_number().over(Window.partitionBy(*key, "__run").orderBy(ts)) - 1).alias("falls"),
    )


def price_step_fills(rows: DataFrame, step: float, *, key: list[str], at: str = "idx", price: str = "close") -> DataFrame:
    """The first row of each key, and each row ``step`` or more under the last one taken."""
    from pyspark.sql import types as T

    from tidemark.operators.scans import ordered_scan

    def machine():
        last = [None]

        def take(p):
            if p is None or (last[0] is not None and p > last[0] * (1 - step)):
                return (False,)
            last[0] = p
            return (True,)

        return take

    return ordered_scan(rows, [at], [price], machine, T.StructType([T.StructField("__k", T.BooleanType())]), key=key).where("__k").drop("__k")


def min_gap_fills(rows: DataFrame, gap: float, most: int, *, key: list[str], at: str = "idx") -> DataFrame:
    """Rows at least ``gap`` after the last one taken, at most ``most`` of a key."""
    from tidemark.operators.scans import cooldown

    kept = cooldown(rows, at, gap, key=key)
    return kept.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(at))).where(F.col("__r") <= most).drop("__r")


def run_up_fades(events: DataFrame, bars: DataFrame, horizon: int, levels: list[float], hold: int, stop: float, *, key: list[str], event_id: str) -> DataFrame:
    """(event_id, level, cross_step, retracement, fade): a short sold where the run-up first reaches a level.

    ``retracement`` is the deepest low under the running high until then. The short is
    bought back ``hold`` bars later, or at the close of the bar whose high is ``stop``
    above the sale, at a loss of ``stop`` at least; null where the path ends before.
    """
    p = forward_path(events.withColumn("__p0", F.col("close")), bars, horizon, key=key, cols=["high", "low", "close"])
    upto = Window.partitionBy(event_id).orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("__top", F.greatest(F.max("f_high").over(upto), F.col("__p0")))
    p = p.withColumn("__deep", F.least(F.lit(0.0), F.min(F.try_divide(F.col("f_low"), F.col("__top")) - 1).over(upto)))
    up = F.try_divide(F.col("f_high"), F.col("__p0")) - 1
    long = p.withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    crossed = long.where(up >= F.col("level")).groupBy(event_id, "level").agg(F.min("step").alias("cross_step"), F.min_by("__deep", "step").alias("retracement"), F.min_by("f_close", "step").alias("__e"))
    steps = p.select(F.col(event_id).alias("__id"), F.col("step").alias("__s"), F.col("f_close").alias("__c"), F.col("f_high").alias("__h"))
    after = crossed.join(steps, (F.col(event_id) == F.col("__id")) & (F.col("__s") > F.col("cross_step")) & (F.col("__s") <= F.col("cross_step") + hold), "left")
    hit = F.try_divide(F.col("__h"), F.col("__e")) - 1 >= stop
    move = F.try_divide(F.col("__c"), F.col("__e")) - 1
    g = after.groupBy(event_id, "level", "cross_step", "retracement").agg(
        F.min_by(move, F.when(hit, F.col("__s"))).alias("__at_stop"), F.max(F.when(F.col("__s") == F.col("cross_step") + hold, move)).alias("__at_end"), F.count(F.when(hit, 1)).alias("__hits")
    )
    fade = F.when(F.col("__hits") > 0, F.least(F.lit(-stop), -F.col("__at_stop"))).otherwise(-F.col("__at_end"))
    return g.select(event_id, "level", "cross_step", "retracement", fade.alias("fade"))
