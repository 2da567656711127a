"""Chains of non-overlapping choices by successor links and pointer doubling.

Where what follows a choice depends on the chosen row alone (its exit, then the first
candidate after that), the choices of a key are the path from its first candidate along
successor links. ``on_chain`` marks that path in log2(length) rounds of equi joins: round r
adds the 2^r rows that follow those known and squares the links. No task walks a key,
and rows are dealt by (key, place).

``cooldown_chain``, ``bracket_chain``, ``step_fill_chain`` and ``pair_trade_chain`` give row by row
what the streamed machines of ``scans``, ``events`` and ``pairs`` give.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import asof_join
from tidemark.operators.shared import cut
from tidemark.operators.touch import first_touch, values_at


def place_rows(df: DataFrame, order: str, *, key: list[str], out: str = "idx", width: int = 86_400) -> DataFrame:
    """``df`` numbered 0, 1, 2, ... per key by ``order`` (a timestamp or number), block by block of ``width``.

    Blocks are numbered by themselves; what lies before a block is a running sum over one
    small row a block. Equal orders are numbered arbitrarily, so give them a tie-breaker first.
    """
    number = F.unix_timestamp(order) if dict(df.dtypes)[order].startswith("timestamp") else F.col(order)
    blocked = df.withColumn("__b", F.floor(number / width))
    sizes = blocked.groupBy(*key, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(*key).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy(*key, "__b").orderBy(order)) - 1
    placed = blocked.withColumn("__inside", inside).join(sizes.select(*key, "__b", before.alias("__o")), [*key, "__b"])
    return placed.withColumn(out, (F.col("__inside") + F.col("__o")).cast("long")).drop("__b", "__n", "__inside", "__o")


def next_place(rows: DataFrame, at: Column, *, key: list[str], place: str, width: float, out: str = "succ") -> DataFrame:
    """``rows`` with the smallest ``place`` of their key that is ``at`` or more; null where ``at`` is null or none follows.

    Targets and places are dealt by (key, block of ``width``); from later blocks comes one place each.
    """
    asked = rows.withColumn("__at", at)
    targets = asked.where("__at IS NOT NULL").select(*key, F.col("__at").cast("double").alias("__v"), F.lit(1).alias("__side"), F.struct(*[F.col(c) for c in rows.columns]).alias("__row"))
    places = rows.select(*key, F.col(place).cast("double").alias("__v"), F.lit(0).alias("__side"), F.col(place).alias("__place"))
    both = targets.unionByName(places, allowMissingColumns=True).withColumn("__b", F.floor(F.col("__v") / width))
    # from high to low; at one value the places come first, so a target sees its own
    back = Window.partitionBy(*key, "__b").orderBy(F.desc("__v"), "__side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("__hit", F.last("__place", ignorenulls=True).over(back))
    firsts = both.groupBy(*key, "__b").agg(F.min("__place").alias("__first"))
    later = Window.partitionBy(*key).orderBy(F.desc("__b")).rowsBetween(Window.unboundedPreceding, -1)
    carry = firsts.select(*key, "__b", F.last("__first", ignorenulls=True).over(later).alias("__carry"))
    found = seen.where("__row IS NOT NULL").join(carry, [*key, "__b"]).select("__row.*", F.coalesce("__hit", "__carry").alias(out))
    kind = dict(rows.dtypes)[place]
    return found.unionByName(asked.where("__at IS NULL").drop("__at").withColumn(out, F.lit(None).cast(kind)))


def on_chain(links: DataFrame, *, key: list[str], place: str, succ: str) -> DataFrame:
    """(key, place) on the path from each key's smallest place along ``succ`` (the place of a row, larger; null ends)."""
    links = links.select(*key, F.col(place).alias("__p"), F.col(succ).alias("__s"))
    known = cut(links.groupBy(*key).agg(F.min("__p").alias("__p")))
    jump = cut(links.where("__s IS NOT NULL"))
    while True:
        step = cut(known.join(jump, [*key, "__p"]).select(*key, F.col("__s").alias("__p")))
        if step.limit(1).count() == 0:
            return known.withColumnRenamed("__p", place)
        known = known.unionByName(step)
        onward = jump.select(*key, F.col("__p").alias("__s"), F.col("__s").alias("__t"))
        jump = cut(jump.join(onward, [*key, "__s"]).select(*key, "__p", F.col("__t").alias("__s")))


def cooldown_chain(df: DataFrame, seconds: str, gap: float, *, key: list[str], width: float | None = None) -> DataFrame:
    """Rows at least ``gap`` after the last kept row of their key; ``scans.cooldown`` without a task for each key.

    Of rows at one time the first is kept with a ``gap`` above 0, all with 0 or less. Null times are left out.
    """
    known = df.where(F.col(seconds).isNotNull())
    if gap <= 0:
        return known
    times = known.select(*key, F.col(seconds).alias("__t")).distinct()
    linked = next_place(times, F.col("__t") + gap, key=key, place="__t", width=width or 64 * gap)
    kept = on_chain(linked, key=key, place="__t", succ="succ")
    w = Window.partitionBy(*key, seconds).orderBy(*[c for c in df.columns if c not in (*key, seconds)] or [F.lit(1)])
    one = known.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")
    return one.join(kept.withColumnRenamed("__t", seconds), [*key, seconds], "left_semi").select(*df.columns)


def bracket_chain(
    df: DataFrame, enter: str, price: str, stop: str, target: str, max_hold: int, *, key: list[str], ts: str = "ts", out: str = "latched", trail: bool = False,
    exit_flag: str | None = None, block_seconds: int = 30 * 86_400,
) -> DataFrame:
    """``scans.bracket_latch`` by first touches and successor links, for keys too long for one task.

    The exit of an entry is the first touch of its stop or target among the next
    ``max_hold`` bars (with ``trail`` a fall from the running best), the exit flag, or the
    last of these bars; the next entry is the first after the exit. A row is in position from
    its entry to before its exit. Times of a key are distinct.
    """
    priced = place_rows(df.where(F.col(price).isNotNull() & ~F.isnan(F.col(price).cast("double"))), ts, key=key, out="__i", width=block_seconds)
    flag = F.coalesce(F.col(exit_flag).cast("boolean"), F.lit(False)) if exit_flag else F.lit(False)
    bars = cut(priced.select(*key, F.col(ts).alias("__ts"), "__i", F.col(price).cast("double").alias("__px"), flag.alias("__flag"), F.col(enter).cast("double").alias("__e"), F.col(stop).cast("double").alias("__st"), F.col(target).cast("double").alias("__tg")))
    entries = bars.where((F.col("__e") != 0) & F.col("__st").isNotNull() & F.col("__tg").isNotNull()).select(*key, "__ts", "__i", "__px", F.col("__e").cast("int").alias("__side"), "__st", "__tg")
    up = F.col("__side") > 0
    if trail:
        # the deepest fall from the best so far, or rise for a short
        def touch(k: Column, best: Column) -> Column:
            return k["flag"] | (F.when(up, F.greatest(k["fall"], best - k["lo"])).otherwise(F.greatest(k["rise"], k["hi"] - best)) >= F.col("__st"))

        def carried(k: Column, best: Column) -> Column:
            return F.when(up, F.greatest(best, k["hi"])).otherwise(F.least(best, k["lo"]))
    else:
        carried = None

        def touch(k: Column, _: Column) -> Column:
            best, worst = F.when(up, k["hi"]).otherwise(k["lo"]), F.when(up, k["lo"]).otherwise(k["hi"])
            gain = lambda p: (p - F.col("__px")) * F.col("__side")
            return k["flag"] | (gain(worst) <= -F.col("__st")) | (gain(best) >= F.col("__tg"))

    hit = first_touch(entries, bars.select(*key, "__i", "__px", "__flag"), max_hold, touch, key=key, at="__i", high="__px", low="__px", flag="__flag", carry=F.col("__px"), carried=carried, out="__x")
    hit = cut(hit.select(*key, "__ts", "__i", "__side", F.coalesce("__x", F.col("__i") + max(1, max_hold)).alias("__x")))
    linked = next_place(hit.select(*key, "__i", "__x"), F.col("__x") + 1, key=key, place="__i", width=float(1 << 16))
    taken = hit.join(on_chain(linked, key=key, place="__i", succ="succ"), [*key, "__i"], "left_semi")
    spans = values_at(taken, bars, {"__ts": "__span_out"}, F.col("__x"), key=key, at="__i").select(*key, F.col("__ts").alias("__span_in"), "__span_out", F.col("__side").alias("__span_side"))
    held = asof_join(df, spans, ["__span_in", "__span_out", "__span_side"], key=key, ts=ts, right_ts="__span_in", block_seconds=block_seconds)
    inside = F.col("__span_in").isNotNull() & (F.col("__span_out").isNull() | (F.col(ts) < F.col("__span_out")))
    return held.withColumn(out, F.when(inside, F.col("__span_side").cast("double")).otherwise(0.0)).drop("__span_in", "__span_out", "__span_side")


def step_fill_chain(rows: DataFrame, step: float, *, key: list[str], at: str = "idx", price: str = "close") -> DataFrame:
    """``events.price_step_fills`` by links: the first priced row, then each first one ``step`` under the last.

    The next fill depends on the last one alone, so it is a first touch of its price less ``step``.
    Places of a key are distinct.
    """
    priced = place_rows(rows.where(F.col(price).isNotNull()), at, key=key, out="__i", width=1 << 16)
    bars = cut(priced.select(*key, "__i", F.col(price).cast("double").alias("__px"), F.col(at).alias("__at")))
    horizon = (bars.agg(F.max("__i")).first()[0] or 0) + 1  # one number: the rows of the longest key
    hit = first_touch(bars, bars.select(*key, "__i", "__px"), horizon, lambda k, _: k["lo"] <= F.col("__px") * (1 - step), key=key, at="__i", high="__px", low="__px", out="__x")
    taken = bars.join(on_chain(hit.select(*key, "__i", "__x"), key=key, place="__i", succ="__x"), [*key, "__i"], "left_semi")
    return rows.join(taken.select(*key, F.col("__at").alias(at)), [*key, at], "left_semi").select(*rows.columns)


def pair_trade_chain(
    resid: DataFrame, z: str, entry: float, target: float, stop: float, most: int, *, key: list[str], ts: str = "ts", value: str = "resid", delay: int = 0, cross: bool = True, open_end: bool = False,
    block_seconds: int = 30 * 86_400,
) -> DataFrame:
    """Non-overlapping trades of a residual: (key, ts, trade, pnl, held) at the row of each exit.

    A row with entry <= |z| < stop calls for a trade against z, opened ``delay`` rows later at
    that row's ``value``. A later row with |z| at or under ``target``, at or over ``stop`` or (with
    ``cross``) on the other side calls for its close, else the row ``most`` after the first call; it is closed
    ``delay`` rows after that. The next call is the first after the closing row. The last row stands
    for rows after it in delays, and with ``open_end`` in closes; else trades still open there
    are left out. Rows without z are left out first. Times of a key are distinct.
    """
    known = resid.where(F.col(z).isNotNull()).select(*key, F.col(ts).alias("__ts"), F.col(z).cast("double").alias("__z"), F.col(value).cast("double").alias("__v"))
    rows = cut(place_rows(known, "__ts", key=key, out="__i", width=block_seconds))
    ends = rows.groupBy(*key).agg(F.max("__i").alias("__last"))
    size, side = F.abs("__z"), F.col("__side")
    calls = rows.where((size >= entry) & (size < stop)).select(*key, F.col("__i").alias("__call"), F.when(F.col("__z") > 0, -1).otherwise(1).alias("__side"))
    calls = calls.join(ends, key).withColumn("__i", F.least(F.col("__call") + delay, F.col("__last")))

    def touch(k: Column, _: Column) -> Column:
        # a short was called for by a positive z; a long is its mirror
        low = F.when(side < 0, k["lo"]).otherwise(-k["hi"])
        high = F.when(side < 0, k["hi"]).otherwise(-k["lo"])
        far = high >= stop
        return far | (low <= target) | (low < 0) if cross else far | k["flag"]

    bars = rows.select(*key, "__i", "__z", ((size <= target) | (size >= stop)).alias("__flag"))
    hit = first_touch(calls, bars, max(1, most - delay), touch, key=key, at="__i", high="__z", low="__z", flag=None if cross else "__flag", out="__x")
    hit = hit.withColumn("__x", F.coalesce(F.when(F.col("__x") <= F.col("__call") + most, F.col("__x")), F.col("__call") + most))
    hit = hit.withColumn("__x", F.least("__x", "__last")) if open_end else hit.where("__x <= __last")
    hit = cut(hit.withColumn("__out", F.least(F.col("__x") + delay, F.col("__last"))))
    linked = next_place(hit.select(*key, "__call", "__out"), F.col("__out") + 1, key=key, place="__call", width=float(1 << 16))
    taken = hit.join(on_chain(linked, key=key, place="__call", succ="succ"), [*key, "__call"], "left_semi")
    taken = values_at(taken, rows, {"__v": "__v0"}, F.col("__i"), key=key, at="__i")
    taken = values_at(taken, rows, {"__v": "__v1", "__ts": ts}, F.col("__out"), key=key, at="__i")
    number = F.row_number().over(Window.partitionBy(*key).orderBy("__call")).cast("long")
    return taken.select(*key, ts, number.alias("trade"), ((F.col("__v1") - F.col("__v0")) * side).alias("pnl"), (F.col("__out") - F.col("__i")).alias("held"))
