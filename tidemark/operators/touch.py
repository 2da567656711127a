"""First touches and extremes ahead of an event without a row for each bar ahead.

Bars are folded into blocks of ``FAN``, those into blocks of blocks, as many levels as
the horizon needs. A block is one row that holds its children: highest and lowest value,
a flag, and the deepest fall and rise inside. An event joins the block it starts in, at each
level the next one up, until a block shows that a bar inside touches, then goes down
again: 2 log(horizon) / log(FAN) - 1 equi joins of one row an event, where a range join makes
one row for each bar ahead. Blocks are keyed by (key, place), so a long key is many tasks.

A touch is a condition on a block's extremes that holds for the block exactly if it holds
for one of its bars; that is so for any threshold on a monotone function of the price.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Children of a block.
FAN = 64

Touch = Callable[[Column, Column], Column]


def _up(c: Column) -> Column:
    return F.floor(c / FAN).cast("long")


def n_levels(horizon: int) -> int:
    """Levels of blocks that a horizon needs."""
    n = 1
    while FAN**n < horizon:
        n += 1
    return n


def block_levels(bars: DataFrame, levels: int, *, key: list[str], at: str, high: str, low: str, flag: str | None = None) -> list[DataFrame]:
    """Per level (key, slot, kids): the children of a block and of the one after it, in order."""
    kid = F.struct(
        F.col(at).cast("long").alias("c"), F.col(high).cast("double").alias("hi"), F.col(low).cast("double").alias("lo"), (F.coalesce(F.col(flag), F.lit(False)) if flag else F.lit(False)).alias("flag"),
        F.lit(0.0).alias("fall"), F.lit(0.0).alias("rise"),
    )
    own = bars.select(*key, kid.alias("kid"))
    out = []
    for j in range(levels):
        own = own.groupBy(*key, _up(F.col("kid.c")).alias("slot")).agg(F.sort_array(F.collect_list("kid")).alias("kids"))  # FAN at most
        both = own.withColumn("slot", F.explode(F.array(F.col("slot"), F.col("slot") - 1)))
        out.append(both.groupBy(*key, "slot").agg(F.sort_array(F.flatten(F.collect_list("kids"))).alias("kids")))
        if j + 1 < levels:
            own = own.select(*key, _summary(F.col("kids"), F.col("slot")).alias("kid"))
    return out


def _summary(kids: Column, place: Column) -> Column:
    """A block as a child of the level above."""
    none = F.lit(None).cast("double")
    start = F.struct(none.alias("hi"), none.alias("lo"), F.lit(0.0).alias("fall"), F.lit(0.0).alias("rise"))

    def fold(a: Column, k: Column) -> Column:
        return F.struct(
            F.greatest(a["hi"], k["hi"]).alias("hi"), F.least(a["lo"], k["lo"]).alias("lo"),
            F.greatest(a["fall"], k["fall"], a["hi"] - k["lo"]).alias("fall"), F.greatest(a["rise"], k["rise"], k["hi"] - a["lo"]).alias("rise"),
        )

    done = F.aggregate(kids, start, fold)
    return F.struct(place.alias("c"), done["hi"].alias("hi"), done["lo"].alias("lo"), F.exists(kids, lambda k: k["flag"]).alias("flag"), done["fall"].alias("fall"), done["rise"].alias("rise"))


def first_touch(
    events: DataFrame, bars: DataFrame, horizon: int, touch: Touch, *, key: list[str], at: str = "idx", high: str = "high", low: str = "low", flag: str | None = None,
    carry: Column | None = None, carried: Touch | None = None, out: str = "touch_idx",
) -> DataFrame:
    """``events`` with the place of the first of the next ``horizon`` bars that touches, else null.

    ``bars`` are numbered by ``at`` per key. ``touch(child, carry)`` gets a struct of hi, lo,
    flag, fall and rise and may use the columns of the event; ``carry`` is a number that the event
    starts with and ``carried(child, carry)`` what it is after the child (a running best).
    """
    levels = block_levels(bars, n_levels(horizon), key=key, at=at, high=high, low=low, flag=flag)
    carry = F.lit(0.0) if carry is None else carry.cast("double")
    ev = events.withColumns({"__carry": carry, "__found": F.lit(None).cast("long"), "__lv": F.lit(-1), "__from": F.col(at).cast("long") + 1})

    def visit(ev: DataFrame, j: int, slot: Column, first: Column, active: Column, own_only: bool) -> DataFrame:
        start = F.struct(F.col("__carry").alias("carry"), F.lit(None).cast("long").alias("found"))

        def fold(a: Column, k: Column) -> Column:
            skip = a["found"].isNotNull() | (k["c"] < F.col("__first"))
            if own_only:
                skip = skip | (_up(k["c"]) != F.col("slot"))
            after = carried(k, a["carry"]) if carried else a["carry"]
            return F.when(skip, a).when(F.coalesce(touch(k, a["carry"]), F.lit(False)), F.struct(a["carry"].alias("carry"), k["c"].alias("found"))).otherwise(
                F.struct(after.alias("carry"), F.lit(None).cast("long").alias("found"))
            )

        met = ev.withColumns({"slot": slot, "__first": first, "__go": active}).join(levels[j], [*key, "slot"], "left")
        met = met.withColumn("__r", F.when(F.col("__go"), F.aggregate("kids", start, fold)))
        hit = F.col("__r.found").isNotNull()
        return met.withColumns({
            "__carry": F.coalesce("__r.carry", "__carry"), "__found": F.when(hit, F.col("__r.found")).otherwise(F.col("__found")), "__lv": F.when(hit, F.lit(j)).otherwise(F.col("__lv")),
        }).drop("kids", "__r", "__first", "__go", "slot")

    for j in range(len(levels)):
        ev = visit(ev, j, _up(F.col("__from")), F.col("__from"), F.col("__lv") < 0, False)
        ev = ev.withColumn("__from", _up(F.col("__from")) + 2)
    for j in range(len(levels) - 2, -1, -1):
        going = F.col("__lv") == j + 1
        ev = visit(ev, j, F.when(going, F.col("__found")).otherwise(_up(F.col(at).cast("long"))), F.lit(0).cast("long"), going, True)
    return ev.withColumn(out, F.when(F.col("__found") <= F.col(at) + horizon, F.col("__found"))).drop("__carry", "__found", "__lv", "__from")


def extremes_ahead(events: DataFrame, bars: DataFrame, horizon: int, *, key: list[str], at: str = "idx", high: str = "high", low: str = "low") -> DataFrame:
    """``events`` with ``ahead_high`` and ``ahead_low`` of the next ``horizon`` bars, null where there are none."""
    levels = block_levels(bars, n_levels(horizon), key=key, at=at, high=high, low=low)
    none = F.lit(None).cast("double")
    ev = events.withColumns({"ahead_high": none, "ahead_low": none, "__a": F.col(at).cast("long") + 1, "__z": F.col(at).cast("long") + horizon})

    def visit(ev: DataFrame, j: int, slot: Column, first: Column, last: Column) -> DataFrame:
        met = ev.withColumns({"slot": slot, "__first": first, "__last": last}).join(levels[j], [*key, "slot"], "left")
        some = F.filter("kids", lambda k: (k["c"] >= F.col("__first")) & (k["c"] <= F.col("__last")))
        met = met.withColumn("__some", some)
        return met.withColumns({
            "ahead_high": F.greatest("ahead_high", F.array_max(F.transform("__some", lambda k: k["hi"]))), "ahead_low": F.least("ahead_low", F.array_min(F.transform("__some", lambda k: k["lo"]))),
        }).drop("kids", "__some", "__first", "__last", "slot")

    for j in range(len(levels)):
        a, z = F.col("__a"), F.col("__z")
        ev = visit(ev, j, _up(a), a, z)
        if j + 1 < len(levels):  # the blocks between are whole; the last one is cut
            ev = visit(ev, j, _up(z), F.greatest(_up(z), _up(a) + 2) * FAN, z)
            ev = ev.withColumns({"__a": _up(a) + 2, "__z": _up(z) - 1})
    return ev.drop("__a", "__z")


def values_at(events: DataFrame, bars: DataFrame, cols: dict[str, str], place: Column, *, key: list[str], at: str = "idx") -> DataFrame:
    """``events`` with columns of the bar at ``place`` under the names given (bar column -> name), null where there is none."""
    right = bars.select(*key, F.col(at).cast("long").alias("__place"), *[F.col(c).alias(n) for c, n in cols.items()])
    # a null place would send all such events to one task: they look at their own bar and see nothing
    asked = events.withColumns({"__null": place.isNull(), "__place": F.coalesce(place, F.col(at)).cast("long")})
    met = asked.join(right, [*key, "__place"], "left")
    return met.withColumns({n: F.when(~F.col("__null"), F.col(n)) for n in cols.values()}).drop("__null", "__place")


def last_place(bars: DataFrame, *, key: list[str], at: str = "idx", out: str = "last_idx") -> DataFrame:
    """(key, last_idx): the number of each key's last bar."""
    return bars.groupBy(*key).agg(F.max(F.col(at)).cast("long").alias(out))
