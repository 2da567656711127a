"""Price levels: zones of swings, their strength, distances and rejections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import range_join


def _anchored(prices: Column, tol: float) -> Column:
    """(total, n) of greedy zones over ascending prices: a price joins while it is within ``tol`` of the zone's first or equals it, as zeros do."""
    kind = "array<struct<anchor: double, total: double, n: bigint>>"

    def zone(anchor: Column, total: Column, n: Column) -> Column:
        return F.array(F.struct(anchor.alias("anchor"), total.alias("total"), n.alias("n")))

    def take(found: Column, x: Column) -> Column:
        last = F.get(found, F.size(found) - 1)
        near = F.coalesce(F.try_divide(x - last["anchor"], last["anchor"]) <= tol, F.lit(False)) | F.coalesce(x == last["anchor"], F.lit(False))
        grown = F.concat(F.slice(found, F.lit(1), F.size(found) - 1), zone(last["anchor"], last["total"] + x, last["n"] + 1))
        return F.when(near, grown).otherwise(F.concat(found, zone(x, x, F.lit(1).cast("long"))))

    return F.aggregate(prices, F.array().cast(kind), take)


def _merged(prices: Column, tol: float) -> Column:
    """(total, n) of zones over ascending prices: the two with the smallest relative gap merge, while it is at most ``tol``."""
    mean = lambda z: z["total"] / z["n"]
    start = F.transform(prices, lambda x: F.struct(x.alias("total"), F.lit(1).cast("long").alias("n")))

    def merge(z: Column, _: Column) -> Column:
        gaps = F.transform(z, lambda c, i: F.try_divide(mean(F.get(z, i + 1)) - mean(c), mean(c)))  # null after the last
        least = F.array_min(gaps)
        j = F.array_position(gaps, least).cast("int")
        a, b = F.get(z, j - 1), F.get(z, j)
        both = F.array(F.struct((a["total"] + b["total"]).alias("total"), (a["n"] + b["n"]).alias("n")))
        joined = F.concat(F.slice(z, F.lit(1), j - 1), both, F.slice(z, j + 2, F.greatest(F.size(z) - j - 1, F.lit(0))))
        return F.when(F.coalesce(least <= tol, F.lit(False)), joined).otherwise(z)

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(prices) - 1, F.lit(1))), start, merge)


def zones(swings: DataFrame, every: int, life: int, tol: float, least: int, *, key: list[str], merge: str = "anchor") -> DataFrame:
    """(key, at, level, strength): swings confirmed in the last ``life`` bars, clustered every ``every`` bars.

    With ``merge`` "anchor" a price belongs to a zone while it is at most ``tol`` above the
    zone's first; with "centroid" neighbouring zones merge, smallest relative gap of their means first,
    while that is at most ``tol``. A zone is the mean of its swings, with ``least`` of them or
    more, from ``at`` for ``every`` bars. Every swing is dealt to the life / every recomputations
    that see it; one of these holds the swings of ``life`` bars, so no key is gathered.
    """
    s = swings.where("is_high OR is_low").select(*key, F.col("confirmed_idx").cast("long").alias("c"), F.explode(F.filter(F.array(F.when(F.col("is_high"), F.col("high")), F.when(F.col("is_low"), F.col("low"))), lambda x: x.isNotNull())).alias("price"))
    first = F.ceil(F.col("c") / every).cast("long")
    last = F.floor((F.col("c") + life - 1) / every).cast("long")
    dealt = s.where(last >= first).withColumn("at", F.explode(F.sequence(first, last))).withColumn("at", F.col("at") * every)
    prices = dealt.groupBy(*key, "at").agg(F.sort_array(F.collect_list(F.col("price").cast("double"))).alias("__p"))  # bounded by ``life``
    found = {"anchor": _anchored, "centroid": _merged}[merge](F.col("__p"), tol)
    g = prices.withColumn("__z", F.explode(found)).select(*key, "at", (F.col("__z.total") / F.col("__z.n")).alias("level"), F.col("__z.n").alias("strength"))
    return g.where(F.col("strength") >= least)


def strongest(found: DataFrame, m: int, *, key: list[str]) -> DataFrame:
    """The ``m`` strongest zones of each recomputation; the lower level wins ties."""
    w = Window.partitionBy(*key, "at").orderBy(F.col("strength").desc(), "level")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= m)


def distance_profile(bars: DataFrame, found: DataFrame, every: int, edges: list[float], x: str, *, key: list[str]) -> DataFrame:
    """Mean of ``x`` and rows by the distance of the close from the nearest zone, in bins of ``edges``."""
    spans = found.select(*key, "level", F.col("at").alias("from_idx"), (F.col("at") + every).alias("to_idx"))
    j = range_join(bars, spans, key=key, at="idx", start="from_idx", end="to_idx", width=every)
    near = j.groupBy(*key, "idx").agg(F.min(F.abs(F.col("close") - F.col("level")) / F.nullif(F.abs(F.col("level")), F.lit(0.0))).alias("d"), F.first(x).alias("x"))
    bin_ = F.lit(len(edges))
    for i in range(len(edges) - 1, -1, -1):
        bin_ = F.when(F.col("d") < edges[i], i).otherwise(bin_)
    return near.where("d IS NOT NULL").groupBy(bin_.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("mean"))


def rejection(level: Column, tol: float, kind: str, *, resistance: bool) -> Column:
    """True where a bar turns from a level: "wick" closes at the far third, "inside" pierces and closes back."""
    high, low, close = F.col("high"), F.col("low"), F.col("close")
    rng = F.greatest(high - low, F.lit(1e-12))
    if kind == "wick":
        return (close < level * (1 - tol)) & (close <= low + rng * 0.33) if resistance else (close > level * (1 + tol)) & (close >= high - rng * 0.33)
    if kind == "inside":
        return (high > level * (1 + tol)) & (close < level) if resistance else (low < level * (1 - tol)) & (close > level)
    raise ValueError(f"no such rejection: {kind}")


def divergences(swings: DataFrame, oscillator: str, least: int, most: int, *, key: list[str]) -> DataFrame:
    """(key, idx, kind): successive swings whose price goes on and whose oscillator does not (div) or does (conf)."""
    out = None
    for flag, price, kind in (("is_high", "high", "bear"), ("is_low", "low", "bull")):
        w = Window.partitionBy(*key).orderBy("idx")
        s = swings.where(flag).withColumns({"__i": F.lag("idx").over(w), "__p": F.lag(price).over(w), "__o": F.lag(oscillator).over(w)})
        further = F.col(price) > F.col("__p") if kind == "bear" else F.col(price) < F.col("__p")
        apart = F.col(oscillator) < F.col("__o") if kind == "bear" else F.col(oscillator) > F.col("__o")
        d = s.where((F.col("idx") - F.col("__i")).between(least, most) & further & F.col(oscillator).isNotNull() & F.col("__o").isNotNull())
        d = d.select(*key, "idx", "confirmed_idx", F.when(apart, f"{kind}_div").otherwise(f"{kind}_conf").alias("kind"))
        out = d if out is None else out.unionByName(d)
    return out
