"""Signal recipes: named, parameterised compositions of indicators and latches.

``RECIPES[name](bars, **params)`` takes (symbol, ts, open, high, low, close, volume)
and returns (symbol, ts, position). Positions are lagged one bar before they leave.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import indicators as ind
from tidemark.operators import chains, rolling, scans
from tidemark.operators.grid import daily_pivots, higher_timeframe, ordered, up_to_now
from tidemark.operators.joins import asof_join
from tidemark.operators.recurrences import together
from tidemark.operators.rolling import last_k
from tidemark.plans.base import KEY, bars, query
from tidemark.plans.recipe_sql import RECIPE_SQL

RECIPES: dict[str, Callable[..., DataFrame]] = {}
_c = F.col


def recipe(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    RECIPES[fn.__name__] = fn
    return fn


def lagged(df: DataFrame, position: str = "latched") -> DataFrame:
    return df.select("symbol", "ts", F.coalesce(F.lag(position, 1, 0.0).over(ordered(KEY)), F.lit(0.0)).alias("position"))


def prev(name: str, k: int = 1) -> Column:
    return F.lag(name, k).over(ordered(KEY))


def hysteresis(df: DataFrame, li: Column, lo: Column, si: Column, so: Column) -> DataFrame:
    return lagged(scans.latch(df.withColumns({"__li": li, "__lo": lo, "__si": si, "__so": so}), "__li", "__lo", "__si", "__so", key=KEY))


def bracket(
    df: DataFrame, enter: Column, stop: Column, target: Column, hold: int, *, trail: bool = False, leave: Column | None = None, size: Column | None = None, by_chain: bool = False,
) -> DataFrame:
    """Positions of ``scans.bracket_latch``; ``by_chain`` finds them without a task for each key."""
    df = df.withColumns({"__in": F.coalesce(enter, F.lit(0)).cast("double"), "__stop": stop.cast("double"), "__target": target.cast("double"), "__leave": F.coalesce(leave, F.lit(False)) if leave is not None else F.lit(False)})
    latch = chains.bracket_chain if by_chain else scans.bracket_latch
    df = latch(df, "__in", "close", "__stop", "__target", hold, key=KEY, trail=trail, exit_flag="__leave")
    return lagged(df if size is None else df.withColumn("latched", _c("latched") * F.coalesce(size, F.lit(1.0))))


def side(long: Column, short: Column) -> Column:
    return F.when(long, 1.0).when(short, -1.0).otherwise(0.0)


def trend(df: DataFrame, width: str = "day", n: int = 5) -> DataFrame:
    """``up``: the last completed coarse close is above its mean."""
    df = higher_timeframe(df, width, {"close": F.max_by("close", "ts")}, key=KEY)
    return scans.ema(df, "htf_close", n, "__m", key=KEY).withColumn("up", _c("htf_close") > _c("__m")).drop("__m")


@recipe
def squeeze_break(b, rank=0.3, hold=48):
    d = ind.keltner(ind.width_rank(b, 50))
    armed = prev("width_rank") <= rank
    enter = side(armed & (_c("close") > prev("bb_up")), armed & (_c("close") < prev("bb_low")))
    return bracket(d, enter, F.lit(1e9), F.lit(1e9), hold, leave=(_c("close") < _c("kc_low")) | (_c("close") > _c("kc_up")) | (_c("width_rank") > 0.98))


@recipe
def band_reversion(b, n=20, slow=100):
    d = scans.ema(ind.bollinger(b, n), "close", slow, "slow", key=KEY)
    return hysteresis(d, (_c("close") < _c("bb_low")) & (_c("close") > 0.2 * _c("slow")), _c("close") >= _c("bb_mid"), (_c("close") > _c("bb_up")) & (_c("close") < 5 * _c("slow")), _c("close") <= _c("bb_mid"))


@recipe
def band_break_trend(b, k=2.0, hold=96):
    d = trend(ind.atr(ind.bollinger(b)))
    return bracket(d, side((_c("close") > prev("bb_up")) & _c("up"), F.lit(False)), k * _c("atr"), F.lit(1e9), hold, leave=(_c("close") < _c("bb_mid")) | ~_c("up"))


@recipe
def camarilla_break(b, k=3.0, hold=24, target_vol=0.5, by_chain=False):
    d = together(ind.width_rank(ind.camarilla(b, 24), 50), ind.atr_part(), ind.adx_part(), ind.rsi_part(), key=KEY)
    hot = (_c("width_rank") > 0.3) & (_c("adx") > prev("adx"))
    enter = side((_c("close") > _c("cam_r4")) & hot & (_c("rsi") < 80), (_c("close") < _c("cam_s4")) & hot & (_c("rsi") > 20))
    return bracket(d, enter, k * _c("atr"), F.lit(1e9), hold, trail=True, size=ind.inverse_vol_size(target_vol, F.try_divide(_c("atr"), _c("close"))), by_chain=by_chain)


@recipe
def channel_fade(b, n=20, k=2.0, hold=24):
    d = ind.atr(ind.width_rank(ind.donchian(b, n), 50))
    calm = _c("width_rank") < 0.5
    mid = (_c("dc_up") + _c("dc_low")) / 2
    return bracket(d, side(calm & (_c("low") < _c("dc_low")), calm & (_c("high") > _c("dc_up"))), k * _c("atr"), F.abs(_c("close") - mid), hold)


@recipe
def band_rsi(b, lo=30.0, hi=70.0):
    d = ind.rsi(ind.bollinger(b), smooth="simple", undefined=50.0)
    return hysteresis(d, (_c("close") < _c("bb_low")) & (_c("rsi") < lo), _c("close") >= _c("bb_mid"), (_c("close") > _c("bb_up")) & (_c("rsi") > hi), _c("close") <= _c("bb_mid"))


@recipe
def fib_touch(b, n=48, k=1.5, hold=48):
    d = ind.atr(trend(ind.fib_channel(b, n)))
    return bracket(d, side((_c("low") <= _c("fib_382")) & (_c("close") > _c("fib_382")) & _c("up"), (_c("high") >= _c("fib_618")) & (_c("close") < _c("fib_618")) & ~_c("up")), k * _c("atr"), 2 * k * _c("atr"), hold)


@recipe
def fractal_break(b, fast=20, least_adx=15.0):
    d = scans.ema(ind.adx(ind.awesome(ind.fractals(trend(b)))), "close", fast, "fast", key=KEY)
    go = _c("adx") > least_adx
    long = go & (_c("ao") > 0) & _c("up") & ((_c("close") > _c("fractal_up")) | (_c("close") > _c("fast")))
    short = go & (_c("ao") < 0) & ~_c("up") & ((_c("close") < _c("fractal_down")) | (_c("close") < _c("fast")))
    return lagged(d.withColumn("latched", side(F.coalesce(long, F.lit(False)), F.coalesce(short, F.lit(False)))))


def funding_proxy(b: DataFrame) -> DataFrame:
    """A funding rate on bars: the imbalance of the bar eight hours back, as of each bar."""
    f = b.where(F.hour("ts") % 8 == 0).select("symbol", "ts", ((_c("close") - _c("open")) / F.nullif(_c("high") + _c("low"), F.lit(0.0)) / 100).alias("rate"))
    return asof_join(b, f, ["rate"], key=KEY)


@recipe
def funding_carry(b, enter=0.002, leave=0.0, cap=1.0):
    d = funding_proxy(b)
    out = hysteresis(d, F.lit(False), F.lit(True), _c("rate") >= enter, _c("rate") <= leave)
    return rolling.gross_cap(out, cap)


@recipe
def funding_reversion(b, q=0.9, k=2.0, hold=48):
    d = ind.atr(funding_proxy(b))
    hi, lo = rolling.rolling_quantile(_c("rate"), q, last_k(72, KEY), 24), rolling.rolling_quantile(_c("rate"), 1 - q, last_k(72, KEY), 24)
    steady = F.abs(F.avg("rate").over(last_k(24, KEY))) > 0.0005
    return bracket(d, side((_c("rate") <= lo) | (steady & (_c("rate") < -0.004)), (_c("rate") >= hi) | (steady & (_c("rate") > 0.004))), k * _c("atr"), k * _c("atr"), hold)


@recipe
def hull_turn(b, n=16, regime=49):
    d = ind.realised_vol(ind.rsi(ind.hull(b, n)))
    d = ind.hull(d.withColumnRenamed("hma", "fast"), regime)
    calm = _c("realised_vol") <= rolling.rolling_quantile(_c("realised_vol"), 0.9, last_k(100, KEY), 30)
    long, short = (_c("fast") > prev("fast")) & (_c("close") > _c("hma")) & (_c("rsi") < 75) & calm, (_c("fast") < prev("fast")) & (_c("close") < _c("hma")) & (_c("rsi") > 25) & calm
    return lagged(d.withColumn("latched", side(F.coalesce(long, F.lit(False)), F.coalesce(short, F.lit(False)))))


@recipe
def index_lag(b, k=24, z=0.5, leave=0.1):
    d = rolling.leave_one_out_index(b, k).withColumn("lag", _c("others") - _c("r"))
    d = rolling.cross_section(d, "lag", least=3)
    return hysteresis(d, _c("cs_z") > z, _c("cs_z") < leave, _c("cs_z") < -z, _c("cs_z") > -leave)


@recipe
def adaptive_trend(b, target_vol=0.5):
    d = ind.cci(ind.atr(ind.kama(b)))
    rising = _c("efficiency") > prev("efficiency")
    out = hysteresis(d, (_c("close") > _c("kama")) & rising & (_c("cci") > 0), _c("close") < _c("kama"), (_c("close") < _c("kama")) & rising & (_c("cci") < 0), _c("close") > _c("kama"))
    size = d.select("symbol", "ts", F.lag(ind.inverse_vol_size(target_vol, F.try_divide(_c("atr"), _c("close")))).over(ordered(KEY)).alias("size"))
    return out.join(size, ["symbol", "ts"]).select("symbol", "ts", (_c("position") * F.coalesce("size", F.lit(0.0))).alias("position"))


@recipe
def channel_pierce(b, k=2.0, hold=24):
    d = ind.adx(ind.keltner(b))
    d = ind.atr(d)
    return bracket(d, side((_c("low") < _c("kc_low")) & (_c("close") > _c("kc_low")) & (_c("adx") < 30), F.lit(False)), k * _c("atr"), F.lit(1e9), hold, leave=_c("close") >= _c("kc_mid"))


@recipe
def macd_trend(b, slow=100, least_adx=12.0, target_vol=0.5):
    d = scans.ema(ind.atr(ind.adx(ind.macd(b))), "close", slow, "slow", key=KEY)
    long = (_c("macd") > _c("macd_signal")) & (_c("close") > _c("slow")) & (_c("slow") > prev("slow")) & (_c("adx") > least_adx)
    short = (_c("macd") < _c("macd_signal")) & (_c("close") < _c("slow")) & (_c("slow") < prev("slow")) & (_c("adx") > least_adx)
    size = F.coalesce(ind.inverse_vol_size(target_vol, F.try_divide(_c("atr"), _c("close"))), F.lit(0.0))
    return lagged(d.withColumn("latched", side(F.coalesce(long, F.lit(False)), F.coalesce(short, F.lit(False))) * size))


@recipe
def interest_break(b, n=20, q=0.7, k=2.5, hold=72):
    d = trend(ind.adx(ind.atr(ind.donchian(b, n)))).withColumn("flow", _c("volume") - prev("volume"))
    strong = _c("flow") >= rolling.rolling_quantile(_c("flow"), q, last_k(72, KEY), 24)
    return bracket(d, side((_c("close") > _c("dc_up")) & strong & _c("up"), (_c("close") < _c("dc_low")) & strong & ~_c("up")), k * _c("atr"), F.lit(1e9), hold, trail=True, leave=F.avg("flow").over(last_k(6, KEY)) < -5)


def pivoted(b: DataFrame) -> DataFrame:
    return asof_join(b, daily_pivots(b, key=KEY).where("p IS NOT NULL"), ["p", "r1", "s1", "r2", "s2"], key=KEY)


@recipe
def pivot_break(b, stop=0.3, target=0.6, hold=24, by_chain=False):
    d = ind.rsi(pivoted(b), smooth="simple", undefined=None)
    return bracket(d, side((_c("close") > _c("r1")) & (_c("rsi") > 50), (_c("close") < _c("s1")) & (_c("rsi") < 50)), stop * _c("close"), target * _c("close"), hold, by_chain=by_chain)


@recipe
def pivot_turn(b):
    d = scans.ema(ind.cci(ind.rsi(funding_proxy(pivoted(b)))), "close", 50, "slow", key=KEY)
    turn_up, turn_down = _c("cci") > prev("cci"), _c("cci") < prev("cci")
    return hysteresis(d, (_c("low") <= _c("s1")) & turn_up & (_c("rsi") < 60) & (_c("rate") < 0.004), (_c("close") >= _c("p")) | (_c("cci") > 100), (_c("high") >= _c("r1")) & turn_down & (_c("rsi") > 40) & (_c("rate") > -0.004), (_c("close") <= _c("p")) | (_c("cci") < -100))


def fixed_hold(d: DataFrame, enter: Column, hold: int, gap_hours: int, sign: float = -1.0) -> DataFrame:
    """Event, then a fixed hold from the next bar, with a cooldown between entries."""
    e = d.withColumn("__go", enter).where("__go").select("symbol", F.unix_timestamp("ts").alias("s"))
    kept = scans.cooldown(e, "s", gap_hours * 3600.0, key=KEY)
    at = kept.select("symbol", F.timestamp_seconds("s").alias("ts"), F.lit(1).alias("__e"))
    m = d.select("symbol", "ts").join(at, ["symbol", "ts"], "left")
    since = F.unix_timestamp("ts") - F.last(F.when(_c("__e") == 1, F.unix_timestamp("ts")), ignorenulls=True).over(up_to_now(KEY))
    return m.select("symbol", "ts", F.when((since > 0) & (since <= hold * 3600), sign).otherwise(0.0).alias("position"))


@recipe
def shock_fade(b, z=1.5, hold=6):
    return fixed_hold(ind.shock(b, 30, z), _c("shock") > 0, hold, 12)


@recipe
def surge_fade(b, move=0.5, hold=12):
    return fixed_hold(ind.surge(b, 3, move, 0.8, 48), _c("surge"), hold, 24)


@recipe
def selective_fade(b, allowed=("click", "view", "error"), z=1.5, hold=6):
    return fixed_hold(ind.shock(b, 30, z).where(_c("symbol").isin(*allowed)), _c("shock") != 0, hold, 12)


@recipe
def session_sweep(b, first=0, last=7, close_hour=15):
    """Fade the first break of the early range that closes back inside; one trade a day."""
    day = Window.partitionBy("symbol", F.date_trunc("day", "ts"))
    early = (F.hour("ts") >= first) & (F.hour("ts") < last)
    d = b.withColumns({"hi": F.max(F.when(early, _c("high"))).over(day), "lo": F.min(F.when(early, _c("low"))).over(day)})
    live = (F.hour("ts") >= last) & (F.hour("ts") < close_hour)
    d = d.withColumn("sig", F.when(live & (_c("high") > _c("hi")) & (_c("close") < _c("hi")), -1.0).when(live & (_c("low") < _c("lo")) & (_c("close") > _c("lo")), 1.0))
    taken = F.first("sig", ignorenulls=True).over(day.orderBy("ts").rowsBetween(Window.unboundedPreceding, 0))
    return lagged(d.withColumn("latched", F.when(F.hour("ts") < close_hour, F.coalesce(taken, F.lit(0.0))).otherwise(0.0)))


@recipe
def band_rsi_overlay(b, stop=0.5):
    base = band_rsi(b)
    d = ind.atr(b).join(base, ["symbol", "ts"])
    entry = F.last(F.when((_c("position") != 0) & (prev("position") == 0), _c("close")), ignorenulls=True).over(up_to_now(KEY))
    d = d.withColumn("entry", entry)
    hurt = (_c("close") / F.nullif(_c("entry"), F.lit(0.0)) - 1) * _c("position") < -stop
    return d.select("symbol", "ts", F.when(F.coalesce(hurt, F.lit(False)), 0.0).otherwise(_c("position")).alias("position"))


@recipe
def day_open_break(b, k=0.5, trail=2.0, hold=24):
    d = trend(ind.atr(b)).withColumn("day_open", F.first("open").over(Window.partitionBy("symbol", F.date_trunc("day", "ts")).orderBy("ts")))
    busy = _c("volume") > F.avg("volume").over(last_k(24, KEY))
    return bracket(d, side((_c("close") > _c("day_open") + k * _c("atr")) & busy & _c("up"), (_c("close") < _c("day_open") - k * _c("atr")) & busy & ~_c("up")), trail * _c("atr"), F.lit(1e9), hold, trail=True)


@recipe
def climax_fail(b, hold=12):
    d = ind.atr(ind.climax(b, 20, 1.5))
    recent = F.max(_c("climax")).over(ordered(KEY).rowsBetween(-6, -1))
    top = F.max("high").over(ordered(KEY).rowsBetween(-6, -1))
    return bracket(d, side(F.lit(False), recent & (_c("high") > top) & (_c("close") < top)), _c("atr"), 1.5 * _c("atr"), hold)


@recipe
def volume_break(b, n=20, surge=1.5, stop=0.3, target=0.6, hold=24, crowd=3, worst=-0.05):
    """Break with volume behind it; spells that start with a crowd after a fall are dropped."""
    d = ind.donchian(b, n)
    busy = F.max(_c("volume") > surge * F.avg("volume").over(last_k(n, KEY))).over(last_k(3, KEY))
    out = bracket(d, side((_c("close") > _c("dc_up")) & busy, (_c("close") < _c("dc_low")) & busy), stop * _c("close"), target * _c("close"), hold)
    out = rolling.runs(out, "position", "spell", KEY)
    out = out.withColumn("fresh", (_c("position") < 0) & (_c("spell") != F.coalesce(prev("spell"), F.lit(-1))))
    moves = b.select("symbol", "ts", rolling.simple_return("close", KEY, k=6).alias("m"))
    at = Window.partitionBy("ts")
    out = out.join(moves, ["symbol", "ts"]).withColumn("bad", (F.sum(_c("fresh").cast("int")).over(at) >= crowd) & (F.avg("m").over(at) < worst) & _c("fresh"))
    dead = F.max(F.coalesce("bad", F.lit(False))).over(Window.partitionBy("symbol", "spell"))
    return out.select("symbol", "ts", F.when(dead, 0.0).otherwise(_c("position")).alias("position"))


@recipe
def vwap_reentry(b, n=24, k=1.5, stop=0.4, hold=24):
    d = ind.flat_gate(ind.vwap_bands(b, n, k), k=24)
    return bracket(d, side(_c("flat") & (prev("close") < prev("vwap_low")) & (_c("close") > _c("vwap_low")), _c("flat") & (prev("close") > prev("vwap_up")) & (_c("close") < _c("vwap_up"))), stop * _c("close"), F.abs(_c("vwap") - _c("close")), hold)


@recipe
def momentum_ranks(b, k=24, legs=2, every=6):
    d = ind.realised_vol(b).withColumn("mom", rolling.log_return("close", KEY, k=k) / F.nullif(_c("realised_vol"), F.lit(0.0)))
    return lagged(rolling.long_short_ranks(d, "mom", legs, every).withColumnRenamed("position", "latched"))


@recipe
def return_reversion(b, n=6, k=48, z=1.5, leave=0.3):
    d = b.withColumn("ret", rolling.log_return("close", KEY, k=n))
    d = d.withColumn("z", rolling.zscore(_c("ret"), last_k(k, KEY), k))
    return hysteresis(ind.flat_gate(d, k=24), (_c("z") < -z) & _c("flat"), _c("z") > -leave, (_c("z") > z) & _c("flat"), _c("z") < leave)


@recipe
def price_reversion(b, k=48, z=1.5, leave=0.3):
    d = ind.atr(b.withColumn("z", rolling.zscore(_c("close"), last_k(k, KEY), k)), span=True)
    floor = rolling.rolling_quantile(_c("atr"), 0.2, last_k(96, KEY), 24)
    moving = F.coalesce(_c("atr") >= floor, F.lit(False))
    return hysteresis(ind.flat_gate(d, k=24), (_c("z") < -z) & _c("flat") & moving, _c("z") > -leave, (_c("z") > z) & _c("flat") & moving, _c("z") < leave)


def _register(name: str) -> None:
    @query(f"recipe_{name}", RECIPE_SQL.get(name))
    def run(spark, sf):
        return RECIPES[name](bars(spark, sf)).select("symbol", "ts", "position")


for _name in RECIPES:
    _register(_name)
