"""Technical indicators on bars (key, ts, open, high, low, close, volume)."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.grid import higher_timeframe, ordered, up_to_now
from tidemark.operators.rolling import last_k, log_return, mean_abs_deviation, rolling, rolling_quantile, rolling_rank_pct, weighted_average, zscore
from tidemark.operators import recurrences as rec
from tidemark.operators.recurrences import Part, together
from tidemark.operators.scans import affine_scan, ema, ewm

KEY = ["symbol"]


def true_range(key: list[str] = KEY, ts: str = "ts") -> Column:
    prev = F.lag("close").over(ordered(key, ts))
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - prev), F.abs(F.col("low") - prev))


def atr_part(n: int = 14, out: str = "atr", *, key: list[str] = KEY, span: bool = False) -> Part:
    return Part({"__tr": true_range(key)}, [rec.span(out, "__tr", n, n) if span else rec.wilder(out, "__tr", n)], {})


def atr(bars: DataFrame, n: int = 14, out: str = "atr", *, key: list[str] = KEY, span: bool = False) -> DataFrame:
    return together(bars, atr_part(n, out, key=key, span=span), key=key)


def _ups_and_downs(key: list[str]) -> dict[str, Column]:
    d = F.col("close") - F.lag("close").over(ordered(key))
    return {"__up": F.when(d.isNotNull(), F.greatest(d, F.lit(0.0))), "__dn": F.when(d.isNotNull(), F.greatest(-d, F.lit(0.0)))}


def _rsi_of(out: str, undefined: float | None) -> dict[str, Column]:
    value = F.when(F.col("__ad") == 0, F.lit(undefined).cast("double")).otherwise(100 - 100 / (1 + F.col("__au") / F.col("__ad")))
    return {out: F.when(F.col("__au").isNotNull(), value)}


def rsi_part(n: int = 14, out: str = "rsi", *, key: list[str] = KEY, undefined: float | None = 100.0) -> Part:
    return Part(_ups_and_downs(key), [rec.wilder("__au", "__up", n), rec.wilder("__ad", "__dn", n)], _rsi_of(out, undefined))


def rsi(bars: DataFrame, n: int = 14, out: str = "rsi", *, key: list[str] = KEY, smooth: str = "wilder", undefined: float | None = 100.0) -> DataFrame:
    """Wilder (recursive) or simple (rolling mean) form; ``undefined`` where nothing was lost."""
    if smooth == "wilder":
        return together(bars, rsi_part(n, out, key=key, undefined=undefined), key=key)
    w = last_k(n, key)
    df = bars.withColumns(_ups_and_downs(key))
    df = df.withColumns({"__au": rolling(F.avg, F.col("__up"), w, n), "__ad": rolling(F.avg, F.col("__dn"), w, n)})
    return df.withColumns(_rsi_of(out, undefined)).drop("__up", "__dn", "__au", "__ad")


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0, *, key: list[str] = KEY) -> DataFrame:
    w, c = last_k(n, key), F.col("close")
    df = bars.withColumns({"bb_mid": rolling(F.avg, c, w, n), "__sd": rolling(F.stddev_samp, c, w, n)})
    df = df.withColumns({"bb_up": F.col("bb_mid") + k * F.col("__sd"), "bb_low": F.col("bb_mid") - k * F.col("__sd")})
    return df.withColumn("bb_width", (F.col("bb_up") - F.col("bb_low")) / F.nullif(F.col("bb_mid"), F.lit(0.0))).drop("__sd")


def keltner(bars: DataFrame, n: int = 20, k: float = 2.0, *, key: list[str] = KEY) -> DataFrame:
    mid = Part({}, [rec.span("kc_mid", "close", n)], {"kc_up": F.col("kc_mid") + k * F.col("__atr"), "kc_low": F.col("kc_mid") - k * F.col("__atr")})
    return together(bars, atr_part(n, "__atr", key=key), mid, key=key)


def macd_part(fast: int = 12, slow: int = 26, signal: int = 9) -> Part:
    gap = rec.Derived("macd", lambda f, s: f - s, ("__f", "__s"))
    return Part({}, [rec.span("__f", "close", fast), rec.span("__s", "close", slow), gap, rec.span("macd_signal", "macd", signal)], {})


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, *, key: list[str] = KEY) -> DataFrame:
    return together(bars, macd_part(fast, slow, signal), key=key)


def _share(x: np.ndarray, base: np.ndarray) -> np.ndarray:
    return 100 * x / np.where(base == 0, np.nan, base)


def adx_part(n: int = 14, *, key: list[str] = KEY) -> Part:
    w = ordered(key)
    up, dn = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
    before = {"__p": F.when(up.isNotNull(), F.when((up > dn) & (up > 0), up).otherwise(0.0)), "__m": F.when(up.isNotNull(), F.when((dn > up) & (dn > 0), dn).otherwise(0.0)), "__tr": true_range(key)}
    steps = [
        rec.wilder("__ps", "__p", n), rec.wilder("__ms", "__m", n), rec.wilder("__trs", "__tr", n), rec.Derived("di_plus", _share, ("__ps", "__trs")), rec.Derived("di_minus", _share, ("__ms", "__trs")),
        rec.Derived("__dx", lambda p, m: _share(np.abs(p - m), p + m), ("di_plus", "di_minus")), rec.wilder("adx", "__dx", n),
    ]
    return Part(before, steps, {})


def adx(bars: DataFrame, n: int = 14, *, key: list[str] = KEY) -> DataFrame:
    return together(bars, adx_part(n, key=key), key=key)


def cci(bars: DataFrame, n: int = 20, *, key: list[str] = KEY) -> DataFrame:
    w = last_k(n, key)
    df = bars.withColumn("__tp", (F.col("high") + F.col("low") + F.col("close")) / 3)
    mean, mad = rolling(F.avg, F.col("__tp"), w, n), mean_abs_deviation(F.col("__tp"), w, n)
    return df.withColumn("cci", (F.col("__tp") - mean) / F.nullif(0.015 * mad, F.lit(0.0))).drop("__tp")


def kama(bars: DataFrame, n: int = 10, fast: int = 2, slow: int = 30, *, key: list[str] = KEY) -> DataFrame:
    """Adaptive mean: an affine scan whose weight follows the efficiency ratio."""
    w = ordered(key)
    df = bars.withColumns({"__d": F.abs(F.col("close") - F.lag("close").over(w)), "__ch": F.abs(F.col("close") - F.lag("close", n).over(w))})
    df = df.withColumn("efficiency", F.col("__ch") / F.nullif(F.sum("__d").over(last_k(n, key)), F.lit(0.0)))
    f, s = 2 / (fast + 1), 2 / (slow + 1)
    sc = F.pow(F.col("efficiency") * (f - s) + s, 2)
    df = df.withColumn("__rn", F.row_number().over(w))
    start = F.col("__rn") <= n
    df = df.withColumns({"__a": F.when(start, 0.0).otherwise(1 - F.coalesce(sc, F.lit(0.0))), "__b": F.when(start, F.col("close")).otherwise(F.coalesce(sc, F.lit(0.0)) * F.col("close"))})
    return affine_scan(df, "__a", "__b", "kama", key=key).drop("__d", "__ch", "__rn", "__a", "__b")


def awesome(bars: DataFrame, *, key: list[str] = KEY) -> DataFrame:
    mid = (F.col("high") + F.col("low")) / 2
    return bars.withColumn("ao", rolling(F.avg, mid, last_k(5, key), 5) - rolling(F.avg, mid, last_k(34, key), 34))


def vwap_bands(bars: DataFrame, n: int, k: float, *, key: list[str] = KEY) -> DataFrame:
    w = last_k(n, key)
    tp = (F.col("high") + F.col("low") + F.col("close")) / 3
    df = bars.withColumn("vwap", F.when(F.count(tp).over(w) == n, F.sum(tp * F.col("volume")).over(w) / F.nullif(F.sum("volume").over(w), F.lit(0.0))))
    sd = rolling(F.stddev_samp, F.col("close") - F.col("vwap"), w, 2)
    return df.withColumn("__sd", sd).withColumns({"vwap_up": F.col("vwap") + k * F.col("__sd"), "vwap_low": F.col("vwap") - k * F.col("__sd")}).drop("__sd")


def donchian(bars: DataFrame, n: int, *, key: list[str] = KEY) -> DataFrame:
    """Extremes of the n bars before this one."""
    w = ordered(key).rowsBetween(-n, -1)
    full = F.count(F.lit(1)).over(w) == n
    return bars.withColumns({"dc_up": F.when(full, F.max("high").over(w)), "dc_low": F.when(full, F.min("low").over(w))})


def camarilla(bars: DataFrame, n: int, *, key: list[str] = KEY) -> DataFrame:
    w = ordered(key).rowsBetween(-n, -1)
    rng = (F.max("high").over(w) - F.min("low").over(w)) * 1.1 / 2
    last = F.lag("close").over(ordered(key))
    full = F.count(F.lit(1)).over(w) == n
    return bars.withColumns({"cam_r4": F.when(full, last + rng), "cam_s4": F.when(full, last - rng)})


def fib_channel(bars: DataFrame, n: int, *, key: list[str] = KEY) -> DataFrame:
    w = last_k(n, key)
    hi, lo = rolling(F.max, F.col("high"), w, n), rolling(F.min, F.col("low"), w, n)
    return bars.withColumns({"fib_382": lo + 0.382 * (hi - lo), "fib_618": lo + 0.618 * (hi - lo)})


def hull(bars: DataFrame, n: int = 16, *, key: list[str] = KEY) -> DataFrame:
    half, root = n // 2, int(math.sqrt(n))
    df = bars.withColumn("__h", 2 * weighted_average(F.col("close"), half, key) - weighted_average(F.col("close"), n, key))
    return df.withColumn("hma", weighted_average(F.col("__h"), root, key)).drop("__h")


def fractals(bars: DataFrame, *, key: list[str] = KEY) -> DataFrame:
    """Last confirmed five-bar fractal high and low, held forward from two bars later."""
    w = ordered(key)
    h = [F.lag("high", i).over(w) for i in range(5)]
    lo = [F.lag("low", i).over(w) for i in range(5)]
    up = F.when((h[2] > h[0]) & (h[2] > h[1]) & (h[2] > h[3]) & (h[2] > h[4]), h[2])
    dn = F.when((lo[2] < lo[0]) & (lo[2] < lo[1]) & (lo[2] < lo[3]) & (lo[2] < lo[4]), lo[2])
    df = bars.withColumns({"__u": up, "__d": dn})
    return df.withColumns({"fractal_up": F.last("__u", ignorenulls=True).over(up_to_now(key)), "fractal_down": F.last("__d", ignorenulls=True).over(up_to_now(key))}).drop("__u", "__d")


def realised_vol(bars: DataFrame, n: int = 30, *, key: list[str] = KEY) -> DataFrame:
    df = bars.withColumn("__r", log_return("close", key))
    return df.withColumn("realised_vol", rolling(F.stddev_samp, F.col("__r"), last_k(n, key), n)).drop("__r")


def trend_regime(bars: DataFrame, fast: int = 50, slow: int = 200, k: int = 250, *, key: list[str] = KEY) -> DataFrame:
    """EMA gap and a class 0..3: twice (volatility above its rolling median) plus (trend up)."""
    df = rec.recurrences(bars, [rec.span("__f", "close", fast), rec.span("__s", "close", slow)], key=key)
    df = realised_vol(df.withColumn("trend", F.col("__f") / F.nullif(F.col("__s"), F.lit(0.0)) - 1), key=key)
    med = rolling_quantile(F.col("realised_vol"), 0.5, last_k(k, key), 50)
    cls = F.when(med.isNotNull() & F.col("trend").isNotNull(), (F.col("realised_vol") > med).cast("int") * 2 + (F.col("trend") > 0).cast("int"))
    return df.withColumn("regime_class", cls).drop("__f", "__s")


def flat_gate(bars: DataFrame, width: str = "4 hours", n: int = 10, q: float = 0.5, k: int = 50, *, key: list[str] = KEY) -> DataFrame:
    """True where the slope of the completed coarse mean is small against its own past."""
    df = higher_timeframe(bars, width, {"close": F.max_by("close", "ts")}, key=key)
    df = ema(df, "htf_close", n, "__m", key=key)
    df = df.withColumn("__sl", F.abs(F.col("__m") - F.lag("__m").over(ordered(key))))
    return df.withColumn("flat", F.coalesce(F.col("__sl") <= rolling_quantile(F.col("__sl"), q, last_k(k, key), k), F.lit(False))).drop("__m", "__sl")


def shock(bars: DataFrame, n: int = 30, z: float = 3.0, *, key: list[str] = KEY) -> DataFrame:
    """+1 or -1 where return and volume z-scores are both extreme."""
    w = last_k(n, key)
    df = bars.withColumn("__r", log_return("close", key))
    rz, vz = zscore(F.col("__r"), w, n), zscore(F.col("volume"), w, n)
    return df.withColumn("shock", F.when((F.abs(rz) >= z) & (vz >= 1), F.signum(rz)).otherwise(0.0)).drop("__r")


def surge(bars: DataFrame, k: int, move: float, q: float, window: int, *, key: list[str] = KEY) -> DataFrame:
    """k-bar move beyond ``move`` with volume above its rolling quantile."""
    m = F.try_divide(F.col("close"), F.lag("close", k).over(ordered(key))) - 1
    busy = F.col("volume") >= rolling_quantile(F.col("volume"), q, last_k(window, key), window)
    return bars.withColumn("surge", F.coalesce((m >= move) & busy, F.lit(False)))


def climax(bars: DataFrame, n: int = 20, k: float = 2.0, *, key: list[str] = KEY) -> DataFrame:
    """Volume far above its mean on a bar that closes far from its extreme."""
    w = last_k(n, key)
    body = F.abs(F.col("close") - F.col("open"))
    rng = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    return bars.withColumn("climax", F.coalesce((F.col("volume") > k * rolling(F.avg, F.col("volume"), w, n)) & (body / rng < 0.5), F.lit(False)))


def inverse_vol_size(target: float, atr_pct: Column, lo: float = 0.25, hi: float = 1.0) -> Column:
    return F.when(atr_pct > 0, F.greatest(F.lit(lo), F.least(F.lit(hi), target / atr_pct)))


def width_rank(bars: DataFrame, n: int = 100, *, key: list[str] = KEY) -> DataFrame:
    return bollinger(bars, key=key).withColumn("width_rank", rolling_rank_pct(F.col("bb_width"), last_k(n, key), n))


def fractional_difference(bars: DataFrame, d: float, size: int, out: str = "ffd", *, key: list[str] = KEY) -> DataFrame:
    """Fixed-width fractional differencing of log prices; null if any price is missing."""
    weights = [1.0]
    for i in range(1, size):
        weights.append(-weights[-1] * (d - i + 1) / i)
    xs = F.collect_list(F.when(F.col("close") > 0, F.log("close"))).over(last_k(size, key))
    total = F.aggregate(F.zip_with(xs, F.array(*[F.lit(w) for w in reversed(weights)]), lambda x, w: x * w), F.lit(0.0), lambda a, v: a + v)
    return bars.withColumn(out, F.when(F.size(xs) == size, total))


def ewm_mean(bars: DataFrame, x: str, alpha: float, out: str, *, key: list[str] = KEY) -> DataFrame:
    return ewm(bars, x, alpha, out, key=key)
