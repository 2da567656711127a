"""Oracle SQL of the signal recipes, put together from parts.

A part is a CTE (symbol, t, columns); a recipe joins its parts to the bars, states its
conditions as columns and runs a latch or a bracket over them as a recursion of one
row a step.
"""

from __future__ import annotations

from tidemark.plans.base import BARS, RETS, W, ewm_sql


def frame(k: int) -> str:
    return f"(PARTITION BY symbol ORDER BY t ROWS BETWEEN {k - 1} PRECEDING AND CURRENT ROW)"


def before(k: int) -> str:
    return f"(PARTITION BY symbol ORDER BY t ROWS BETWEEN {k} PRECEDING AND 1 PRECEDING)"


def quantile(x: str, q: float, k: int, least: int) -> str:
    return f"CASE WHEN count({x}) OVER {frame(k)} >= {least} THEN quantile_cont({x}, {q}) OVER {frame(k)} END"


def zscore(x: str, k: int) -> str:
    return f"CASE WHEN count({x}) OVER {frame(k)} >= {k} THEN ({x} - avg({x}) OVER {frame(k)}) / nullif(stddev_samp({x}) OVER {frame(k)}, 0) END"


def _wma(x: str, k: int) -> str:
    return "(" + " + ".join(f"{k - i} * lag({x}, {i}) OVER w" if i else f"{k} * {x}" for i in range(k)) + f") / {k * (k + 1) / 2}"


def _coarse(name: str, seconds: int) -> str:
    return (
        f"{name} AS (SELECT b.symbol, b.t, last_value(d.prev IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.t) AS htf_close FROM bars b LEFT JOIN (SELECT symbol, t, lag(c) OVER (PARTITION BY symbol ORDER BY t) AS prev "
        f"FROM (SELECT symbol, (t // {seconds} * {seconds})::BIGINT AS t, last(close ORDER BY t) AS c FROM bars GROUP BY symbol, t // {seconds})) d ON b.symbol = d.symbol AND b.t = d.t)"
    )


def _hull(n: int, name: str) -> str:
    root = int(n**0.5)
    return f"h{n} AS (SELECT symbol, t, 2 * {_wma('close', n // 2)} - {_wma('close', n)} AS h FROM bars {W}), p_{name} AS (SELECT symbol, t, {_wma('h', root)} AS {name} FROM h{n} {W})"


def _ema(n: int) -> str:
    return ewm_sql("bars", "close", f"(2.0/{n + 1})", f"em{n}") + f", p_ema{n} AS (SELECT symbol, t, y AS ema{n} FROM em{n})"


def _flat(k: int) -> str:
    return (
        _coarse("four", 14400) + ", " + ewm_sql("four", "htf_close", "(2.0/11)", "fm")
        + f", fs AS (SELECT f.symbol, f.t, abs(m.y - lag(m.y) OVER (PARTITION BY f.symbol ORDER BY f.t)) AS sl FROM four f LEFT JOIN fm m USING (symbol, t)), p_flat{k} AS (SELECT symbol, t, coalesce(sl <= {quantile('sl', 0.5, k, k)}, false) AS flat FROM fs)"
    )


def _rsi_simple(undefined: str) -> str:
    return f"SELECT symbol, t, CASE WHEN count(up) OVER {frame(14)} >= 14 THEN CASE WHEN avg(dn) OVER {frame(14)} = 0 THEN {undefined} ELSE 100 - 100 / (1 + avg(up) OVER {frame(14)} / avg(dn) OVER {frame(14)}) END END AS rsi FROM ud"


_TR = "tr AS (SELECT *, CASE WHEN lag(close) OVER w IS NULL THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM bars " + W + ")"
_UD = "ud AS (SELECT symbol, t, CASE WHEN pc IS NOT NULL THEN greatest(close - pc, 0) END AS up, CASE WHEN pc IS NOT NULL THEN greatest(pc - close, 0) END AS dn FROM (SELECT *, lag(close) OVER w AS pc FROM bars " + W + "))"
_DM = "dm AS (SELECT symbol, t, tr, CASE WHEN u IS NOT NULL THEN CASE WHEN u > d AND u > 0 THEN u ELSE 0.0 END END AS p, CASE WHEN u IS NOT NULL THEN CASE WHEN d > u AND d > 0 THEN d ELSE 0.0 END END AS m FROM (SELECT symbol, t, tr, high - lag(high) OVER w AS u, lag(low) OVER w - low AS d FROM tr " + W + "))"

#: name -> (parts it builds on, CTEs); the CTE p_name holds the columns.
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "tr": ((), _TR),
    "ud": ((), _UD),
    "rets": ((), RETS.removeprefix(BARS + ", ")),
    "atr": (("tr",), ewm_sql("tr", "tr", "(1.0/14)", "ae") + ", p_atr AS (SELECT symbol, t, CASE WHEN rn >= 14 THEN y END AS atr FROM ae)"),
    "atr_span": (("tr",), ewm_sql("tr", "tr", "(2.0/15)", "as_") + ", p_atr_span AS (SELECT symbol, t, CASE WHEN rn >= 14 THEN y END AS atr FROM as_)"),
    "boll": ((), f"p_boll AS (SELECT symbol, t, m AS bb_mid, m + 2 * s AS bb_up, m - 2 * s AS bb_low, (m + 2 * s - (m - 2 * s)) / nullif(m, 0) AS bb_width FROM (SELECT symbol, t, CASE WHEN count(close) OVER w >= 20 THEN avg(close) OVER w END AS m, CASE WHEN count(close) OVER w >= 20 THEN stddev_samp(close) OVER w END AS s FROM bars WINDOW w AS {frame(20)}))"),
    "rank50": (("boll",), f"p_rank50 AS (SELECT symbol, t, CASE WHEN len(xs) >= 50 THEN (len(list_filter(xs, lambda v: v < bw)) + (len(list_filter(xs, lambda v: v = bw)) + 1) / 2.0) / len(xs) END AS width_rank FROM (SELECT symbol, t, bb_width AS bw, list(bb_width) FILTER (bb_width IS NOT NULL) OVER {frame(50)} AS xs FROM p_boll))"),
    "kelt": (("tr",), ewm_sql("bars", "close", "(2.0/21)", "km") + ", " + ewm_sql("tr", "tr", "(1.0/20)", "ka") + ", p_kelt AS (SELECT km.symbol, km.t, km.y AS kc_mid, CASE WHEN ka.rn >= 20 THEN km.y + 2 * ka.y END AS kc_up, CASE WHEN ka.rn >= 20 THEN km.y - 2 * ka.y END AS kc_low FROM km JOIN ka USING (symbol, t))"),
    "adx": (("tr",), _DM + ", " + ", ".join(ewm_sql("dm", x, "(1.0/14)", f"e{x}") for x in ("p", "m", "tr")) + ", di AS (SELECT symbol, t, 100 * ep.y / nullif(etr.y, 0) AS a, 100 * em.y / nullif(etr.y, 0) AS b FROM ep JOIN em USING (symbol, t) JOIN etr USING (symbol, t) WHERE ep.rn >= 14), dx AS (SELECT symbol, t, 100 * abs(a - b) / nullif(a + b, 0) AS dx FROM di), " + ewm_sql("dx", "dx", "(1.0/14)", "ax") + ", p_adx AS (SELECT symbol, t, CASE WHEN rn >= 14 THEN y END AS adx FROM ax)"),
    "rsi": (("ud",), ewm_sql("ud", "up", "(1.0/14)", "eu") + ", " + ewm_sql("ud", "dn", "(1.0/14)", "ed") + ", p_rsi AS (SELECT symbol, t, CASE WHEN eu.rn >= 14 THEN CASE WHEN ed.y = 0 THEN 100 ELSE 100 - 100 / (1 + eu.y / ed.y) END END AS rsi FROM eu JOIN ed USING (symbol, t))"),
    "rsi50": (("ud",), f"p_rsi50 AS ({_rsi_simple('50')})"),
    "rsi_null": (("ud",), f"p_rsi_null AS ({_rsi_simple('NULL')})"),
    "macd": ((), ewm_sql("bars", "close", "(2.0/13)", "mf") + ", " + ewm_sql("bars", "close", "(2.0/27)", "ms") + ", md AS (SELECT symbol, t, mf.y - ms.y AS macd FROM mf JOIN ms USING (symbol, t)), " + ewm_sql("md", "macd", "(2.0/10)", "mg") + ", p_macd AS (SELECT symbol, t, macd, mg.y AS macd_signal FROM md JOIN mg USING (symbol, t))"),
    "trend": ((), _coarse("day", 86400) + ", " + ewm_sql("day", "htf_close", "(2.0/6)", "tm") + ", p_trend AS (SELECT symbol, t, htf_close > tm.y AS up FROM day LEFT JOIN tm USING (symbol, t))"),
    "don": ((), f"p_don AS (SELECT symbol, t, CASE WHEN count(*) OVER p = 20 THEN max(high) OVER p END AS dc_up, CASE WHEN count(*) OVER p = 20 THEN min(low) OVER p END AS dc_low FROM bars WINDOW p AS {before(20)})"),
    "cam": ((), f"p_cam AS (SELECT symbol, t, CASE WHEN count(*) OVER p = 24 THEN lag(close) OVER w + (max(high) OVER p - min(low) OVER p) * 1.1 / 2 END AS cam_r4, CASE WHEN count(*) OVER p = 24 THEN lag(close) OVER w - (max(high) OVER p - min(low) OVER p) * 1.1 / 2 END AS cam_s4 FROM bars {W}, p AS {before(24)})"),
    "fib": ((), f"p_fib AS (SELECT symbol, t, CASE WHEN count(*) OVER k = 48 THEN min(low) OVER k + 0.382::DOUBLE * (max(high) OVER k - min(low) OVER k) END AS fib_382, CASE WHEN count(*) OVER k = 48 THEN min(low) OVER k + 0.618::DOUBLE * (max(high) OVER k - min(low) OVER k) END AS fib_618 FROM bars WINDOW k AS {frame(48)})"),
    "fract": ((), "p_fract AS (SELECT symbol, t, last_value(u IGNORE NULLS) OVER w AS fractal_up, last_value(d IGNORE NULLS) OVER w AS fractal_down FROM (SELECT symbol, t, CASE WHEN lag(high, 2) OVER w > greatest(high, lag(high) OVER w) AND lag(high, 2) OVER w > lag(high, 3) OVER w AND lag(high, 2) OVER w > lag(high, 4) OVER w THEN lag(high, 2) OVER w END AS u, CASE WHEN lag(low, 2) OVER w < least(low, lag(low) OVER w) AND lag(low, 2) OVER w < lag(low, 3) OVER w AND lag(low, 2) OVER w < lag(low, 4) OVER w THEN lag(low, 2) OVER w END AS d FROM bars " + W + ") " + W + ")"),
    "ao": ((), f"p_ao AS (SELECT symbol, t, CASE WHEN count(*) OVER b = 34 THEN avg((high + low) / 2) OVER a - avg((high + low) / 2) OVER b END AS ao FROM bars WINDOW a AS {frame(5)}, b AS {frame(34)})"),
    "fund": ((), "fr AS (SELECT symbol, t, (close - open) / nullif(high + low, 0) / 100 AS rate FROM bars WHERE t // 3600 % 24 % 8 = 0), p_fund AS (SELECT b.symbol, b.t, fr.rate FROM bars b ASOF LEFT JOIN fr ON b.symbol = fr.symbol AND b.t >= fr.t)"),
    "cci": ((), f"p_cci AS (SELECT symbol, t, CASE WHEN len(xs) = 20 THEN (tp - list_avg(xs)) / nullif(0.015::DOUBLE * list_avg(list_transform(xs, lambda v: abs(v - list_avg(xs)))), 0) END AS cci FROM (SELECT symbol, t, (high + low + close) / 3 AS tp, list((high + low + close) / 3) OVER {frame(20)} AS xs FROM bars))"),
    "fast": ((), _hull(16, "fast")),
    "hma": ((), _hull(49, "hma")),
    "rvol": (("rets",), f"p_rvol AS (SELECT symbol, t, CASE WHEN count(r) OVER w >= 30 THEN stddev_samp(r) OVER w END AS realised_vol FROM rets WINDOW w AS {frame(30)})"),
    "kama": ((), f"er AS (SELECT symbol, t, close, rn, abs(close - lag(close, 10) OVER w) / nullif(sum(d) OVER {frame(10)}, 0) AS er FROM (SELECT *, row_number() OVER w AS rn, abs(close - lag(close) OVER w) AS d FROM bars {W}) {W}), kn AS (SELECT *, pow(er * (2.0/3 - 2.0/31) + 2.0/31, 2) AS sc FROM er), kk AS (SELECT symbol, t, rn, close AS y FROM kn WHERE rn = 1 UNION ALL SELECT n.symbol, n.t, n.rn, CASE WHEN n.rn <= 10 THEN n.close ELSE k.y + coalesce(n.sc, 0) * (n.close - k.y) END FROM kk k JOIN kn n ON n.symbol = k.symbol AND n.rn = k.rn + 1), p_kama AS (SELECT symbol, t, y AS kama, er AS efficiency FROM kk JOIN er USING (symbol, t))"),
    "piv": ((), "dp AS (SELECT d.symbol, d.t, (y.h + y.l + y.c) / 3 AS p, 2 * ((y.h + y.l + y.c) / 3) - y.l AS r1, 2 * ((y.h + y.l + y.c) / 3) - y.h AS s1 FROM (SELECT DISTINCT symbol, (t // 86400 * 86400)::BIGINT AS t FROM bars) d JOIN (SELECT symbol, t // 86400 * 86400 AS t, max(high) AS h, min(low) AS l, last(close ORDER BY t) AS c FROM bars GROUP BY 1, 2) y ON y.symbol = d.symbol AND y.t = d.t - 86400), p_piv AS (SELECT b.symbol, b.t, dp.p, dp.r1, dp.s1 FROM bars b ASOF LEFT JOIN dp ON b.symbol = dp.symbol AND b.t >= dp.t)"),
    "shock": (("rets",), f"p_shock AS (SELECT symbol, t, CASE WHEN abs(rz) >= 1.5 AND vz >= 1 THEN sign(rz) ELSE 0 END AS shock FROM (SELECT symbol, t, {zscore('r', 30)} AS rz, {zscore('volume', 30)} AS vz FROM rets))"),
    "surge": ((), f"p_surge AS (SELECT symbol, t, coalesce(close / nullif(lag(close, 3) OVER w, 0) - 1 >= 0.5 AND volume >= {quantile('volume', 0.8, 48, 48)}, false) AS surge FROM bars {W})"),
    "climax": ((), f"p_climax AS (SELECT symbol, t, coalesce(CASE WHEN count(volume) OVER {frame(20)} >= 20 THEN volume > 1.5 * avg(volume) OVER {frame(20)} END AND abs(close - open) / nullif(high - low, 0) < 0.5, false) AS climax FROM bars)"),
    "vwap": ((), f"p_vwap AS (SELECT symbol, t, vwap, vwap + 1.5 * sd AS vwap_up, vwap - 1.5 * sd AS vwap_low FROM (SELECT symbol, t, vwap, CASE WHEN count(close - vwap) OVER w >= 2 THEN stddev_samp(close - vwap) OVER w END AS sd FROM (SELECT *, CASE WHEN count(*) OVER w = 24 THEN sum((high + low + close) / 3 * volume) OVER w / nullif(sum(volume) OVER w, 0) END AS vwap FROM bars WINDOW w AS {frame(24)}) WINDOW w AS {frame(24)}))"),
    "index": (("rets",), f"iv AS (SELECT *, sum(close * volume) OVER {frame(24)} AS dv0 FROM rets), il AS (SELECT *, lag(dv0) OVER w AS dv FROM iv {W}), ig AS (SELECT *, dv / nullif(sum(dv) OVER (PARTITION BY t), 0) AS weight FROM il WHERE r IS NOT NULL AND dv IS NOT NULL), io AS (SELECT symbol, t, close, (sum(weight * r) OVER (PARTITION BY t) - weight * r) / nullif(1 - weight, 0) - r AS lag_ FROM ig), p_index AS (SELECT symbol, t, close, CASE WHEN count(lag_) OVER x >= 3 THEN (lag_ - avg(lag_) OVER x) / nullif(stddev_samp(lag_) OVER x, 0) END AS cs_z FROM io WINDOW x AS (PARTITION BY t))"),
}
for _n in (20, 50, 100):
    PARTS[f"ema{_n}"] = ((), _ema(_n))
for _k in (24,):
    PARTS[f"flat{_k}"] = ((), _flat(_k))


def ctes(parts: str) -> str:
    """BARS and the CTEs of the parts and of what they build on, each once."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name not in done:
            for base in PARTS[name][0]:
                add(base)
            done[name] = PARTS[name][1]

    for name in parts.split():
        add(name)
    return ", ".join([BARS, *done.values()])


def joined(parts: str, extra: str = "", source: str = "bars") -> str:
    """CTEs up to ``d``: the bars with the columns of the parts, and ``extra`` columns."""
    d = f"SELECT * FROM {source}" + "".join(f" LEFT JOIN p_{p} USING (symbol, t)" for p in parts.split())
    return ctes(parts) + f", d0 AS ({d}), d AS (SELECT *{', ' + extra if extra else ''} FROM d0 {W})"


def _final(all_ctes: str, body: str) -> str:
    return f"WITH RECURSIVE {all_ctes} SELECT symbol, t, round(position, 6) AS position FROM ({body})"


LAGGED = f"SELECT symbol, t, coalesce(lag(latched) OVER w, 0.0) AS position FROM %s {W}"


def latch(li: str, lo: str, si: str, so: str) -> str:
    """CTEs n and lt (symbol, t, rn, latched) over ``d``."""
    held = "CASE WHEN (k.pos > 0 AND n.lo) OR (k.pos < 0 AND n.so) THEN 0.0 ELSE k.pos END"
    return (
        f"n AS MATERIALIZED (SELECT symbol, t, row_number() OVER w AS rn, {li} AS li, {lo} AS lo, {si} AS si, {so} AS so FROM d {W}), "
        f"lt AS (SELECT DISTINCT symbol, 0::BIGINT AS t, 0::BIGINT AS rn, 0.0::DOUBLE AS pos FROM n UNION ALL SELECT n.symbol, n.t, n.rn, CASE WHEN n.li IS NULL OR n.si IS NULL THEN 0.0 WHEN n.li AND {held} <= 0 THEN 1.0 WHEN n.si AND {held} >= 0 THEN -1.0 ELSE {held} END "
        "FROM lt k JOIN n ON n.symbol = k.symbol AND n.rn = k.rn + 1), l AS (SELECT symbol, t, pos AS latched FROM lt WHERE rn > 0)"
    )


def bracket(long: str, short: str, stop: str, target: str, hold: int, *, trail: bool = False, leave: str = "false", size: str = "1.0") -> str:
    """CTEs n, bt and l (symbol, t, latched) over ``d``."""
    entering = "k.pos = 0 AND n.go <> 0 AND n.stop IS NOT NULL AND n.target IS NOT NULL"
    best = "CASE WHEN k.pos > 0 THEN greatest(k.best, n.close) ELSE least(k.best, n.close) END"
    base = best if trail else "k.entry"
    gone = f"(n.close - {base}) * k.pos <= -k.stop OR k.held + 1 >= {hold} OR n.leave" + ("" if trail else " OR (n.close - k.entry) * k.pos >= k.target")
    pick = lambda inside, new, old: f"CASE WHEN k.pos <> 0 THEN {inside} WHEN {entering} THEN {new} ELSE {old} END"
    return (
        f"n AS MATERIALIZED (SELECT symbol, t, close, row_number() OVER w AS rn, CASE WHEN {long} THEN 1.0 WHEN {short} THEN -1.0 ELSE 0.0 END AS go, ({stop})::DOUBLE AS stop, ({target})::DOUBLE AS target, coalesce({leave}, false) AS leave, ({size})::DOUBLE AS size FROM d {W}), "
        "bt AS (SELECT DISTINCT symbol, 0::BIGINT AS t, 0::BIGINT AS rn, 0.0::DOUBLE AS pos, 0.0::DOUBLE AS entry, 0.0::DOUBLE AS best, 0.0::DOUBLE AS stop, 0.0::DOUBLE AS target, 0::BIGINT AS held, 1.0::DOUBLE AS size FROM n UNION ALL SELECT n.symbol, n.t, n.rn, "
        f"{pick(f'CASE WHEN {gone} THEN 0.0 ELSE k.pos END', 'n.go', 'k.pos')}, {pick('k.entry', 'n.close', 'k.entry')}, {pick(best, 'n.close', 'k.best')}, {pick('k.stop', 'n.stop', 'k.stop')}, {pick('k.target', 'n.target', 'k.target')}, {pick('k.held + 1', '0', 'k.held')}, n.size "
        "FROM bt k JOIN n ON n.symbol = k.symbol AND n.rn = k.rn + 1), l AS (SELECT symbol, t, pos * coalesce(size, 1.0) AS latched FROM bt WHERE rn > 0)"
    )


def _latched(parts: str, li: str, lo: str, si: str, so: str, extra: str = "", source: str = "bars") -> str:
    return joined(parts, extra, source) + ", " + latch(li, lo, si, so)


def latched_recipe(parts: str, li: str, lo: str, si: str, so: str, extra: str = "", source: str = "bars") -> str:
    return _final(_latched(parts, li, lo, si, so, extra, source), LAGGED % "l")


def bracket_recipe(parts: str, long: str, short: str, stop: str, target: str, hold: int, extra: str = "", **options) -> str:
    return _final(joined(parts, extra) + ", " + bracket(long, short, stop, target, hold, **options), LAGGED % "l")


def direct_recipe(parts: str, long: str, short: str, size: str = "1.0", extra: str = "") -> str:
    return _final(joined(parts, extra) + f", l AS (SELECT symbol, t, CASE WHEN {long} THEN 1.0 WHEN {short} THEN -1.0 ELSE 0.0 END * {size} AS latched FROM d)", LAGGED % "l")


def hold_recipe(parts: str, go: str, hold: int, gap_hours: int, where: str = "true") -> str:
    """Event, cooldown between kept events, a fixed hold from the next bar."""
    gap = gap_hours * 3600
    return _final(
        joined(parts) + f", ev AS (SELECT symbol, t, row_number() OVER w AS rn FROM d WHERE {go} AND {where} {W}), kp AS (SELECT symbol, t, rn, t AS kept FROM ev WHERE rn = 1 UNION ALL SELECT n.symbol, n.t, n.rn, CASE WHEN n.t - k.kept >= {gap} THEN n.t ELSE k.kept END FROM kp k JOIN ev n ON n.symbol = k.symbol AND n.rn = k.rn + 1)",
        f"SELECT symbol, t, CASE WHEN t - last_t > 0 AND t - last_t <= {hold * 3600} THEN -1.0 ELSE 0.0 END AS position FROM (SELECT d.symbol, d.t, last_value(CASE WHEN kp.kept = d.t THEN d.t END IGNORE NULLS) OVER (PARTITION BY d.symbol ORDER BY d.t) AS last_t FROM d LEFT JOIN kp ON kp.symbol = d.symbol AND kp.t = d.t WHERE {where.replace('symbol', 'd.symbol')})",
    )


def prev(x: str) -> str:
    return f"lag({x}) OVER w"


_SIZE = "CASE WHEN atr / nullif(close, 0) > 0 THEN greatest(0.25, least(1.0, 0.5 / (atr / nullif(close, 0)))) END"
_BAND_RSI = ("boll rsi50", "close < bb_low AND rsi < 30", "close >= bb_mid", "close > bb_up AND rsi > 70", "close <= bb_mid")
_FAR = "1e9"

RECIPE_SQL: dict[str, str] = {
    "squeeze_break": bracket_recipe("boll rank50 kelt", f"{prev('width_rank')} <= 0.3 AND close > {prev('bb_up')}", f"{prev('width_rank')} <= 0.3 AND close < {prev('bb_low')}", _FAR, _FAR, 48, leave="close < kc_low OR close > kc_up OR width_rank > 0.98"),
    "band_reversion": latched_recipe("boll ema100", "close < bb_low AND close > 0.2 * ema100", "close >= bb_mid", "close > bb_up AND close < 5 * ema100", "close <= bb_mid"),
    "band_break_trend": bracket_recipe("boll atr trend", f"close > {prev('bb_up')} AND up", "false", "2.0 * atr", _FAR, 96, leave="close < bb_mid OR NOT up"),
    "camarilla_break": bracket_recipe("cam boll rank50 atr adx rsi", f"close > cam_r4 AND width_rank > 0.3 AND adx > {prev('adx')} AND rsi < 80", f"close < cam_s4 AND width_rank > 0.3 AND adx > {prev('adx')} AND rsi > 20", "3.0 * atr", _FAR, 24, trail=True, size=_SIZE),
    "channel_fade": bracket_recipe("don boll rank50 atr", "width_rank < 0.5 AND low < dc_low", "width_rank < 0.5 AND high > dc_up", "2.0 * atr", "abs(close - (dc_up + dc_low) / 2)", 24),
    "band_rsi": latched_recipe(*_BAND_RSI),
    "fib_touch": bracket_recipe("fib trend atr", "low <= fib_382 AND close > fib_382 AND up", "high >= fib_618 AND close < fib_618 AND NOT up", "1.5 * atr", "3.0 * atr", 48),
    "fractal_break": direct_recipe("trend fract ao adx ema20", "adx > 15 AND ao > 0 AND up AND (close > fractal_up OR close > ema20)", "adx > 15 AND ao < 0 AND NOT up AND (close < fractal_down OR close < ema20)"),
    "funding_carry": _final(_latched("fund", "false", "true", "rate >= 0.002", "rate <= 0.0") + f", ps AS ({LAGGED % 'l'})", "SELECT symbol, t, position * least(1.0, coalesce(1.0 / nullif(sum(abs(position)) OVER (PARTITION BY t), 0), 1.0)) AS position FROM ps"),
    "funding_reversion": bracket_recipe(
        "fund atr", "rate <= lo OR (steady AND rate < -0.004)", "rate >= hi OR (steady AND rate > 0.004)", "2.0 * atr", "2.0 * atr", 48,
        extra=f"{quantile('rate', 0.9, 72, 24)} AS hi, {quantile('rate', 1 - 0.9, 72, 24)} AS lo, abs(avg(rate) OVER {frame(24)}) > 0.0005 AS steady",
    ),
    "hull_turn": direct_recipe("rvol rsi fast hma", "fast > fast1 AND close > hma AND rsi < 75 AND calm", "fast < fast1 AND close < hma AND rsi > 25 AND calm", extra=f"{prev('fast')} AS fast1, realised_vol <= {quantile('realised_vol', 0.9, 100, 30)} AS calm"),
    "index_lag": _final(ctes("index") + ", d AS (SELECT * FROM p_index), " + latch("cs_z > 0.5", "cs_z < 0.1", "cs_z < -0.5", "cs_z > -0.1"), LAGGED % "l"),
    "adaptive_trend": _final(
        _latched("kama atr cci", f"close > kama AND efficiency > {prev('efficiency')} AND cci > 0", "close < kama", f"close < kama AND efficiency > {prev('efficiency')} AND cci < 0", "close > kama")
        + f", ps AS ({LAGGED % 'l'}), sz AS (SELECT symbol, t, lag({_SIZE}) OVER w AS size FROM d {W})",
        "SELECT symbol, t, position * coalesce(size, 0.0) AS position FROM ps JOIN sz USING (symbol, t)",
    ),
    "channel_pierce": bracket_recipe("kelt adx atr", "low < kc_low AND close > kc_low AND adx < 30", "false", "2.0 * atr", _FAR, 24, leave="close >= kc_mid"),
    "macd_trend": direct_recipe("macd adx atr ema100", "macd > macd_signal AND close > ema100 AND ema100 > slow1 AND adx > 12", "macd < macd_signal AND close < ema100 AND ema100 < slow1 AND adx > 12", f"coalesce({_SIZE}, 0.0)", extra=f"{prev('ema100')} AS slow1"),
    "interest_break": _final(
        joined("don atr adx trend", f"volume - {prev('volume')} AS flow").replace("d AS (SELECT *", "d1 AS (SELECT *")
        + f", d AS (SELECT *, flow >= {quantile('flow', 0.7, 72, 24)} AS strong, avg(flow) OVER {frame(6)} < -5 AS ebb FROM d1), "
        + bracket("close > dc_up AND strong AND up", "close < dc_low AND strong AND NOT up", "2.5 * atr", _FAR, 72, trail=True, leave="ebb"),
        LAGGED % "l",
    ),
    "pivot_break": bracket_recipe("piv rsi_null", "close > r1 AND rsi > 50", "close < s1 AND rsi < 50", "0.3 * close", "0.6 * close", 24),
    "pivot_turn": latched_recipe(
        "piv fund rsi cci", f"low <= s1 AND cci > {prev('cci')} AND rsi < 60 AND rate < 0.004", "close >= p OR cci > 100",
        f"high >= r1 AND cci < {prev('cci')} AND rsi > 40 AND rate > -0.004", "close <= p OR cci < -100",
    ),
    "shock_fade": hold_recipe("shock", "shock > 0", 6, 12),
    "surge_fade": hold_recipe("surge", "surge", 12, 24),
    "selective_fade": hold_recipe("shock", "shock <> 0", 6, 12, "symbol IN ('click', 'view', 'error')"),
    "session_sweep": _final(
        BARS + ", e AS (SELECT *, t // 3600 % 24 AS h, t // 86400 AS day FROM bars), r AS (SELECT *, max(CASE WHEN h < 7 THEN high END) OVER x AS hi, min(CASE WHEN h < 7 THEN low END) OVER x AS lo FROM e WINDOW x AS (PARTITION BY symbol, day)), "
        "s AS (SELECT *, CASE WHEN h >= 7 AND h < 15 AND high > hi AND close < hi THEN -1.0 WHEN h >= 7 AND h < 15 AND low < lo AND close > lo THEN 1.0 END AS sig FROM r), "
        "l AS (SELECT symbol, t, CASE WHEN h < 15 THEN coalesce(first_value(sig IGNORE NULLS) OVER (PARTITION BY symbol, day ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0.0) ELSE 0.0 END AS latched FROM s)",
        LAGGED % "l",
    ),
    "band_rsi_overlay": _final(
        _latched(*_BAND_RSI) + f", ps AS ({LAGGED % 'l'}), q AS (SELECT symbol, t, close, position, CASE WHEN position <> 0 AND lag(position) OVER w = 0 THEN close END AS e FROM ps JOIN bars USING (symbol, t) {W})",
        f"SELECT symbol, t, CASE WHEN coalesce((close / nullif(last_value(e IGNORE NULLS) OVER w, 0) - 1) * position < -0.5, false) THEN 0.0 ELSE position END AS position FROM q {W}",
    ),
    "day_open_break": bracket_recipe(
        "atr trend", "close > day_open + 0.5 * atr AND busy AND up", "close < day_open - 0.5 * atr AND busy AND NOT up", "2.0 * atr", _FAR, 24, trail=True,
        extra=f"first_value(open) OVER (PARTITION BY symbol, t // 86400 ORDER BY t) AS day_open, volume > avg(volume) OVER {frame(24)} AS busy",
    ),
    "climax_fail": bracket_recipe("climax atr", "false", "recent AND high > top AND close < top", "atr", "1.5 * atr", 12, extra=f"bool_or(climax) OVER {before(6)} AS recent, max(high) OVER {before(6)} AS top"),
    "volume_break": _final(
        joined("don", f"volume > 1.5 * avg(volume) OVER {frame(20)} AS hot").replace("d AS (SELECT *", "d1 AS (SELECT *") + f", d AS (SELECT *, bool_or(hot) OVER {frame(3)} AS busy FROM d1), "
        + bracket("close > dc_up AND busy", "close < dc_low AND busy", "0.3 * close", "0.6 * close", 24)
        + f", ps AS ({LAGGED % 'l'}), ch AS (SELECT *, CASE WHEN lag(position) OVER w = position THEN 0 ELSE 1 END AS c FROM ps {W}), sp AS (SELECT *, sum(c) OVER w AS spell FROM ch {W}), "
        f"fr AS (SELECT s.symbol, s.t, s.position, s.spell, s.position < 0 AND s.c = 1 AS fresh, b.m FROM sp s JOIN (SELECT symbol, t, close / nullif(lag(close, 6) OVER w, 0) - 1 AS m FROM bars {W}) b USING (symbol, t)), "
        "bd AS (SELECT *, coalesce(sum(fresh::INT) OVER (PARTITION BY t) >= 3 AND avg(m) OVER (PARTITION BY t) < -0.05 AND fresh, false) AS bad FROM fr)",
        "SELECT symbol, t, CASE WHEN bool_or(bad) OVER (PARTITION BY symbol, spell) THEN 0.0 ELSE position END AS position FROM bd",
    ),
    "vwap_reentry": bracket_recipe("vwap flat24", f"flat AND {prev('close')} < {prev('vwap_low')} AND close > vwap_low", f"flat AND {prev('close')} > {prev('vwap_up')} AND close < vwap_up", "0.4 * close", "abs(vwap - close)", 24),
    "momentum_ranks": _final(
        joined("rvol", "CASE WHEN close > 0 AND lag(close, 24) OVER w > 0 THEN ln(close / lag(close, 24) OVER w) END AS lr")
        + ", m AS (SELECT symbol, t, lr / nullif(realised_vol, 0) AS mom FROM d), x AS (SELECT t, row_number() OVER (ORDER BY t) - 1 AS i FROM (SELECT DISTINCT t FROM bars)), "
        "k AS (SELECT symbol, t, CASE WHEN count(*) OVER (PARTITION BY t) < 4 THEN 0.0 WHEN row_number() OVER (PARTITION BY t ORDER BY mom DESC, symbol) <= 2 THEN 0.25 WHEN row_number() OVER (PARTITION BY t ORDER BY mom, symbol) <= 2 THEN -0.25 ELSE 0.0 END AS p FROM m JOIN x USING (t) WHERE mom IS NOT NULL AND i % 6 = 0), "
        f"l AS (SELECT m.symbol, m.t, coalesce(last_value(CASE WHEN i % 6 = 0 THEN coalesce(p, 0.0) END IGNORE NULLS) OVER (PARTITION BY m.symbol ORDER BY m.t), 0.0) AS latched FROM m JOIN x USING (t) LEFT JOIN k ON k.symbol = m.symbol AND k.t = m.t)",
        LAGGED % "l",
    ),
    "return_reversion": _final(
        joined("flat24", "CASE WHEN close > 0 AND lag(close, 6) OVER w > 0 THEN ln(close / lag(close, 6) OVER w) END AS ret").replace("d AS (SELECT *", "d1 AS (SELECT *")
        + f", d AS (SELECT *, {zscore('ret', 48)} AS z FROM d1), " + latch("z < -1.5 AND flat", "z > -0.3", "z > 1.5 AND flat", "z < 0.3"),
        LAGGED % "l",
    ),
    "price_reversion": latched_recipe(
        "atr_span flat24", "z < -1.5 AND flat AND moving", "z > -0.3", "z > 1.5 AND flat AND moving", "z < 0.3",
        extra=f"{zscore('close', 48)} AS z, coalesce(atr >= {quantile('atr', 0.2, 96, 24)}, false) AS moving",
    ),
}

#: The gate alone, with its own defaults.
FLAT_SQL = f"WITH RECURSIVE {BARS}, {_flat(50)} SELECT symbol, t, flat FROM p_flat50"
