"""Queries of recurrences; their SQL walks all series together, one bar a step."""

from __future__ import annotations

from tidemark.operators import indicators as ind
from tidemark.operators.recursive import ewm_fold, recursive
from tidemark.operators.rolling import Series
from tidemark.plans.registry import lag, on_bars, over
from tidemark.plans.windows import AD, OBV

S = Series()


def steps(source: str, first: dict[str, str], then: dict[str, str], out: str) -> str:
    """Common tables: states of each series from its first bar on. In ``then``, p is the state and x the bar."""
    names = ", ".join(first)
    return f"""n_{out} AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY date) AS rn FROM {source}),
{out}_s(stock_id, rn, {names}) AS (
  SELECT x.stock_id, x.rn, {', '.join(first.values())} FROM n_{out} x WHERE x.rn = 1
  UNION ALL
  SELECT x.stock_id, x.rn, {', '.join(then.values())} FROM {out}_s p JOIN n_{out} x ON x.stock_id = p.stock_id AND x.rn = p.rn + 1),
{out} AS (SELECT n.* EXCLUDE (rn), s.* EXCLUDE (stock_id) FROM n_{out} n JOIN {out}_s s ON n.stock_id = s.stock_id AND n.rn = s.rn)"""


def ewm_sql(x: str, span: int) -> tuple[str, str]:
    """First and next value of an exponential average of column x, in a state of the same name as ``e_`` + x."""
    a = f"(2::DOUBLE / {span + 1})"
    return f"x.{x}", f"{a} * x.{x} + (1 - {a}) * p."


def wilder_sql(x: str, n: int, first: int, count: int, state: str, start: str | None = None) -> tuple[str, str]:
    """Wilder's average in one state: a running sum of the seed's values, then the average from bar ``first`` (0-based) on."""
    begin = first - count + 1
    seed = f"CASE WHEN {begin} <= 0 THEN x.{x} / {count} ELSE 0 END"
    step = f"CASE WHEN x.rn - 1 < {begin} THEN 0 WHEN x.rn - 1 <= {first} THEN p.{state} + x.{x} / {count} ELSE (p.{state} * {n - 1} + x.{x}) / {n} END"
    return seed, step


MOVES = f"mv AS (SELECT *, greatest(coalesce(close - {lag('close')}, 0), 0) AS up, greatest(coalesce({lag('close')} - close, 0), 0) AS dn FROM bars)"
_u, _d = wilder_sql("up", 14, 14, 14, "u"), wilder_sql("dn", 14, 14, 14, "d")
RSI_SQL = f"""{MOVES},
{steps('mv', {'u': _u[0], 'd': _d[0]}, {'u': _u[1], 'd': _d[1]}, 'r0')},
rs AS (SELECT *, CASE WHEN rn > 14 THEN CASE WHEN d = 0 THEN 100 ELSE 100 - 100 / (1 + u / d) END END AS rsi_14 FROM r0)"""
on_bars("rsi_14", lambda b: recursive(b, {"rsi_14": ("rsi", 14)}), f", {RSI_SQL}\nFINAL\nSELECT * FROM rs", rsi_14=5)

_e = wilder_sql("close", 20, 19, 20, "e")
on_bars("ema_20", lambda b: recursive(b, {"ema_20": ("ema", 20)}), f""", {steps('bars', {'e': 'x.close / 20'}, {'e': 'CASE WHEN x.rn <= 20 THEN p.e + x.close / 20 ELSE p.e + 2::DOUBLE / 21 * (x.close - p.e) END'}, 'em')}
FINAL
SELECT *, CASE WHEN rn >= 20 THEN e END AS ema_20 FROM em""", ema_20=6)  # fmt: skip
_f, _n = ewm_sql("close", 20)
EWM = f", {steps('bars', {'e': _f}, {'e': _n + 'e'}, 'em')}\nFINAL\nSELECT *, e AS ewm_20 FROM em"
on_bars("ewm_20", lambda b: recursive(b, {"ewm_20": ("ewm", 20)}), EWM, ewm_20=6)
on_bars("ewm_20_fold", lambda b: ewm_fold(b, "close", 20, "ewm_20"), EWM, ewm_20=6)
TR = f"tr AS (SELECT *, greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr FROM bars)"
_a = wilder_sql("tr", 14, 13, 14, "a")
on_bars("atr_14", lambda b: recursive(b, {"atr_14": ("atr", 14)}), f", {TR}, {steps('tr', {'a': _a[0]}, {'a': _a[1]}, 'aw')}\nFINAL\nSELECT *, CASE WHEN rn >= 14 THEN a END AS atr_14 FROM aw", atr_14=6)
_w = [wilder_sql(c, 14, 14, 15, s) for c, s in (("tr", "a"), ("pdm", "u"), ("mdm", "d"))]
_x = wilder_sql("dx", 14, 28, 15, "q")
on_bars("adx_14", lambda b: recursive(b, {"adx": ("adx", 14)}), f""", {TR},
dm AS (SELECT *, high - {lag('high')} AS hi, {lag('low')} - low AS lo FROM tr),
pm AS (SELECT *, CASE WHEN hi > lo AND hi > 0 THEN hi ELSE 0 END AS pdm, CASE WHEN lo > hi AND lo > 0 THEN lo ELSE 0 END AS mdm FROM dm),
{steps('pm', {'a': _w[0][0], 'u': _w[1][0], 'd': _w[2][0]}, {'a': _w[0][1], 'u': _w[1][1], 'd': _w[2][1]}, 'di')},
dx AS (SELECT * EXCLUDE (rn), CASE WHEN rn > 14 AND a > 0 AND u + d > 0 THEN 100 * abs(u - d) / (u + d) ELSE 0 END AS dx FROM di),
{steps('dx', {'q': _x[0]}, {'q': _x[1]}, 'ax')}
FINAL
SELECT *, CASE WHEN rn > 28 THEN q END AS adx FROM ax""", adx=5)  # fmt: skip
_m = wilder_sql("tr", 26, 25, 26, "a")
_12, _26 = ewm_sql("close", 12), ewm_sql("close", 26)
on_bars("macd_v", lambda b: recursive(b, {("macd", "macd_signal", "macd_hist"): ("macd_v", 12, 26, 9)}), f""", {TR},
{steps('tr', {'a': _m[0], 'e12': _12[0], 'e26': _26[0]}, {'a': _m[1], 'e12': _12[1] + 'e12', 'e26': _26[1] + 'e26'}, 'mc')},
mq AS (SELECT * EXCLUDE (rn), CASE WHEN rn >= 26 THEN (e12 - e26) / nullif(a, 0) * 100 END AS macd FROM mc),
{steps('mq', {'sg': 'x.macd'}, {'sg': 'CASE WHEN p.sg IS NULL THEN x.macd ELSE 0.2::DOUBLE * x.macd + 0.8::DOUBLE * p.sg END'}, 'ms')}
FINAL
SELECT *, sg AS macd_signal, macd - sg AS macd_hist FROM ms""", macd=5, macd_signal=5, macd_hist=5)  # fmt: skip
_3, _10 = ewm_sql("ad", 3), ewm_sql("ad", 10)
on_bars("adosc", lambda b: recursive(b.withColumn("ad", ind.ad_line(S)), {"a3": ("ewm", {"close": "ad"}, 3), "a10": ("ewm", {"close": "ad"}, 10)}).selectExpr("*", "a3 - a10 as adosc"), f""", ad AS (SELECT *, {AD} AS ad FROM bars),
{steps('ad', {'f': _3[0], 's': _10[0]}, {'f': _3[1] + 'f', 's': _10[1] + 's'}, 'ao')}
FINAL
SELECT *, f - s AS adosc FROM ao""", adosc=4)  # fmt: skip
_o = ewm_sql("obv", 55)
on_bars("obv_ema", lambda b: recursive(ind.with_obv(b, S), {"obv_ema": ("ewm", {"close": "obv"}, 55)}), f", {OBV}, {steps('ob', {'e': _o[0]}, {'e': _o[1] + 'e'}, 'oe')}\nFINAL\nSELECT *, e AS obv_ema FROM oe", obv_ema=4)
A4 = "0.4::DOUBLE"
on_bars("apz", lambda b: recursive(b, {("apz_upper", "apz_lower"): ("apz", 21, 2.0)}), f""", rg AS (SELECT *, high - low AS rg FROM bars),
{steps('rg', {'c1': 'x.close', 'c2': 'x.close', 'r1': 'x.rg', 'r2': 'x.rg'}, {
    'c1': f'{A4} * x.close + (1 - {A4}) * p.c1', 'c2': f'{A4} * ({A4} * x.close + (1 - {A4}) * p.c1) + (1 - {A4}) * p.c2',
    'r1': f'{A4} * x.rg + (1 - {A4}) * p.r1', 'r2': f'{A4} * ({A4} * x.rg + (1 - {A4}) * p.r1) + (1 - {A4}) * p.r2'}, 'az')}
FINAL
SELECT *, c2 + 2 * r2 AS apz_upper, c2 - 2 * r2 AS apz_lower FROM az""", apz_upper=5, apz_lower=5)  # fmt: skip
#: The parabolic stop on mirrored prices: sg is 1 in a long run and -1 in a short one; st and ep are mirrored with it.
_moved = "(p.st + p.af * (p.ep - p.st))"
_turn = f"(CASE WHEN p.sg = 1 THEN x.low ELSE -x.high END < {_moved})"
_good = "(CASE WHEN p.sg = 1 THEN x.high ELSE -x.low END)"
_floor = "CASE WHEN p.sg = 1 THEN least(coalesce(x.l1, 1e300), coalesce(x.l2, 1e300)) ELSE least(coalesce(-x.h1, 1e300), coalesce(-x.h2, 1e300)) END"
on_bars("sar", lambda b: recursive(b, {"sar": ("sar", 0.02, 0.2)}), f""", hl AS (SELECT *, {lag('low', 1)} AS l1, {lag('low', 2)} AS l2, {lag('high', 1)} AS h1, {lag('high', 2)} AS h2 FROM bars),
{steps('hl', {'sg': '1', 'st': 'x.low', 'ep': 'x.high', 'af': '0.02::DOUBLE'}, {
    'sg': f'CASE WHEN {_turn} THEN -p.sg ELSE p.sg END',
    'st': f'CASE WHEN {_turn} THEN -p.ep WHEN x.rn > 2 THEN least({_moved}, {_floor}) ELSE {_moved} END',
    'ep': f'CASE WHEN {_turn} THEN CASE WHEN p.sg = 1 THEN -x.low ELSE x.high END ELSE greatest(p.ep, {_good}) END',
    'af': f'CASE WHEN {_turn} THEN 0.02::DOUBLE WHEN {_good} > p.ep THEN least(p.af + 0.02::DOUBLE, 0.2::DOUBLE) ELSE p.af END'}, 'sr')}
FINAL
SELECT *, sg * st AS sar FROM sr""", sar=6)  # fmt: skip
#: Hilbert transform: lags in plain windows, the two smoothings as a recurrence.
L = lambda c, k: f"coalesce({lag(c, k)}, 0)"
HT = f"""h0 AS (SELECT *, row_number() OVER (PARTITION BY stock_id ORDER BY date) - 1 AS i, count(*) OVER (PARTITION BY stock_id) AS len FROM bars),
h1 AS (SELECT *, CASE WHEN i >= 7 THEN (0.0962::DOUBLE * (close - {L('close', 6)}) + 0.5769::DOUBLE * ({L('close', 2)} - {L('close', 4)})) * (0.075::DOUBLE * (i - 6) + 0.54::DOUBLE) ELSE 0 END AS dt FROM h0),
h2 AS (SELECT *, CASE WHEN i >= 7 THEN 1.25::DOUBLE * ({L('dt', 4)} - 0.33::DOUBLE * {L('dt', 6)}) ELSE 0 END AS ip, CASE WHEN i >= 7 THEN {L('dt', 2)} ELSE 0 END AS qd FROM h1),
{steps('h2', {'si': '0::DOUBLE', 'sq': '0::DOUBLE'}, {'si': 'CASE WHEN x.rn > 7 THEN 0.33::DOUBLE * x.ip + 0.67::DOUBLE * p.si ELSE 0 END', 'sq': 'CASE WHEN x.rn > 7 THEN 0.33::DOUBLE * x.qd + 0.67::DOUBLE * p.sq ELSE 0 END'}, 'ht')},
hp AS (SELECT *, CASE WHEN i < 7 THEN 0 ELSE atan(sq / nullif(si, 0)) END AS ph0, sqrt(si * si + sq * sq) AS amp FROM ht),
hq AS (SELECT *, last_value(ph0 IGNORE NULLS) {over()} AS ph FROM hp)"""
on_bars("ht_sine", lambda b: recursive(b, {("ht_sine", "ht_leadsine"): ("ht_sine",)}), f", {HT}\nFINAL\nSELECT *, CASE WHEN len >= 32 THEN sin(ph) END AS ht_sine, CASE WHEN len >= 32 THEN sin(ph + pi() / 4) END AS ht_leadsine FROM hq", ht_sine=5, ht_leadsine=5)
on_bars("ht_trendmode", lambda b: recursive(b, {"ht_trendmode": ("ht_trendmode", 0.5)}), f", {HT}\nFINAL\nSELECT *, CASE WHEN len >= 32 THEN CASE WHEN i >= 14 AND amp > 0.5::DOUBLE * avg(amp) {over(back=-7, ahead=-1)} THEN 1::DOUBLE ELSE 0::DOUBLE END END AS ht_trendmode FROM hq", ht_trendmode=None)
