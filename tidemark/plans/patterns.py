"""Queries of turning points, events and divergences."""

from __future__ import annotations

from tidemark.operators import advanced as adv
from tidemark.operators import patterns as pat
from tidemark.operators.recursive import recursive
from tidemark.operators.rolling import Series
from tidemark.plans.recurrences import RSI_SQL
from tidemark.plans.registry import lag, lead, on_bars, over

S = Series()
NUM = "row_number() OVER (PARTITION BY stock_id ORDER BY date)"


def sql_pivot(c: str, low: bool, left: int = 8, right: int = 13) -> str:
    sign, f = ("<", "min") if low else (">", "max")
    ahead = over(back=1, ahead=right)
    return f"CASE WHEN {c} {sign} {f}({c}) {over(back=-left, ahead=-1)} AND {c} {sign} {f}({c}) {ahead} AND {NUM} > {left} AND count(*) {ahead} = {right} THEN 1 ELSE 0 END"


PIV = f"pv AS (SELECT *, {sql_pivot('close', False)} AS ph, {sql_pivot('close', True)} AS pl FROM bars)"
on_bars("pivots", lambda b: pat.pivots(b, S), f", {PIV}\nFINAL\nSELECT *, ph AS pivot_high, pl AS pivot_low FROM pv", pivot_high=None, pivot_low=None)
on_bars("pivots_high_low", lambda b: pat.pivots(b, S, use_close=False, values=True), f"{'CASE WHEN ' + sql_pivot('high', False) + ' = 1 THEN high END'} AS pivot_high, {'CASE WHEN ' + sql_pivot('low', True) + ' = 1 THEN low END'} AS pivot_low", pivot_high=6, pivot_low=6)


def near(p: str, f, k: int = 1) -> str:
    return f"({f(p, k)} = 1 AND abs(close - {f('close', k)}) / {f('close', k)} <= 0.01::DOUBLE)"


on_bars("pivots_expanded", lambda b: pat.pivots(b, S, around=(-1, 1)), f""", {PIV}
FINAL
SELECT *, CASE WHEN ph = 1 OR {near('ph', lag)} OR {near('ph', lead)} THEN 1 ELSE 0 END AS pivot_high, CASE WHEN pl = 1 OR {near('pl', lag)} OR {near('pl', lead)} THEN 1 ELSE 0 END AS pivot_low FROM pv""", pivot_high=None, pivot_low=None)  # fmt: skip
on_bars("centred_pivots", lambda b: pat.centred_pivots(b, S), f"CASE WHEN count(*) {over(back=-8, ahead=8)} = 17 AND high = max(high) {over(back=-8, ahead=8)} THEN 1 ELSE 0 END AS pivot_high, CASE WHEN count(*) {over(back=-8, ahead=8)} = 17 AND low = min(low) {over(back=-8, ahead=8)} THEN 1 ELSE 0 END AS pivot_low", pivot_high=None, pivot_low=None)


def sql_low(n: int, sign: str = "min", c: str = "close") -> str:
    return f"CASE WHEN {c} = {sign}({c}) {over(n)} AND {NUM} >= {n} THEN 1 ELSE 0 END"


on_bars("local_extrema", lambda b: b.withColumns({"local_low": pat.local_low(S), "local_high": pat.local_high(S)}), f"{sql_low(8)} AS local_low, {sql_low(8, 'max')} AS local_high", local_low=None, local_high=None)
#: Events over a SQL table named bars; gives ev with the four label columns.
EVENTS_SQL = f"""{PIV},
pn AS (SELECT *, sum(pl) {over()} AS no FROM pv),
ev AS (
  SELECT *, CASE WHEN pl = 1 THEN no WHEN before AND after THEN CASE WHEN {lag('close')} <= {lead('close')} THEN {lag('no')} ELSE {lead('no')} END WHEN before THEN {lag('no')} WHEN after THEN {lead('no')} ELSE 0 END::INTEGER AS "PivotLow_event_id",
         CASE WHEN pl = 1 THEN 0 WHEN before AND after THEN CASE WHEN {lag('close')} <= {lead('close')} THEN 1 ELSE -1 END WHEN before THEN 1 WHEN after THEN -1 END::FLOAT AS "PivotLow_event_offset",
         pl::TINYINT AS "PivotLow_base", CASE WHEN pl = 1 OR before OR after THEN 1 ELSE 0 END::TINYINT AS "PivotLow"
  FROM (SELECT *, coalesce({near('pl', lag)}, FALSE) AS before, coalesce({near('pl', lead)}, FALSE) AS after FROM pn))"""
on_bars("pivot_events", lambda b: pat.events(b, S), f", {EVENTS_SQL}\nFINAL\nSELECT * FROM ev", PivotLow=None, PivotLow_base=None, PivotLow_event_id=None, PivotLow_event_offset=None)
on_bars("support_tests", lambda b: pat.support_tests(b.withColumn("LocalLow", pat.local_low(S)), S), f""", l AS (SELECT *, {sql_low(8)} AS ll FROM bars)
FINAL
SELECT *, coalesce(len(list_filter(list(CASE WHEN ll = 1 THEN close END) OVER (PARTITION BY stock_id ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lambda p: abs(p - close) / close < 0.02::DOUBLE)), 0)::INTEGER AS support_test_count FROM l""", support_test_count=None)  # fmt: skip
on_bars("days_since_low", lambda b: adv.time_features(b.withColumn("LocalLow", pat.local_low(S)), S), f""", l AS (SELECT *, {sql_low(8)} AS ll FROM bars)
FINAL
SELECT *, date_diff('day', last_value(CASE WHEN ll = 1 THEN date END IGNORE NULLS) {over()}, date)::INTEGER AS days_since_last_low FROM l""", days_since_last_low=None)  # fmt: skip
on_bars("calendar_flags", lambda b: adv.time_features(b.withColumn("LocalLow", pat.local_low(S)), S), """(isodow(date) - 1)::INTEGER AS day_of_week, CASE WHEN isodow(date) = 1 THEN 1 ELSE 0 END AS is_monday, CASE WHEN isodow(date) = 5 THEN 1 ELSE 0 END AS is_friday,
  CASE WHEN day(date) >= 28 THEN 1 ELSE 0 END AS is_month_end, CASE WHEN day(date) >= 28 AND month(date) IN (3, 6, 9, 12) THEN 1 ELSE 0 END AS is_quarter_end""", day_of_week=None, is_monday=None, is_friday=None, is_month_end=None, is_quarter_end=None)  # fmt: skip


def prev(value: str, mark: str, frame: str) -> str:
    return f"last_value(CASE WHEN {mark} = 1 THEN {value} END IGNORE NULLS) OVER (PARTITION BY stock_id ORDER BY date ROWS BETWEEN {frame})"


_rsi = lambda b: recursive(b, {"rsi_14": ("rsi", 14)})
FAR = "60 PRECEDING AND 5 PRECEDING"
on_bars("rsi_divergence", lambda b: pat.rsi_divergence(_rsi(b), S), f""", {RSI_SQL},
x AS (SELECT *, {sql_low(5)} AS ll, {sql_low(5, 'max')} AS lh FROM rs),
y AS (SELECT *, {prev('close', 'll', FAR)} AS lp, {prev('coalesce(rsi_14, -1)', 'll', FAR)} AS lr0, {prev('close', 'lh', FAR)} AS hp, {prev('coalesce(rsi_14, -1)', 'lh', FAR)} AS hr0 FROM x),
t AS (SELECT *, nullif(lr0, -1) AS lr, nullif(hr0, -1) AS hr FROM y),
u AS (SELECT *, coalesce(ll = 1 AND close < lp AND rsi_14 > lr, FALSE) AS bull, coalesce(lh = 1 AND close > hp AND rsi_14 < hr, FALSE) AS bear FROM t)
FINAL
SELECT *, bull::INTEGER AS rsi_bullish_div, bear::INTEGER AS rsi_bearish_div, CASE WHEN bear THEN ((close - hp) / hp + (hr - rsi_14) / 100) / 2 WHEN bull THEN ((lp - close) / lp + (rsi_14 - lr) / 100) / 2 ELSE 0 END AS rsi_div_strength FROM u""",
        rsi_bullish_div=None, rsi_bearish_div=None, rsi_div_strength=6)
PAST = "UNBOUNDED PRECEDING AND 1 PRECEDING"
on_bars("hidden_divergence", lambda b: pat.hidden_divergence(_rsi(b).withColumn("LocalLow", pat.local_low(S)), S), f""", {RSI_SQL},
x AS (SELECT *, {sql_low(8)} AS ll FROM rs), y AS (SELECT *, {prev('close', 'll', PAST)} AS lp, nullif({prev('coalesce(rsi_14, -1)', 'll', PAST)}, -1) AS lr FROM x)
FINAL
SELECT *, CASE WHEN ll = 1 AND close > lp AND rsi_14 < lr THEN 1 ELSE 0 END AS hidden_bullish_divergence FROM y""", hidden_bullish_divergence=None)  # fmt: skip


def _multi(b):
    from tidemark.operators import indicators as ind

    b = ind.stochastic(_rsi(b), S).withColumn("mom_10", ind.momentum(S))
    return pat.lower_lows(b.withColumn("LocalLow", pat.local_low(S)), S, ("rsi_14", "mom_10", "stoch_k"))


on_bars("multi_divergence", _multi, f""", {RSI_SQL},
f AS (SELECT *, close - {lag('close', 10)} AS mom, {sql_low(8)} AS ll, CASE WHEN {NUM} >= 14 THEN CASE WHEN max(high) {over(14)} = min(low) {over(14)} THEN 50.0 ELSE (close - min(low) {over(14)}) / (max(high) {over(14)} - min(low) {over(14)}) * 100 END END AS fast FROM rs),
k AS (SELECT *, avg(fast) {over(3)} AS sk FROM f),
y AS (SELECT *, {prev('close', 'll', PAST)} AS lp, nullif({prev('coalesce(rsi_14, -1e9)', 'll', PAST)}, -1e9) AS l1, nullif({prev('coalesce(mom, -1e9)', 'll', PAST)}, -1e9) AS l2, nullif({prev('coalesce(sk, -1e9)', 'll', PAST)}, -1e9) AS l3 FROM k)
FINAL
SELECT *, CASE WHEN ll = 1 AND close < lp THEN coalesce((rsi_14 > l1)::INTEGER, 0) + coalesce((mom > l2)::INTEGER, 0) + coalesce((sk > l3)::INTEGER, 0) ELSE 0 END AS multi_divergence_score FROM y""", multi_divergence_score=None)  # fmt: skip
