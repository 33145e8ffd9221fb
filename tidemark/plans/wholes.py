"""Whole tables against joined SQL: the feature table, all configured indicators, dataset verdicts, the older set."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import calculator as calc
from tidemark.operators import dataset as ds
from tidemark.operators import features as feat
from tidemark.operators import legacy
from tidemark.operators.recursive import recursive
from tidemark.operators.rolling import Series
from tidemark.plans import evaluation, patterns, recurrences, windows  # noqa: F401 (their SQL is joined here)
from tidemark.plans.recurrences import TR, steps, wilder_sql
from tidemark.plans.registry import BARS_SQL, RAW, lag, moving, on_bars, over, pct, register
from tidemark.sources.bars import lineitem_bars

S = Series()
PARTS = (
    "bars_daily", "sma_20", "vwap", "stochastic", "bollinger", "adr_20", "obv", "returns", "price_ratios", "volatility_z", "volume_z", "adr_z", "obv_ratio", "drawdown_252",
    "percentile_rank_252", "interactions", "hammer", "volume_exhaustion", "panic_selling", "mean_reversion", "bb_squeeze", "consecutive_down", "rsi_14", "ema_20", "atr_14", "adx_14",
    "macd_v", "adosc", "obv_ema", "apz", "sar", "ht_sine", "ht_trendmode", "pivot_events", "support_tests", "days_since_low", "calendar_flags", "rsi_divergence", "hidden_divergence",
    "roc_10", "mom_10",
)


def joined(names: tuple[str, ...], wanted: set[str]) -> tuple[str, list[str]]:
    """Common tables that end in ``base``: the queries' SQL joined by series and day, each column once; and its columns."""
    tables, have = [], []
    for n in names:
        sql, columns = RAW[n]
        new = [c for c in columns if c in wanted and c not in have]
        if new:
            tables.append((f"w_{n}", sql, new))
            have += new
    ctes = ",\n".join(f"{t} AS MATERIALIZED ({sql})" for t, sql, _ in tables)
    outs = ", ".join(f"{t}.{c}" for t, _, new in tables for c in new)
    first = tables[0][0]
    joins = " ".join(f"JOIN {t} USING (stock_id, date)" for t, _, _ in tables[1:])
    return f"{ctes},\nbase AS MATERIALIZED (SELECT stock_id, date, {outs} FROM {first} {joins})", have


LABELS = ("PivotLow", "PivotLow_base", "PivotLow_event_id", "PivotLow_event_offset")
BASE_SQL, HAVE = joined(PARTS, {*feat.META, *feat.list_features(), *LABELS})
#: Derived columns whose inputs the joined SQL has, as in the feature table.
DERIVED = {f"{f}_lag{n}": lag(f, n) for f in feat.LAGGED if f in HAVE for n in feat.LAGS}
DERIVED |= {f"{f}_rolling_{s}_{w}": moving(windows.SQL_STAT[s], f, w) for f in feat.ROLLED if f in HAVE for s in feat.STATS for w in feat.WIDTHS}
DERIVED |= {
    "macd_cross": "CASE WHEN macd_hist > 0 THEN 1 ELSE 0 END", "sma_50": f"avg(close) {over(50)}", "sma_200": f"avg(close) {over(200)}",
    "rsi_change_5d": f"rsi_14 - {lag('rsi_14', 5)}", "rsi_change_10d": f"rsi_14 - {lag('rsi_14', 10)}", "macd_change_5d": f"macd_hist - {lag('macd_hist', 5)}",
    "volume_change_10d": pct("volume_ratio", 10), "atr_change_20d": pct("atr_14", 20), "adr_change_20d": pct("adr", 20),
    "rsi_volume_interaction": "rsi_14 * volume_z", "rsi_volatility_interaction": "rsi_14 * vol_z",
}
_WHOLE = {"hammer", "volume_exhaustion", "panic_selling", "statistical_bottom", "at_zscore_extreme", "bb_squeeze", "below_lower_band", "squeeze_breakdown", "consecutive_down_days", "exhaustion_signal",
          "support_test_count", "days_since_last_low", "day_of_week", "is_monday", "is_friday", "is_month_end", "is_quarter_end", "rsi_bullish_div", "rsi_bearish_div", "hidden_bullish_divergence",
          "macd_cross", "ht_trendmode", *LABELS}
#: Quotients of cents and quantities: half a thousandth is no rare value, so they keep more digits.
EXACT = {"open", "high", "low", "close", "sar", "mom_10", "mom_20"}
LARGE = {"volume", "obv", "obv_ema", "adosc", "volume_ma20"}


def digits(c: str) -> int | None:
    return None if c in _WHOLE else 1 if c in LARGE else 6 if c in EXACT or c.startswith("close_lag") else 3


FEATURES = {c: digits(c) for c in [x for x in (*HAVE, *DERIVED) if x not in ("stock_id", "date")]}
register("build_features", lambda spark, d: feat.build_features(lineitem_bars(spark, d)), f"""{BASE_SQL},
der AS (SELECT *, {', '.join(f'{x} AS {c}' for c, x in DERIVED.items())}, count(*) OVER (PARTITION BY stock_id) AS n_bars FROM base)
FINAL
SELECT * FROM der WHERE n_bars >= 252""", FEATURES)  # fmt: skip

#: Column of calculate_all -> (query whose SQL has it, its name there).
ALL = {
    "EMA_20": ("ema_20", "ema_20"), "VWAP": ("vwap", "vwap"), "RSI_14": ("rsi_14", "rsi_14"), "MACD_12_26": ("macd_v", "macd"), "MACD_signal_12_26": ("macd_v", "macd_signal"),
    "MACD_hist_12_26": ("macd_v", "macd_hist"), "ADX_14": ("adx_14", "adx"), "ROC_10": ("roc_10", "roc"), "MOM_10": ("mom_10", "mom_10"), "STOCH_K_14": ("stochastic", "stoch_k"),
    "STOCH_D_14": ("stochastic", "stoch_d"), "BBands_upper_20": ("bollinger", "bb_upper"), "BBands_middle_20": ("bollinger", "bb_middle"), "BBands_lower_20": ("bollinger", "bb_lower"),
    "ATR_14": ("atr_14", "atr_14"), "ADR_20": ("adr_20", "adr"), "APZ_upper_21": ("apz", "apz_upper"), "APZ_lower_21": ("apz", "apz_lower"), "SAR": ("sar", "sar"), "OBV": ("obv", "obv"),
    "OBV_EMA_55": ("obv_ema", "obv_ema"), "ADOSC_3_10": ("adosc", "adosc"), "Hammer": ("hammer", "hammer"), "HT_SINE": ("ht_sine", "ht_sine"), "HT_LEADSINE": ("ht_sine", "ht_leadsine"),
    "HT_TRENDMODE": ("ht_trendmode", "ht_trendmode"),
}
CONFIG = calc.IndicatorConfig(ema_periods=[5, 8, 20, 21, 50, 55, 89])
_tables = sorted({q for q, _ in ALL.values()})
SMAS = {f"SMA_{n}": f"avg(close) {over(n)}" for n in CONFIG.sma_periods}
_all_digits = {c: None if c in ("Hammer", "HT_TRENDMODE") else 1 if c in ("OBV", "OBV_EMA_55", "ADOSC_3_10") else 6 if c in ("SAR", "MOM_10") else 3 for c in (*SMAS, *ALL)}
on_bars("calculate_all", lambda b: calc.calculate_all(b, CONFIG), f""", {", ".join(f"c_{q} AS MATERIALIZED ({RAW[q][0]})" for q in _tables)},
sm AS (SELECT stock_id, date, {', '.join(f'{x} AS {c}' for c, x in SMAS.items())} FROM bars)
FINAL
SELECT stock_id, date, {', '.join(SMAS)}, {', '.join(f'c_{q}.{c} AS "{name}"' for name, (q, c) in ALL.items())} FROM sm {' '.join(f'JOIN c_{q} USING (stock_id, date)' for q in _tables)}""", **_all_digits)  # fmt: skip


def _rebuilt(b):
    import datetime

    cut, begin = datetime.datetime(1997, 6, 1), datetime.datetime(1993, 1, 1)
    old = b.where(F.col("date") < F.lit(cut)).withColumn("gone", F.lit(1.0))
    new = b.where((F.col("date") >= F.lit(begin)) & (F.dayofmonth("date") != 2)).withColumn("fresh", F.lit(1.0))
    return old, new


register("incremental_verdict", lambda spark, d: ds.incremental_verdict(*_rebuilt(lineitem_bars(spark, d))), f"""{BARS_SQL},
old AS (SELECT * FROM bars WHERE date < TIMESTAMP '1997-06-01'), new AS (SELECT * FROM bars WHERE date >= TIMESTAMP '1993-01-01' AND day(date) <> 2),
sp AS (SELECT (SELECT max(date) FROM old) AS old_last, (SELECT max(date) FROM new) AS new_last, greatest((SELECT min(date) FROM old), (SELECT min(date) FROM new)) AS lo),
ct AS (SELECT (SELECT count(*) FROM old, sp WHERE date >= lo AND date <= old_last) AS old_rows, (SELECT count(*) FROM new, sp WHERE date >= lo AND date <= old_last) AS kept_rows,
  (SELECT count(*) FROM new, sp WHERE date > old_last) AS new_rows, (SELECT count(DISTINCT date) FROM new, sp WHERE date > old_last) AS new_dates,
  (SELECT count(DISTINCT stock_id) FROM old WHERE stock_id NOT IN (SELECT stock_id FROM new)) AS lost_stocks)
FINAL
SELECT old_last, new_last, old_rows, kept_rows, new_rows, new_dates, lost_stocks, 1 AS missing_columns, 1 AS extra_columns, new_last > old_last AS extends,
  (kept_rows - old_rows) / old_rows * 100 AS row_change, abs((kept_rows - old_rows) / old_rows * 100) > 5 AS rows_warned, FALSE AS passed FROM sp, ct""",
         {"old_last": None, "new_last": None, "old_rows": None, "kept_rows": None, "new_rows": None, "new_dates": None, "lost_stocks": None, "missing_columns": None, "extra_columns": None, "extends": None, "row_change": 6, "rows_warned": None, "passed": None}, ())
register("column_sets", lambda spark, d: ds.column_sets(*_rebuilt(lineitem_bars(spark, d))).withColumnRenamed("column", "name"), """c AS (
  SELECT unnest(['stock_id', 'date', 'open', 'high', 'low', 'close', 'volume', 'gone', 'fresh']) AS name)
FINAL
SELECT name, CASE name WHEN 'gone' THEN 'old' WHEN 'fresh' THEN 'new' ELSE 'both' END AS side FROM c""", {"side": None}, ("name",))  # fmt: skip


def _bands(b):
    upper, middle, lower = legacy.weighted_bands(S)
    return b.withColumns({"upper": upper, "middle": middle, "lower": lower})


WMA = "(" + " + ".join(f"{k} * {lag('close', 20 - k) if k < 20 else 'close'}" for k in range(1, 21)) + ") / 210"
on_bars("legacy_bands", _bands, f""", w AS (SELECT *, {WMA} AS middle, {moving('stddev_pop', 'close', 20)} * 2 AS spread FROM bars)
FINAL
SELECT *, middle + spread AS upper, middle - spread AS lower FROM w""", upper=5, middle=6, lower=5)  # fmt: skip
_r = wilder_sql("tr", 14, 14, 14, "a")
on_bars("legacy_atr", lambda b: recursive(b, {"atr": ("late_atr", 14)}), f", {TR}, {steps('tr', {'a': _r[0]}, {'a': _r[1]}, 'aw')}\nFINAL\nSELECT *, CASE WHEN rn > 14 THEN a END AS atr FROM aw", atr=5)


def _seeded(x: str, n: int) -> tuple[str, str]:
    return f"x.{x} / {n}", f"CASE WHEN x.rn <= {n} THEN p.e{n} + x.{x} / {n} ELSE p.e{n} + 2::DOUBLE / {n + 1} * (x.{x} - p.e{n}) END"


_q, _12, _26 = wilder_sql("tr", 26, 26, 26, "a"), _seeded("close", 12), _seeded("close", 26)
_9 = "CASE WHEN x.rn <= 26 THEN 0 WHEN x.rn <= 35 THEN p.sg + x.line / 9 ELSE p.sg + 0.2::DOUBLE * (x.line - p.sg) END"
on_bars("legacy_macd", lambda b: recursive(b, {("line", "signal", "hist"): ("late_macd", 12, 26, 9)}), f""", {TR},
{steps('tr', {'a': _q[0], 'e12': _12[0], 'e26': _26[0]}, {'a': _q[1], 'e12': _12[1], 'e26': _26[1]}, 'lm')},
lq AS (SELECT * EXCLUDE (rn), CASE WHEN rn > 26 THEN (e12 - e26) / a * 100 END AS line FROM lm),
{steps('lq', {'sg': '0::DOUBLE'}, {'sg': _9}, 'ls')}
FINAL
SELECT *, CASE WHEN rn >= 35 THEN sg END AS signal, CASE WHEN rn >= 35 THEN line - sg END AS hist FROM ls""", line=5, signal=5, hist=5)  # fmt: skip
