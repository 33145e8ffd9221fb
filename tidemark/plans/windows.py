"""Queries of moving-window indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import advanced as adv
from tidemark.operators import features as feat
from tidemark.operators import indicators as ind
from tidemark.operators.rolling import Series, flag
from tidemark.plans.registry import BARS_SQL, lag, lead, moving, on_bars, over, pct, register

S = Series()
NUM = "row_number() OVER (PARTITION BY stock_id ORDER BY date)"


def _bars(spark, d):
    from tidemark.sources.bars import lineitem_bars

    return lineitem_bars(spark, d)


def _nations(spark, d):
    from tidemark.sources.bars import nation_bars

    return nation_bars(spark, d)


register("bars_daily", _bars, f"{BARS_SQL}\nFINAL\nSELECT * FROM bars", {"open": 6, "high": 6, "low": 6, "close": 6, "volume": 3})
register("bars_by_nation", _nations, """nb AS (
  SELECT 'N' || c_nationkey AS stock_id, o_orderdate AS date, arg_min(o_totalprice, row(o_orderkey, o_totalprice)) AS open, max(o_totalprice) AS high,
         min(o_totalprice) AS low, arg_max(o_totalprice, row(o_orderkey, o_totalprice)) AS close, count(*)::DOUBLE AS volume
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
FINAL
SELECT * FROM nb""", {"open": 4, "high": 4, "low": 4, "close": 4, "volume": 1})  # fmt: skip

on_bars("sma_20", lambda b: b.withColumn("sma_20", ind.sma(S, "close", 20)), f"{moving('avg', 'close', 20, 1)} AS sma_20", sma_20=6)
on_bars("sma_gated", lambda b: b.withColumn("sma_50", S.mean("close", 50)), f"{moving('avg', 'close', 50)} AS sma_50", sma_50=6)
on_bars("wma_10", lambda b: b.withColumn("wma_10", ind.wma(S, "close", 10)), "(" + " + ".join(f"{k} * {lag('close', 10 - k)}" for k in range(1, 11)) + ") / 55 AS wma_10", wma_10=6)
on_bars("vwap", lambda b: ind.vwap(b, S), f"sum((high + low + close) / 3 * volume) {over()} / nullif(sum(volume) {over()}, 0) AS vwap", vwap=6)
on_bars("roc_10", lambda b: b.withColumn("roc", ind.roc(S)), f"(close - {lag('close', 10)}) / nullif({lag('close', 10)}, 0) * 100 AS roc", roc=6)
on_bars("mom_10", lambda b: b.withColumns({"mom_10": ind.momentum(S), "mom_20": ind.momentum(S, "close", 20)}), f"close - {lag('close', 10)} AS mom_10, close - {lag('close', 20)} AS mom_20", mom_10=6, mom_20=6)

STOCH = f""", f AS (
  SELECT *, CASE WHEN {NUM} >= 14 THEN CASE WHEN max(high) {over(14)} = min(low) {over(14)} THEN 50.0
      ELSE (close - min(low) {over(14)}) / (max(high) {over(14)} - min(low) {over(14)}) * 100 END END AS fast FROM bars),
k AS (SELECT *, avg(fast) {over(3)} AS stoch_k FROM f)
FINAL
SELECT *, avg(stoch_k) {over(3)} AS stoch_d FROM k"""
on_bars("stochastic", lambda b: ind.stochastic(b, S), STOCH, stoch_k=6, stoch_d=6)


def _bands(b):
    u, m, lo = ind.bollinger(S)
    b = b.withColumns({"bb_upper": u, "bb_middle": m, "bb_lower": lo})
    return b.withColumns({"bb_position": F.try_divide(F.col("close") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")), "bb_width": F.try_divide(F.col("bb_upper") - F.col("bb_lower"), F.col("bb_middle"))})


BANDS = f"""bb AS (
  SELECT *, {moving('avg', 'close', 20)} + 2 * {moving('stddev_samp', 'close', 20)} AS bb_upper, {moving('avg', 'close', 20)} AS bb_middle,
         {moving('avg', 'close', 20)} - 2 * {moving('stddev_samp', 'close', 20)} AS bb_lower FROM bars)"""
on_bars("bollinger", _bands, f""", {BANDS}
FINAL
SELECT *, (close - bb_lower) / nullif(bb_upper - bb_lower, 0) AS bb_position, (bb_upper - bb_lower) / nullif(bb_middle, 0) AS bb_width FROM bb""",
        bb_upper=6, bb_middle=6, bb_lower=6, bb_position=6, bb_width=6)
on_bars("adr_20", lambda b: b.withColumn("adr", ind.adr(S)), f"round_even(100 * ({moving('avg', 'high / nullif(low, 0)', 20)} - 1), 2) AS adr", adr=2)
on_bars("true_range", lambda b: b.withColumn("tr", ind.true_range(S)), f"greatest(high - low, abs(high - {lag('close')}), abs(low - {lag('close')})) AS tr", tr=6)
OBV = f"""sg AS (
  SELECT *, CASE WHEN {lag('close')} IS NULL THEN volume WHEN close > {lag('close')} THEN volume WHEN close < {lag('close')} THEN -volume ELSE 0 END AS sv FROM bars),
ob AS (SELECT *, sum(sv) {over()} AS obv FROM sg)"""
on_bars("obv", lambda b: ind.with_obv(b, S), f", {OBV}\nFINAL\nSELECT * FROM ob", obv=3)
AD = f"sum(CASE WHEN high = low THEN 0 ELSE (2 * close - low - high) / (high - low) END * volume) {over()}"
on_bars("ad_line", lambda b: b.withColumn("ad", ind.ad_line(S)), f"{AD} AS ad", ad=4)
on_bars("returns", lambda b: b.withColumns({f"ret_{k}d": S.pct("close", k) for k in (1, 5, 10, 20)}), ", ".join(f"{pct('close', k)} AS ret_{k}d" for k in (1, 5, 10, 20)), ret_1d=8, ret_5d=8, ret_10d=8, ret_20d=8)


def _ratios(b):
    b = ind.vwap(b, S).withColumns({f"sma_{k}": ind.sma(S, "close", k) for k in (20, 50, 200)})
    rel = lambda a, c: F.try_divide(F.col(a) - F.col(c), F.col(c))
    return b.withColumns({"price_to_sma20": rel("close", "sma_20"), "price_to_sma50": rel("close", "sma_50"), "price_to_sma200": rel("close", "sma_200"), "sma20_to_sma50": rel("sma_20", "sma_50"), "price_to_vwap": rel("close", "vwap")})


on_bars("price_ratios", _ratios, f""", m AS (
  SELECT *, avg(close) {over(20)} AS a, avg(close) {over(50)} AS b, avg(close) {over(200)} AS c,
         sum((high + low + close) / 3 * volume) {over()} / nullif(sum(volume) {over()}, 0) AS v FROM bars)
FINAL
SELECT *, (close - a) / a AS price_to_sma20, (close - b) / b AS price_to_sma50, (close - c) / c AS price_to_sma200, (a - b) / b AS sma20_to_sma50, (close - v) / v AS price_to_vwap FROM m""",
        price_to_sma20=8, price_to_sma50=8, price_to_sma200=8, sma20_to_sma50=8, price_to_vwap=8)


def z(c: str, n: int) -> str:
    return f"({c} - {moving('avg', c, n)}) / nullif({moving('stddev_samp', c, n)}, 0)"


on_bars("volatility_z", lambda b: b.withColumn("r", S.pct("close", 1)).withColumn("volatility_20d", S.std("r", 20)).withColumn("vol_z", S.z("volatility_20d", 60)), f""", r AS (SELECT *, {pct('close', 1)} AS r FROM bars), v AS (SELECT *, {moving('stddev_samp', 'r', 20)} AS volatility_20d FROM r)
FINAL
SELECT *, {z('volatility_20d', 60)} AS vol_z FROM v""", volatility_20d=8, vol_z=5)  # fmt: skip
on_bars("volume_z", lambda b: b.withColumn("volume_ma20", S.mean("volume", 20)).withColumn("volume_ratio", F.try_divide(F.col("volume"), F.col("volume_ma20"))).withColumn("volume_z", S.z("volume_ratio", 60)), f""", a AS (SELECT *, {moving('avg', 'volume', 20)} AS volume_ma20 FROM bars), v AS (SELECT *, volume / nullif(volume_ma20, 0) AS volume_ratio FROM a)
FINAL
SELECT *, {z('volume_ratio', 60)} AS volume_z FROM v""", volume_ma20=6, volume_ratio=8, volume_z=5)  # fmt: skip
on_bars("adr_z", lambda b: b.withColumn("adr", ind.adr(S)).withColumn("adr_z", S.z("adr", 60)), f""", a AS (SELECT *, round_even(100 * ({moving('avg', 'high / nullif(low, 0)', 20)} - 1), 2) AS adr FROM bars)
FINAL
SELECT *, {z('adr', 60)} AS adr_z FROM a""", adr_z=5)  # fmt: skip
on_bars("obv_ratio", lambda b: ind.with_obv(b, S).withColumn("m", S.mean("obv", 20)).withColumn("obv_ratio", F.try_divide(F.col("obv"), F.col("m"))), f""", {OBV}, m AS (SELECT *, {moving('avg', 'obv', 20)} AS m FROM ob)
FINAL
SELECT *, obv / nullif(m, 0) AS obv_ratio FROM m""", obv_ratio=6)  # fmt: skip
on_bars("drawdown_252", lambda b: b.withColumn("high_252", S.max("high", 252, 20)).withColumn("drawdown", F.try_divide(F.col("close") - F.col("high_252"), F.col("high_252"))), f""", h AS (SELECT *, {moving('max', 'high', 252, 20)} AS high_252 FROM bars)
FINAL
SELECT *, (close - high_252) / high_252 AS drawdown FROM h""", high_252=6, drawdown=8)  # fmt: skip
on_bars("lag_features", lambda b: b.withColumn("ret_1d", S.pct("close", 1)).withColumns({f"{c}_lag{k}": S.lag(c, k) for c in ("close", "ret_1d") for k in feat.LAGS}), f""", r AS (SELECT *, {pct('close', 1)} AS ret_1d FROM bars)
FINAL
SELECT *, {', '.join(f'{lag(c, k)} AS {c}_lag{k}' for c in ('close', 'ret_1d') for k in feat.LAGS)} FROM r""", **{f"{c}_lag{k}": 8 for c in ("close", "ret_1d") for k in feat.LAGS})  # fmt: skip
SQL_STAT = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}
on_bars("rolling_stats", lambda b: b.withColumn("ret_1d", S.pct("close", 1)).withColumns({f"ret_1d_rolling_{s}_{w}": getattr(S, s)("ret_1d", w) for s in feat.STATS for w in feat.WIDTHS}), f""", r AS (SELECT *, {pct('close', 1)} AS ret_1d FROM bars)
FINAL
SELECT *, {', '.join(f"{moving(SQL_STAT[s], 'ret_1d', w)} AS ret_1d_rolling_{s}_{w}" for s in feat.STATS for w in feat.WIDTHS)} FROM r""", **{f"ret_1d_rolling_{s}_{w}": 5 for s in feat.STATS for w in feat.WIDTHS})  # fmt: skip
on_bars("change_features", lambda b: b.withColumns({"adr": ind.adr(S), "m": S.mean("volume", 20)}).withColumn("v", F.try_divide(F.col("volume"), F.col("m"))).withColumns({"volume_change_10d": S.pct("v", 10), "adr_change_20d": S.pct("adr", 20)}), f""", a AS (SELECT *, round_even(100 * ({moving('avg', 'high / nullif(low, 0)', 20)} - 1), 2) AS adr, {moving('avg', 'volume', 20)} AS m FROM bars), v AS (SELECT *, volume / nullif(m, 0) AS v FROM a)
FINAL
SELECT *, {pct('v', 10)} AS volume_change_10d, {pct('adr', 20)} AS adr_change_20d FROM v""", volume_change_10d=6, adr_change_20d=6)  # fmt: skip
on_bars("percentile_rank_252", lambda b: b.withColumn("close_percentile_252", S.rank_share("close", 252, 50)), f"CASE WHEN count(close) {over(252)} >= 50 THEN len(list_filter(list(close) {over(252)}, lambda x: x <= close)) / count(close) {over(252)} END AS close_percentile_252", close_percentile_252=8)
on_bars("interactions", lambda b: adv.panic_selling(b.withColumn("h", S.max("high", 252, 20)), S).withColumn("drawdown_panic_interaction", (F.col("close") - F.col("h")) / F.col("h") * F.col("panic_severity")), f""", r AS (SELECT *, {pct('close', 1)} AS ret, {moving('avg', 'volume', 20)} AS vm, {moving('max', 'high', 252, 20)} AS h FROM bars),
s AS (SELECT *, {moving('stddev_samp', 'ret', 20)} AS sd, volume / CASE WHEN vm = 0 THEN 1 ELSE vm END AS spike FROM r)
FINAL
SELECT *, (close - h) / h * CASE WHEN spike > 2 AND ret < -2 * sd THEN least(10, greatest(0, spike * abs(ret / CASE WHEN sd = 0 THEN 1 ELSE sd END))) ELSE 0 END AS drawdown_panic_interaction FROM s""", drawdown_panic_interaction=6)  # fmt: skip
on_bars("hammer", lambda b: b.withColumn("hammer", ind.hammer()), """CASE WHEN high > low AND least(open, close) - low >= 2 * abs(close - open) AND high - greatest(open, close) <= 0.1::DOUBLE * (high - low)
  AND abs(close - open) <= 0.3::DOUBLE * (high - low) THEN 100 ELSE 0 END AS hammer""", hammer=None)  # fmt: skip
LAB = f""", r0 AS (SELECT *, {pct('close', 1)} AS r FROM bars), r AS (SELECT *, {lag('r')} AS r1 FROM r0)"""
on_bars("efficiency_accel", lambda b: ind.custom(b, S)[0], f"""{LAB}, s AS (SELECT *, {moving('sum', 'r', 5)} AS s5 FROM r)
FINAL
SELECT *, abs({moving('sum', 'r', 10)}) / ({moving('sum', 'abs(r)', 10)} + 1e-10) AS price_efficiency_10, s5 - {lag('s5', 5)} AS return_accel_10, {moving('max', 'volume', 5)} / ({moving('avg', 'volume', 20, 10)} + 1e-10) AS volume_climax_ratio FROM s""",
        price_efficiency_10=7, return_accel_10=7, volume_climax_ratio=6)
on_bars("skew_kurt_20", lambda b: ind.custom(b, S)[0], f"{LAB}\nFINAL\nSELECT *, {moving('skewness', 'r', 20, 15)} AS returns_skew_20, {moving('kurtosis', 'r', 20, 15)} AS returns_kurtosis_20 FROM r", returns_skew_20=5, returns_kurtosis_20=5)
on_bars("autocorr_10", lambda b: ind.custom(b, S)[0], f"{LAB}\nFINAL\nSELECT *, CASE WHEN count(CASE WHEN r IS NOT NULL AND r1 IS NOT NULL THEN 1 END) {over(10)} >= 8 THEN corr(r, r1) {over(10)} END AS return_autocorr_10 FROM r", return_autocorr_10=5)
on_bars("volume_exhaustion", lambda b: adv.volume_exhaustion(b, S), f""", c AS (SELECT *, {pct('close', 5)} AS p, CASE WHEN {lag('volume', 5)} = 0 THEN 0 ELSE {pct('volume', 5)} END AS v FROM bars)
FINAL
SELECT *, CASE WHEN p < -0.02::DOUBLE AND v < -0.1::DOUBLE THEN 1 ELSE 0 END AS volume_exhaustion, CASE WHEN p < 0 AND v < 0 THEN abs(p) * abs(v) * 100 ELSE 0 END AS exhaustion_strength FROM c""", volume_exhaustion=None, exhaustion_strength=6)  # fmt: skip
on_bars("panic_selling", lambda b: adv.panic_selling(b, S), f""", r AS (SELECT *, {pct('close', 1)} AS ret, {moving('avg', 'volume', 20)} AS vm FROM bars),
s AS (SELECT *, {moving('stddev_samp', 'ret', 20)} AS sd, volume / CASE WHEN vm = 0 THEN 1 ELSE vm END AS spike FROM r)
FINAL
SELECT *, CASE WHEN spike > 2 AND ret < -2 * sd THEN 1 ELSE 0 END AS panic_selling,
  CASE WHEN spike > 2 AND ret < -2 * sd THEN least(10, greatest(0, spike * abs(ret / CASE WHEN sd = 0 THEN 1 ELSE sd END))) ELSE 0 END AS panic_severity FROM s""", panic_selling=None, panic_severity=6)  # fmt: skip
on_bars("mean_reversion", lambda b: adv.mean_reversion(b, S), f""", z AS (SELECT *, (close - {moving('avg', 'close', 252, 100)}) / CASE WHEN {moving('stddev_samp', 'close', 252, 100)} = 0 THEN 1 ELSE {moving('stddev_samp', 'close', 252, 100)} END AS price_zscore FROM bars)
FINAL
SELECT *, CASE WHEN price_zscore < -2 THEN 1 ELSE 0 END AS statistical_bottom, CASE WHEN price_zscore <= {moving('min', 'price_zscore', 252, 100)} + 0.2::DOUBLE THEN 1 ELSE 0 END AS at_zscore_extreme FROM z""", price_zscore=6, statistical_bottom=None, at_zscore_extreme=None)  # fmt: skip
on_bars("bb_squeeze", lambda b: adv.squeeze_breakdown(b, S), f""", {BANDS}, w AS (SELECT *, (bb_upper - bb_lower) / nullif(bb_middle, 0) AS width FROM bb),
q AS (SELECT *, CASE WHEN width <= {moving('min', 'width', 20, 10)} * 1.05::DOUBLE THEN 1 ELSE 0 END AS bb_squeeze, CASE WHEN close < bb_lower THEN 1 ELSE 0 END AS below_lower_band FROM w)
FINAL
SELECT *, bb_squeeze * below_lower_band AS squeeze_breakdown FROM q""", bb_squeeze=None, below_lower_band=None, squeeze_breakdown=None)  # fmt: skip
on_bars("consecutive_down", lambda b: adv.exhaustion_sequence(b, S), f""", r AS (SELECT *, {pct('close', 1)} AS r FROM bars),
g AS (SELECT *, CASE WHEN r < 0 THEN 1 ELSE 0 END AS down, {lag('r')} AS r1, sum(CASE WHEN r < 0 THEN 0 ELSE 1 END) {over()} AS run FROM r),
c AS (SELECT *, (sum(down) OVER (PARTITION BY stock_id, run ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::INTEGER AS consecutive_down_days, r - r1 AS selling_acceleration FROM g)
FINAL
SELECT *, CASE WHEN consecutive_down_days >= 4 AND selling_acceleration > 0 AND r < 0 THEN 1 ELSE 0 END AS exhaustion_signal FROM c""", consecutive_down_days=None, selling_acceleration=8, exhaustion_signal=None)  # fmt: skip
on_bars("flags_macd_style", lambda b: b.withColumn("up", flag(F.col("close") > S.lag("close"))).withColumn("next_open", S.lead("open")), f"CASE WHEN close > {lag('close')} THEN 1 ELSE 0 END AS up, {lead('open')} AS next_open", up=None, next_open=6)
