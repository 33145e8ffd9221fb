"""The feature pipeline: bars to a wide table of backward-looking features and centred-window labels."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import advanced as adv
from tidemark.operators import indicators as ind
from tidemark.operators import patterns as pat
from tidemark.operators.recursive import recursive
from tidemark.operators.rolling import Series, flag

# Fixed names of the feature catalog.
BASE_FEATURES = (
    "ret_1d", "ret_5d", "ret_10d", "ret_20d", "sma_20", "sma_50", "sma_200", "ema_20", "vwap", "price_to_sma20", "price_to_sma50",
    "price_to_sma200", "price_to_vwap", "sma20_to_sma50", "rsi_14", "rsi_30", "macd", "macd_signal", "macd_hist", "macd_cross", "adx",
    "roc", "mom_10", "mom_20", "stoch_k", "stoch_d", "bb_upper", "bb_middle", "bb_lower", "bb_position", "bb_width", "atr_14", "adr",
    "adr_z", "sar", "apz_upper", "apz_lower", "volatility_20d", "vol_z", "obv", "obv_ema", "obv_ratio", "adosc", "volume_ma20",
    "volume_ratio", "volume_z", "hammer", "rsi_bullish_div", "rsi_bearish_div", "rsi_div_strength", "ht_sine", "ht_leadsine",
    "ht_trendmode", "high_252", "drawdown",
)
LAGGED = (
    "close", "ret_1d", "rsi_14", "macd_hist", "adx", "stoch_k", "volatility_20d", "bb_position", "atr_14", "adr", "volume_ratio",
    "obv_ratio", "drawdown", "price_to_sma20", "price_to_sma50",
)
LAGS = (1, 2, 3, 5, 10)
ROLLED, STATS, WIDTHS = ("ret_1d", "rsi_14", "volatility_20d", "volume_z"), ("mean", "std", "min", "max"), (5, 10, 20, 60)
CHANGES = ("rsi_change_5d", "rsi_change_10d", "volume_change_10d", "atr_change_20d", "adr_change_20d", "macd_change_5d")
PERCENTILES = ("close_percentile_252", "rsi_percentile_60")
INTERACTIONS = ("rsi_volume_interaction", "drawdown_panic_interaction", "rsi_volatility_interaction")

CATALOG: dict[str, tuple[str, ...]] = {
    "base": BASE_FEATURES,
    "advanced": adv.ADVANCED,
    "lag": tuple(f"{f}_lag{n}" for f in LAGGED for n in LAGS),
    "rolling": tuple(f"{f}_rolling_{s}_{w}" for f in ROLLED for s in STATS for w in WIDTHS),
    "roc": CHANGES,
    "percentile": PERCENTILES,
    "interaction": INTERACTIONS,
}
META = ("date", "stock_id", "open", "high", "low", "close", "volume")
LABELS = (pat.LABEL, pat.BASE, pat.EVENT, pat.OFFSET, "PivotHigh")


def list_features(groups: Iterable[str] | None = None) -> list[str]:
    """Feature names of the groups (all by default); unknown groups are left out."""
    return [f for g in (groups or CATALOG) for f in CATALOG.get(g, ())]


def with_base(df: DataFrame, s: Series) -> DataFrame:
    """The base features: plain windows level by level, and all recurrences in one grouped map."""
    df = recursive(df.withColumn("__ad", ind.ad_line(s)).transform(ind.with_obv, s), {
        "ema_20": ("ema", 20), "rsi_14": ("rsi", 14), "rsi_30": ("rsi", 30), ("macd", "macd_signal", "macd_hist"): ("macd_v", 12, 26, 9),
        "adx": ("adx", 14), "atr_14": ("atr", 14), "sar": ("sar", 0.02, 0.2), ("apz_upper", "apz_lower"): ("apz", 21, 2.0),
        "obv_ema": ("ewm", {"close": "obv"}, 55), "__ad3": ("ewm", {"close": "__ad"}, 3), "__ad10": ("ewm", {"close": "__ad"}, 10),
        ("ht_sine", "ht_leadsine"): ("ht_sine",), "ht_trendmode": ("ht_trendmode", 0.5),
    }, s.key, s.order)
    upper, middle, lower = ind.bollinger(s)
    df = df.withColumns({
        "adosc": F.col("__ad3") - F.col("__ad10"), **{f"ret_{k}d": s.pct("close", k) for k in (1, 5, 10, 20)}, **{f"sma_{k}": ind.sma(s, "close", k) for k in (20, 50, 200)},
        "macd_cross": flag(F.col("macd_hist") > 0), "roc": ind.roc(s), "mom_10": ind.momentum(s, "close", 10), "mom_20": ind.momentum(s, "close", 20),
        "bb_upper": upper, "bb_middle": middle, "bb_lower": lower, "adr": ind.adr(s), "volume_ma20": s.mean("volume", 20), "hammer": ind.hammer(),
        "high_252": s.max("high", 252, 20), "__obv20": s.mean("obv", 20),
    })
    df = ind.stochastic(ind.vwap(df, s), s)
    over = lambda a, b: F.try_divide(F.col(a) - F.col(b), F.col(b))
    df = df.withColumns({
        **{f"price_to_sma{k}": over("close", f"sma_{k}") for k in (20, 50, 200)}, "price_to_vwap": over("close", "vwap"), "sma20_to_sma50": over("sma_20", "sma_50"),
        "bb_position": F.try_divide(F.col("close") - F.col("bb_lower"), F.col("bb_upper") - F.col("bb_lower")), "bb_width": F.try_divide(F.col("bb_upper") - F.col("bb_lower"), F.col("bb_middle")),
        "adr_z": s.z("adr", 60), "volatility_20d": s.std("ret_1d", 20), "volume_ratio": F.try_divide(F.col("volume"), F.col("volume_ma20")),
        "obv_ratio": F.try_divide(F.col("obv"), F.col("__obv20")), "drawdown": over("close", "high_252"),
    })
    df = df.withColumns({"vol_z": s.z("volatility_20d", 60), "volume_z": s.z("volume_ratio", 60)})
    return pat.rsi_divergence(df, s).drop("__ad", "__ad3", "__ad10", "__obv20")


def with_derived(df: DataFrame, s: Series) -> DataFrame:
    """Lags, moving statistics, changes, percentile ranks and interactions, all in one projection."""
    out = {f"{f}_lag{n}": s.lag(f, n) for f in LAGGED for n in LAGS}
    out |= {f"{f}_rolling_{st}_{w}": getattr(s, st)(f, w) for f in ROLLED for st in STATS for w in WIDTHS}
    out |= {
        "rsi_change_5d": s.change("rsi_14", 5), "rsi_change_10d": s.change("rsi_14", 10), "volume_change_10d": s.pct("volume_ratio", 10),
        "atr_change_20d": s.pct("atr_14", 20), "adr_change_20d": s.pct("adr", 20), "macd_change_5d": s.change("macd_hist", 5),
        "close_percentile_252": s.rank_share("close", 252, 50), "rsi_percentile_60": s.rank_share("rsi_14", 60, 20),
        "rsi_volume_interaction": F.col("rsi_14") * F.col("volume_z"), "rsi_volatility_interaction": F.col("rsi_14") * F.col("vol_z"),
        "drawdown_panic_interaction": F.col("drawdown") * F.col("panic_severity") if "panic_severity" in df.columns else F.lit(0.0),
    }
    return df.withColumns(out)


def with_labels(df: DataFrame, s: Series, left: int = 8, right: int = 13) -> DataFrame:
    df = pat.pivots(pat.events(df, s, left, right), s, left, right, around=(-1, 1))
    return df.withColumn("PivotHigh", F.col("pivot_high").cast("tinyint")).drop("pivot_high", "pivot_low")


def min_history(df: DataFrame, rows: int = 252, key: str = "stock_id") -> DataFrame:
    """Series with at least so many bars. The count is a window by series, which the features partition by anyway."""
    return df.withColumn("__bars", F.count("*").over(Window.partitionBy(key))).where(F.col("__bars") >= rows).drop("__bars")


def build_features(df: DataFrame, min_rows: int = 252, keep_helpers: bool = False, groups: Iterable[str] | None = None) -> DataFrame:
    """Bars to the labelled feature table. Unneeded features are pruned by the final projection."""
    s = Series()
    out = with_labels(with_derived(adv.with_advanced(with_base(min_history(df, min_rows), s), s), s), s)
    return out if keep_helpers else out.select(*META, *list_features(groups), *LABELS)
