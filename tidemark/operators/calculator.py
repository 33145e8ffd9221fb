"""Batch indicators by configuration: one call adds every configured column, in the order of the configuration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import advanced as adv
from tidemark.operators import indicators as ind
from tidemark.operators import patterns as pat
from tidemark.operators.recursive import recursive
from tidemark.operators.rolling import Series

OHLCV = ("open", "high", "low", "close", "volume")


class Indicator(Protocol):
    """An own indicator: adds columns to a frame of bars. Register instances in IndicatorConfig.own."""

    name: str

    def __call__(self, df: DataFrame, series: Series) -> DataFrame: ...


@dataclass
class IndicatorConfig:
    """What calculate_all adds. Defaults are the fixed default parameters."""

    sma_periods: list[int] = field(default_factory=lambda: [5, 8, 21, 50, 55, 89, 200])
    ema_periods: list[int] = field(default_factory=lambda: [5, 8, 21, 50, 55, 89])
    rsi_periods: list[int] = field(default_factory=lambda: [14])
    macd_configs: list[tuple] = field(default_factory=lambda: [(12, 26, 9)])
    adx_periods: list[int] = field(default_factory=lambda: [14])
    roc_periods: list[int] = field(default_factory=lambda: [10])
    mom_periods: list[int] = field(default_factory=lambda: [10])
    stoch_configs: list[tuple] = field(default_factory=lambda: [(14, 3, 3)])
    bbands_configs: list[tuple] = field(default_factory=lambda: [(20, 2.0, 2.0)])
    atr_periods: list[int] = field(default_factory=lambda: [14])
    adr_periods: list[int] = field(default_factory=lambda: [20])
    apz_configs: list[tuple] = field(default_factory=lambda: [(21, 2.0)])
    sar_configs: list[tuple] = field(default_factory=lambda: [(0.02, 0.2)])
    obv_ema_periods: list[int] = field(default_factory=lambda: [8, 55])
    adosc_configs: list[tuple] = field(default_factory=lambda: [(3, 10)])
    pivot_configs: list[tuple] = field(default_factory=lambda: [(8, 8)])
    calculate_vwap: bool = True
    calculate_hammer: bool = True
    calculate_ht_sine: bool = True
    calculate_ht_trendmode: bool = True
    calculate_advanced_features: bool = False
    support_tolerance: float = 0.02
    own: list[Callable[[DataFrame, Series], DataFrame]] = field(default_factory=list)


def check_columns(df: DataFrame, needed: tuple[str, ...] = OHLCV) -> None:
    missing = [c for c in needed if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def check_period(n: int, least: int = 1) -> None:
    if not isinstance(n, int) or n < least:
        raise ValueError(f"period must be an integer of at least {least}, not {n}")


def handle_missing(df: DataFrame, columns: tuple[str, ...], how: str, series: Series | None = None) -> DataFrame:
    """Missing values filled forward (ffill) or backward (bfill), dropped (drop) or set to zero (zero)."""
    s = series or Series()
    if how == "drop":
        return df.dropna(subset=list(columns))
    if how == "zero":
        return df.fillna(0.0, list(columns))
    if how == "ffill":
        return df.withColumns({c: F.last(c, True).over(s.so_far) for c in columns})
    if how == "bfill":
        from pyspark.sql import Window

        return df.withColumns({c: F.first(c, True).over(s.w.rowsBetween(0, Window.unboundedFollowing)) for c in columns})
    raise ValueError(f"unknown way: {how}")


def calculate_all(df: DataFrame, config: IndicatorConfig | None = None, key: str = "stock_id", order: str = "date") -> DataFrame:
    """df with all configured indicators. A frame without ``key`` is one series."""
    c = config or IndicatorConfig()
    check_columns(df, (*OHLCV, order))
    for n in (*c.sma_periods, *c.ema_periods, *c.adx_periods, *c.roc_periods, *c.mom_periods, *c.atr_periods, *c.adr_periods, *c.obv_ema_periods):
        check_period(n)
    for n in c.rsi_periods:
        check_period(n, 2)
    single = key not in df.columns
    if single:
        df = df.withColumn(key, F.lit("_"))
    before = df.columns
    s = Series(key, order)
    df = df.transform(ind.with_obv, s, "OBV").withColumn("__ad", ind.ad_line(s))
    loops: dict = {f"EMA_{n}": ("ema", n) for n in c.ema_periods} | {f"RSI_{n}": ("rsi", n) for n in c.rsi_periods} | {f"ADX_{n}": ("adx", n) for n in c.adx_periods}
    loops |= {(f"MACD_{a}_{b}", f"MACD_signal_{a}_{b}", f"MACD_hist_{a}_{b}"): ("macd_v", a, b, d) for a, b, d in c.macd_configs}
    loops |= {f"ATR_{n}": ("atr", n) for n in c.atr_periods} | {(f"APZ_upper_{n}", f"APZ_lower_{n}"): ("apz", n, w) for n, w in c.apz_configs}
    loops |= {"SAR": ("sar", a, m) for a, m in c.sar_configs} | {f"OBV_EMA_{n}": ("ewm", {"close": "OBV"}, n) for n in c.obv_ema_periods}
    loops |= {f"__ad{n}": ("ewm", {"close": "__ad"}, n) for pair in c.adosc_configs for n in pair}
    if c.calculate_ht_sine:
        loops[("HT_SINE", "HT_LEADSINE")] = ("ht_sine",)
    if c.calculate_ht_trendmode:
        loops["HT_TRENDMODE"] = ("ht_trendmode",)
    df = recursive(df, loops, key, order)
    flat = {f"SMA_{n}": ind.sma(s, "close", n) for n in c.sma_periods} | {f"ROC_{n}": ind.roc(s, "close", n) for n in c.roc_periods}
    flat |= {f"MOM_{n}": ind.momentum(s, "close", n) for n in c.mom_periods} | {f"ADR_{n}": ind.adr(s, n) for n in c.adr_periods}
    for n, up, down in c.bbands_configs:
        flat |= dict(zip((f"BBands_upper_{n}", f"BBands_middle_{n}", f"BBands_lower_{n}"), ind.bollinger(s, "close", n, up, down), strict=True))
    flat |= {f"ADOSC_{a}_{b}": F.col(f"__ad{a}") - F.col(f"__ad{b}") for a, b in c.adosc_configs}
    if c.calculate_hammer:
        flat["Hammer"] = ind.hammer()
    df = df.withColumns(flat)
    if c.calculate_vwap:
        df = ind.vwap(df, s, "VWAP")
    for fast, k, d in c.stoch_configs:
        df = ind.stochastic(df, s, fast, k, d, f"STOCH_K_{fast}", f"STOCH_D_{fast}")
    for left, right in c.pivot_configs:
        df = pat.pivots(df, s, left, right).withColumnsRenamed({"pivot_high": "PivotHigh", "pivot_low": "PivotLow"})
    if c.calculate_advanced_features:
        rsi, macd, stoch = f"RSI_{c.rsi_periods[0]}", "MACD_{}_{}".format(*c.macd_configs[0][:2]), f"STOCH_K_{c.stoch_configs[0][0]}"
        df = adv.with_advanced(df, s, c.support_tolerance, rsi=rsi, macd=macd, stoch=stoch)
    for own in c.own:
        df = own(df, s)
    groups = [
        [f"SMA_{n}" for n in c.sma_periods], [f"EMA_{n}" for n in c.ema_periods], ["VWAP"], [f"RSI_{n}" for n in c.rsi_periods],
        [f"MACD{x}_{a}_{b}" for a, b, _ in c.macd_configs for x in ("", "_signal", "_hist")], [f"ADX_{n}" for n in c.adx_periods],
        [f"ROC_{n}" for n in c.roc_periods], [f"MOM_{n}" for n in c.mom_periods], [f"STOCH_{x}_{f}" for f, _, _ in c.stoch_configs for x in "KD"],
        [f"BBands_{x}_{n}" for n, _, _ in c.bbands_configs for x in ("upper", "middle", "lower")], [f"ATR_{n}" for n in c.atr_periods],
        [f"ADR_{n}" for n in c.adr_periods], [f"APZ_{x}_{n}" for n, _ in c.apz_configs for x in ("upper", "lower")], ["SAR", "OBV"],
        [f"OBV_EMA_{n}" for n in c.obv_ema_periods], [f"ADOSC_{a}_{b}" for a, b in c.adosc_configs], ["PivotHigh", "PivotLow", "Hammer", "HT_SINE", "HT_LEADSINE", "HT_TRENDMODE"],
    ]
    have = [x for x in df.columns if not x.startswith("__")]
    named = [x for g in groups for x in g if x in have]
    rest = [x for x in have if x not in named and x not in before]
    return df.select(*[x for x in before if not (single and x == key)], *named, *rest)
