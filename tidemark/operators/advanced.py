"""Composite signals: exhaustion, panic, reversion, squeezes, calendar. ``with_advanced`` adds all of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import indicators as ind
from tidemark.operators import patterns as pat
from tidemark.operators.rolling import Series, flag

# Fixed names, in the fixed order of the feature table.
ADVANCED = (
    "multi_divergence_score", "volume_exhaustion", "exhaustion_strength", "panic_selling", "panic_severity", "support_test_count",
    "consecutive_down_days", "exhaustion_signal", "selling_acceleration", "hidden_bullish_divergence", "price_zscore", "statistical_bottom",
    "at_zscore_extreme", "bb_squeeze", "below_lower_band", "squeeze_breakdown", "day_of_week", "is_monday", "is_friday",
    "days_since_last_low", "is_month_end", "is_quarter_end",
)


def volume_exhaustion(df: DataFrame, s: Series) -> DataFrame:
    """Price down over 2 % with volume down over 10 %, against five bars before; and the product of both falls."""
    df = df.withColumns({"price_change_5d": s.pct("close", 5), "__v": s.lag("volume", 5)})
    change = F.when(F.col("__v") == 0, 0.0).otherwise(F.try_divide(F.col("volume"), F.col("__v")) - 1)
    df = df.withColumn("volume_change_5d", change)
    p, v = F.col("price_change_5d"), F.col("volume_change_5d")
    return df.withColumns({"volume_exhaustion": flag((p < -0.02) & (v < -0.10)), "exhaustion_strength": F.when((p < 0) & (v < 0), F.abs(p) * F.abs(v) * 100).otherwise(0.0)}).drop("__v")


def panic_selling(df: DataFrame, s: Series) -> DataFrame:
    """Volume over twice its mean with a fall over two deviations, and how severe (0 to 10)."""
    df = df.withColumns({"ret_1d": s.pct("close", 1), "volume_ma20": s.mean("volume", 20)})
    df = df.withColumn("volatility_20d", s.std("ret_1d", 20))
    one = lambda c: F.when(F.col(c) == 0, 1.0).otherwise(F.col(c))
    spike = F.col("volume") / one("volume_ma20")
    panic = flag((spike > 2.0) & (F.col("ret_1d") < -2 * F.col("volatility_20d")))
    severity = F.when(panic == 1, F.greatest(F.lit(0.0), F.least(F.lit(10.0), spike * F.abs(F.col("ret_1d") / one("volatility_20d"))))).otherwise(0.0)
    return df.withColumns({"volume_spike_ratio": spike, "panic_selling": panic, "panic_severity": severity})


def exhaustion_sequence(df: DataFrame, s: Series) -> DataFrame:
    """Falling bars in a row; a signal where at least four fall and the fall slows down."""
    df = df.withColumn("ret_1d", s.pct("close", 1))
    df = df.withColumns({"__down": flag(F.col("ret_1d") < 0), "ret_1d_prev": s.lag("ret_1d")})
    df = df.withColumn("__run", F.sum(1 - F.col("__down")).over(s.so_far))
    from pyspark.sql import Window

    run = Window.partitionBy(s.key, "__run").orderBy(s.order).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumns({"consecutive_down_days": F.sum("__down").over(run).cast("int"), "selling_acceleration": F.col("ret_1d") - F.col("ret_1d_prev")})
    signal = (F.col("consecutive_down_days") >= 4) & (F.col("selling_acceleration") > 0) & (F.col("ret_1d") < 0)
    return df.withColumn("exhaustion_signal", flag(signal)).drop("__down", "__run")


def mean_reversion(df: DataFrame, s: Series) -> DataFrame:
    """Deviations from the yearly mean, under -2, and within 0.2 of their yearly low."""
    mean, std = s.mean("close", 252, 100), s.std("close", 252, 100)
    df = df.withColumn("price_zscore", (F.col("close") - mean) / F.when(std == 0, 1.0).otherwise(std))
    low = s.min("price_zscore", 252, 100)
    return df.withColumns({"statistical_bottom": flag(F.col("price_zscore") < -2.0), "at_zscore_extreme": flag(F.col("price_zscore") <= low + 0.2)})


def squeeze_breakdown(df: DataFrame, s: Series) -> DataFrame:
    """Bands within 5 % of their narrowest in 20 bars, the close under the lower band, and both."""
    upper, middle, lower = ind.bollinger(s)
    df = df.withColumns({"bb_upper": upper, "bb_middle": middle, "bb_lower": lower})
    df = df.withColumn("bb_width", F.try_divide(F.col("bb_upper") - F.col("bb_lower"), F.col("bb_middle")))
    narrow = flag(F.col("bb_width") <= s.min("bb_width", 20, 10) * 1.05)
    under = flag(F.col("close") < F.col("bb_lower"))
    return df.withColumns({"bb_squeeze": narrow, "below_lower_band": under, "squeeze_breakdown": flag((narrow == 1) & (under == 1))})


def time_features(df: DataFrame, s: Series, low: str = "LocalLow") -> DataFrame:
    """Weekday (Monday 0), month and quarter ends (from the 28th on), calendar days since the last local low."""
    day = F.weekday(s.order)
    late = F.dayofmonth(s.order) >= 28
    last = F.last(F.when(F.col(low) == 1, F.col(s.order)), True).over(s.so_far)
    return df.withColumns({
        "day_of_week": day, "is_monday": flag(day == 0), "is_friday": flag(day == 4), "days_since_last_low": F.datediff(s.order, last),
        "is_month_end": flag(late), "is_quarter_end": flag(late & F.month(s.order).isin(3, 6, 9, 12)),
    })


def with_advanced(df: DataFrame, s: Series, tolerance: float = 0.02, lookback: int = 8, rsi: str = "rsi_14", macd: str = "macd", stoch: str = "stoch_k") -> DataFrame:
    """All composite signals. The frame must have the RSI, MACD and stochastic columns named."""
    df = df.withColumn("LocalLow", pat.local_low(s, "close", lookback))
    df = pat.lower_lows(df, s, (rsi, macd, stoch))
    df = volume_exhaustion(df, s)
    df = panic_selling(df, s)
    df = pat.support_tests(df, s, tolerance)
    df = exhaustion_sequence(df, s)
    df = pat.hidden_divergence(df, s, rsi)
    df = mean_reversion(df, s)
    df = squeeze_breakdown(df, s)
    return time_features(df, s)
