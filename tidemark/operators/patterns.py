"""Turning points, divergences and events, as window expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.rolling import Series, flag

LABEL, BASE, EVENT, OFFSET = "PivotLow", "PivotLow_base", "PivotLow_event_id", "PivotLow_event_offset"


def pivot(s: Series, c: Column | str = "close", left: int = 8, right: int = 13, low: bool = True) -> Column:
    """Strictly below (above) all ``left`` bars before and all ``right`` bars after, with both windows full."""
    x = F.col(c) if isinstance(c, str) else c
    back, ahead = s.w.rowsBetween(-left, -1), s.w.rowsBetween(1, right)
    best = F.min if low else F.max
    beats = (x < best(x).over(back)) & (x < best(x).over(ahead)) if low else (x > best(x).over(back)) & (x > best(x).over(ahead))
    return flag(beats & (s.number() > left) & (F.count(F.lit(1)).over(ahead) == right))


def pivots(df: DataFrame, s: Series, left: int = 8, right: int = 13, use_close: bool = True, around: tuple[int, ...] = (), tolerance: float = 0.01, values: bool = False) -> DataFrame:
    """df with pivot_high and pivot_low. around: offsets of bars that join a pivot if within the tolerance of it."""
    high, low = ("close", "close") if use_close else ("high", "low")
    df = df.withColumns({"__bh": pivot(s, high, left, right, low=False), "__bl": pivot(s, low, left, right)})
    out = {}
    for name, base, c in (("pivot_high", "__bh", high), ("pivot_low", "__bl", low)):
        hit = F.col(base) == 1
        for k in around:  # a bar is at offset k of the bar that stands k before it
            at = (lambda x, k=k: s.lag(x, k) if k > 0 else s.lead(x, -k))
            hit = hit | F.coalesce((at(base) == 1) & (F.abs(F.col(c) - at(c)) / at(c) <= tolerance), F.lit(False))
        out[name] = F.when(hit, F.col(c)) if values else flag(hit)
    return df.withColumns(out).drop("__bh", "__bl")


def local_low(s: Series, c: str = "close", n: int = 8) -> Column:
    """Not above any of the last n bars; equal values count."""
    return flag((F.col(c) == F.min(c).over(s.last(n))) & (s.number() >= n))


def local_high(s: Series, c: str = "close", n: int = 8) -> Column:
    return flag((F.col(c) == F.max(c).over(s.last(n))) & (s.number() >= n))


def rsi_divergence(df: DataFrame, s: Series, rsi: str = "rsi_14", price: str = "close", n: int = 5, most: int = 60, least: int = 5) -> DataFrame:
    """Price and RSI against the latest extreme between ``most`` and ``least`` bars back, for lows and for highs."""
    df = df.withColumns({"__low": local_low(s, price, n), "__high": local_high(s, price, n)})
    frame = s.w.rowsBetween(-most, -least)
    was = lambda mark: F.last(F.when(F.col(mark) == 1, F.struct(F.col(price).alias("p"), F.col(rsi).alias("r"))), True).over(frame)
    df = df.withColumns({"__pl": was("__low"), "__ph": was("__high")})
    bull = (F.col("__low") == 1) & (F.col(price) < F.col("__pl.p")) & (F.col(rsi) > F.col("__pl.r"))
    bear = (F.col("__high") == 1) & (F.col(price) > F.col("__ph.p")) & (F.col(rsi) < F.col("__ph.r"))
    power = lambda side: (F.abs(F.col(f"{side}.p") - F.col(price)) / F.col(f"{side}.p") + F.abs(F.col(rsi) - F.col(f"{side}.r")) / 100) / 2
    out = {
        "rsi_bullish_div": flag(bull), "rsi_bearish_div": flag(bear),
        "rsi_div_strength": F.when(bear, power("__ph")).when(bull, power("__pl")).otherwise(0.0),
    }
    return df.withColumns(out).drop("__low", "__high", "__pl", "__ph")


def lower_lows(df: DataFrame, s: Series, indicators: tuple[str, ...], low: str = "LocalLow") -> DataFrame:
    """multi_divergence_score: at a low under the low before it, how many indicators stand higher than there."""
    there = F.struct(F.col("close").alias("p"), *[F.col(c).alias(f"i{k}") for k, c in enumerate(indicators)])
    df = df.withColumn("__was", F.last(F.when(F.col(low) == 1, there), True).over(s.before))
    score = sum((flag(F.col(c) > F.col(f"__was.i{k}")) for k, c in enumerate(indicators)), F.lit(0))
    return df.withColumn("multi_divergence_score", F.when((F.col(low) == 1) & (F.col("close") < F.col("__was.p")), score).otherwise(0)).drop("__was")


def hidden_divergence(df: DataFrame, s: Series, rsi: str = "rsi_14", low: str = "LocalLow") -> DataFrame:
    """A low over the low before it, with the RSI under its own."""
    df = df.withColumn("__was", F.last(F.when(F.col(low) == 1, F.struct(F.col("close").alias("p"), F.col(rsi).alias("r"))), True).over(s.before))
    hit = (F.col(low) == 1) & (F.col("close") > F.col("__was.p")) & (F.col(rsi) < F.col("__was.r"))
    return df.withColumn("hidden_bullish_divergence", flag(hit)).drop("__was")


def support_tests(df: DataFrame, s: Series, tolerance: float = 0.02, low: str = "LocalLow") -> DataFrame:
    """How many earlier lows lie within the tolerance of the close."""
    df = df.withColumn("__lows", F.collect_list(F.when(F.col(low) == 1, F.col("close"))).over(s.before))
    near = F.filter("__lows", lambda p: F.abs(p - F.col("close")) / F.col("close") < tolerance)
    return df.withColumn("support_test_count", F.size(near)).drop("__lows")


def events(df: DataFrame, s: Series, left: int = 8, right: int = 13, around: tuple[int, ...] = (-1, 1), tolerance: float = 0.01) -> DataFrame:
    """Pivot lows with the event each bar belongs to: label, base flag, event number in its series, offset (NULL off events).

    A bar near several pivots goes to the nearest; of equally near ones to the lower close; then to the earlier.
    """
    df = df.withColumn(BASE, pivot(s, "close", left, right))
    df = df.withColumn("__no", F.when(F.col(BASE) == 1, F.sum(BASE).over(s.so_far)))
    offers = [F.when(F.col(BASE) == 1, F.struct(F.lit(0).alias("far"), F.col("close").alias("p"), F.lit(0).alias("back"), F.col("__no").alias("no"), F.lit(0).alias("at")))]
    for k in around:
        at = (lambda x, k=k: s.lag(x, k) if k > 0 else s.lead(x, -k))
        near = (at(BASE) == 1) & (F.abs(F.col("close") - at("close")) / at("close") <= tolerance)
        offers.append(F.when(near, F.struct(F.lit(abs(k)).alias("far"), at("close").alias("p"), F.lit(-k).alias("back"), at("__no").alias("no"), F.lit(k).alias("at"))))
    names = [f"__e{i}" for i in range(len(offers))]
    df = df.withColumns(dict(zip(names, offers, strict=True)))
    best = F.array_min(F.filter(F.array(*names), lambda x: x.isNotNull()))
    df = df.withColumn("__best", best)
    out = {
        LABEL: flag(F.col("__best").isNotNull()).cast("tinyint"), BASE: F.col(BASE).cast("tinyint"),
        EVENT: F.coalesce(F.col("__best.no"), F.lit(0)).cast("int"), OFFSET: F.col("__best.at").cast("float"),
    }
    return df.withColumns(out).drop("__no", "__best", *names)


def ensure_events(df: DataFrame, s: Series, **params) -> DataFrame:
    """Adds the event columns that are missing, and leaves those that are there."""
    missing = [c for c in (LABEL, BASE, EVENT, OFFSET) if c not in df.columns]
    if not missing:
        return df
    have = {c: F.col(f"__own_{c}") for c in (LABEL, BASE, EVENT, OFFSET) if c in df.columns}
    kept = df.withColumns({f"__own_{c}": F.col(c) for c in have})
    return events(kept, s, **params).withColumns(have).drop(*[f"__own_{c}" for c in have])


def centred_pivots(df: DataFrame, s: Series, left: int = 8, right: int = 8) -> DataFrame:
    """The older rule: the bar in the middle of a full window equals its extreme; ties count; highs and lows."""
    size = left + right + 1
    back = size // 2
    frame = s.w.rowsBetween(-back, size - 1 - back)
    full = F.count(F.lit(1)).over(frame) == size
    return df.withColumns({"pivot_high": flag(full & (F.col("high") == F.max("high").over(frame))), "pivot_low": flag(full & (F.col("low") == F.min("low").over(frame)))})
