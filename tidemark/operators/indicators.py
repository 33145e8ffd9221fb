"""Indicators that need no recurrence, as columns: each is a function of a Series (and column names)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.operators.rolling import Series, col, flag


def sma(s: Series, c="close", n: int = 50) -> Column:
    """Moving mean from the first bar on."""
    return s.mean(c, n, least=1)


def wma(s: Series, c="close", n: int = 20) -> Column:
    """Linearly weighted moving mean, the newest bar with weight n."""
    total = sum((s.lag(c, n - k) if k < n else col(c)) * k for k in range(1, n + 1))
    return total / (n * (n + 1) / 2)


def typical_price() -> Column:
    return (F.col("high") + F.col("low") + F.col("close")) / 3


def vwap(df: DataFrame, s: Series, out: str = "vwap") -> DataFrame:
    """Cumulative volume-weighted price, carried over bars before which nothing was traded."""
    raw = F.try_divide(F.sum(typical_price() * F.col("volume")).over(s.so_far), F.sum("volume").over(s.so_far))
    return df.withColumn("__v", raw).withColumn(out, F.last("__v", True).over(s.so_far)).drop("__v")


def roc(s: Series, c="close", n: int = 10) -> Column:
    return F.try_divide(s.change(c, n), s.lag(c, n)) * 100


def momentum(s: Series, c="close", n: int = 10) -> Column:
    return s.change(c, n)


def stochastic(df: DataFrame, s: Series, fast: int = 14, slow_k: int = 3, slow_d: int = 3, k: str = "stoch_k", d: str = "stoch_d") -> DataFrame:
    """Close in the range of the last bars, smoothed twice; 50 where the range is empty."""
    low, high = F.min("low").over(s.last(fast)), F.max("high").over(s.last(fast))
    raw = F.when(high == low, 50.0).otherwise(F.try_divide(F.col("close") - low, high - low) * 100)
    df = df.withColumn("__fast", F.when(s.number() >= fast, raw))
    df = df.withColumn(k, s.mean("__fast", slow_k, least=1))
    return df.withColumn(d, s.mean(k, slow_d, least=1)).drop("__fast")


def bollinger(s: Series, c="close", n: int = 20, up: float = 2.0, down: float = 2.0, middle: Column | None = None) -> tuple[Column, Column, Column]:
    """(upper, middle, lower). middle: another centre line, such as an exponential average column."""
    middle = s.mean(c, n) if middle is None else middle
    std = s.std(c, n)
    return middle + std * up, middle, middle - std * down


def adr(s: Series, n: int = 20) -> Column:
    """Average daily range in percent, rounded half to even to two places."""
    return F.bround(100 * (s.mean(F.try_divide(F.col("high"), F.col("low")), n) - 1), 2)


def true_range(s: Series) -> Column:
    before = s.lag("close")
    return F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))


def obv(s: Series) -> Column:
    """Signed volume summed from the first bar's volume on."""
    before = s.lag("close")
    return F.when(before.isNull(), F.col("volume")).when(F.col("close") > before, F.col("volume")).when(F.col("close") < before, -F.col("volume")).otherwise(0.0)


def with_obv(df: DataFrame, s: Series, out: str = "obv") -> DataFrame:
    return df.withColumn("__o", obv(s)).withColumn(out, F.sum("__o").over(s.so_far)).drop("__o")


def ad_line(s: Series) -> Column:
    """Accumulation/distribution: volume times the close's place in the bar, summed."""
    place = F.when(F.col("high") == F.col("low"), 0.0).otherwise(F.try_divide(2 * F.col("close") - F.col("low") - F.col("high"), F.col("high") - F.col("low")))
    return F.sum(place * F.col("volume")).over(s.so_far)


def hammer() -> Column:
    """100 where the lower shadow is at least two bodies, the upper at most a tenth and the body at most 0.3 of the bar."""
    span = F.col("high") - F.col("low")
    body = F.abs(F.col("close") - F.col("open"))
    lower = F.least("open", "close") - F.col("low")
    upper = F.col("high") - F.greatest("open", "close")
    return flag((span > 0) & (lower >= 2 * body) & (upper <= 0.1 * span) & (body <= 0.3 * span)) * 100


def custom(df: DataFrame, s: Series) -> tuple[DataFrame, list[str]]:
    """Six extra features, and their names: the shape of a feature hook."""
    df = df.withColumns({"__r": s.pct("close", 1)})
    df = df.withColumn("__r1", s.lag("__r"))
    n, w20, w10 = F.count("__r").over(s.last(20)), s.last(20), s.last(10)
    pairs = F.count(F.when(F.col("__r").isNotNull() & F.col("__r1").isNotNull(), 1)).over(w10)
    skew = F.skewness("__r").over(w20) * F.sqrt(n * (n - 1)) / (n - 2)
    kurt = (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis("__r").over(w20) + 6)
    tiny = 1e-10

    def total(c: Column | str, size: int) -> Column:
        return F.when(F.count(c).over(s.last(size)) >= size, F.sum(c).over(s.last(size)))

    df = df.withColumn("__s5", total("__r", 5))
    out = df.withColumns({
        "price_efficiency_10": F.abs(total("__r", 10)) / (total(F.abs("__r"), 10) + tiny),
        "return_accel_10": F.col("__s5") - s.lag("__s5", 5),
        "returns_skew_20": F.when(n >= 15, skew), "returns_kurtosis_20": F.when(n >= 15, kurt),
        "volume_climax_ratio": s.max("volume", 5) / (s.mean("volume", 20, 10) + tiny),
        "return_autocorr_10": F.when(pairs >= 8, F.corr("__r", "__r1").over(w10)),
    })
    return out.drop("__r", "__r1", "__s5"), ["price_efficiency_10", "return_accel_10", "returns_skew_20", "returns_kurtosis_20", "volume_climax_ratio", "return_autocorr_10"]
