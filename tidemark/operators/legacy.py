"""The older indicator set: a normalised composite strength index, its weights, and divergences on pivot pairs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import indicators as ind
from tidemark.operators import patterns as pat
from tidemark.operators.recursive import recursive
from tidemark.operators.rolling import Series, flag

PARTS = ("rsi_n", "macd_n", "bb_n", "obv_n", "ema_n", "roc_n", "mom_n")


def normalised_parts(df: DataFrame, s: Series) -> DataFrame:
    """Seven series in about [-1, 1]. Four are divided by their largest size over all history, so they look ahead."""
    df = recursive(ind.with_obv(df, s, "__obv"), {"__rsi": ("rsi", 14), ("__m", "__ms", "__mh"): ("macd_v", 12, 26, 9), "__oe": ("ewm", {"close": "__obv"}, 8), "__e8": ("ema", 8)}, s.key, s.order)
    all_ = Window.partitionBy(s.key)
    std = s.std("close", 20)
    middle = ind.wma(s, "close", 20)
    df = df.withColumns({"__roc": ind.roc(s), "__mom": ind.momentum(s), "__bb": F.try_divide(F.col("close") - middle, 4 * std)})
    share = lambda c: F.try_divide(F.col(c), F.max(F.abs(F.col(c))).over(all_))
    out = {
        "rsi_n": (F.col("__rsi") - 50) / 50, "macd_n": share("__mh"), "bb_n": F.col("__bb"), "obv_n": share("__oe"),
        "ema_n": F.try_divide(F.col("close") - F.col("__e8"), F.col("__e8")), "roc_n": share("__roc"), "mom_n": share("__mom"),
    }
    return df.withColumns(out).drop("__obv", "__rsi", "__m", "__ms", "__mh", "__oe", "__e8", "__roc", "__mom", "__bb")


def best_weights(df: DataFrame, s: Series, rounds: int = 400, seed: int = 1) -> np.ndarray:
    """Weights in [0, 1] whose index correlates most with the next return.

    Everything the correlation needs are first and second moments of the seven parts and the next return: one
    aggregate of 44 numbers; the driver then climbs on those, without the data.
    """
    df = df.withColumn("__next", F.try_divide(s.lead("close"), F.col("close")) - 1).dropna(subset=[*PARTS, "__next"])
    names = [*PARTS, "__next"]
    row = df.agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)], *[F.covar_pop(a, b).alias(f"c{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if j >= i]).first()
    if not row["n"]:
        return np.full(len(PARTS), 1 / len(PARTS))
    c = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] for j in range(len(names))] for i in range(len(names))])
    cov, target, spread = c[:-1, :-1], c[:-1, -1], c[-1, -1]
    value = lambda w: (w @ target) / np.sqrt(max(w @ cov @ w, 1e-300) * max(spread, 1e-300))
    r = np.random.default_rng(seed)
    best = np.full(len(PARTS), 1 / len(PARTS))
    step = 0.25
    for k in range(rounds):
        tries = np.clip(best + r.normal(0, step, (32, len(PARTS))), 0, 1)
        scores = [value(w) for w in tries]
        if max(scores) > value(best):
            best = tries[int(np.argmax(scores))]
        else:
            step = max(step * 0.97, 1e-4)
    return best


def strength_index(df: DataFrame, s: Series, weights: np.ndarray | None = None) -> DataFrame:
    """strength: the weighted composite scaled to 0..100 around 50, smoothed by a 3-bar average."""
    df = normalised_parts(df, s)
    w = best_weights(df, s) if weights is None else weights
    df = df.withColumn("__x", sum((F.col(p) * float(v) for p, v in zip(PARTS, w, strict=True)), F.lit(0.0)))
    df = df.withColumn("__y", (F.col("__x") + 1) * 50)
    return recursive(df, {"strength": ("ewm", {"close": "__y"}, 3)}, s.key, s.order).drop("__x", "__y")


def pivot_divergence(df: DataFrame, s: Series, rsi: str = "rsi_14", left: int = 8, right: int = 8) -> DataFrame:
    """RSI_Divergence: a pivot low under the pivot low before it, with the RSI above. Pivots look ahead."""
    df = pat.centred_pivots(df, s, left, right)
    was = F.last(F.when(F.col("pivot_low") == 1, F.struct(F.col("close").alias("p"), F.col(rsi).alias("r"))), True).over(s.before)
    df = df.withColumn("__was", was)
    return df.withColumn("RSI_Divergence", flag((F.col("pivot_low") == 1) & (F.col("close") < F.col("__was.p")) & (F.col(rsi) > F.col("__was.r")))).drop("__was")


def weighted_bands(s: Series, c: str = "close", n: int = 20, width: float = 2.0) -> tuple:
    """(upper, middle, lower) around a linearly weighted mean, by the population deviation."""
    middle = ind.wma(s, c, n)
    spread = F.when(F.count(c).over(s.last(n)) >= n, F.stddev_pop(c).over(s.last(n))) * width
    return middle + spread, middle, middle - spread


def lagged_returns(df: DataFrame, s: Series, most: int = 8) -> DataFrame:
    """r, its lags 1 to most, and the running sum of return times volume."""
    df = df.withColumn("r", s.pct("close", 1))
    trend = F.sum(F.col("r") * F.col("volume")).over(s.so_far)
    return df.withColumns({**{f"r_lag{k}": s.lag("r", k) for k in range(1, most + 1)}, "price_volume_trend": trend})
