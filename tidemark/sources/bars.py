"""Bar tables: (stock_id, date, open, high, low, close, volume), one row per series and day."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAR_COLUMNS = ("stock_id", "date", "open", "high", "low", "close", "volume")
PRICES = ("open", "high", "low", "close")


def lineitem_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of unit prices by return flag and line status. Prices are not rounded."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    px = F.col("l_extendedprice") / F.col("l_quantity")
    rows = li.select(
        F.concat("l_returnflag", F.lit("-"), "l_linestatus").alias("stock_id"), F.col("l_shipdate").alias("date"), px.alias("px"), "l_quantity",
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", px.alias("px")).alias("k"),
    )
    return rows.groupBy("stock_id", "date").agg(
        F.min_by("px", "k").alias("open"), F.max("px").alias("high"), F.min("px").alias("low"), F.max_by("px", "k").alias("close"), F.sum("l_quantity").alias("volume"),
    )


def nation_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of order totals by the customer's nation: 25 series."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    rows = orders.join(customers, orders["o_custkey"] == customers["c_custkey"])
    k = F.struct("o_orderkey", "o_totalprice")
    return rows.groupBy(F.concat(F.lit("N"), F.col("c_nationkey").cast("string")).alias("stock_id"), F.col("o_orderdate").alias("date")).agg(
        F.min_by("o_totalprice", k).alias("open"), F.max("o_totalprice").alias("high"), F.min("o_totalprice").alias("low"), F.max_by("o_totalprice", k).alias("close"), F.count("*").cast("double").alias("volume"),
    )


def clean_nan(df: DataFrame, columns: tuple[str, ...] | None = None) -> DataFrame:
    """NaN and infinities to NULL, so that no later comparison meets a NaN."""
    doubles = [f.name for f in df.schema if f.dataType.simpleString() in ("double", "float")]
    use = [c for c in doubles if columns is None or c in columns]
    bad = {c: F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), None).otherwise(F.col(c)).alias(c) for c in use}
    return df.select(*[bad.get(c, F.col(c)) for c in df.columns])


def read_ohlcv(spark: SparkSession, path: str, n_stocks: int | None = None, seed: int = 42) -> DataFrame:
    """Bars from Parquet, other columns dropped, ``ticker`` renamed; optionally a seeded choice of n stocks."""
    df = spark.read.parquet(path)
    lower = {c.lower(): c for c in df.columns}
    if "stock_id" not in lower and "ticker" in lower:
        df = df.withColumnRenamed(lower["ticker"], "stock_id")
        lower["stock_id"] = "stock_id"
    missing = [c for c in BAR_COLUMNS if c not in lower]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    df = clean_nan(df.select(*[F.col(lower[c]).alias(c) for c in BAR_COLUMNS]))
    if n_stocks is not None:
        chosen = df.select("stock_id").distinct().orderBy(F.xxhash64("stock_id", F.lit(seed)), "stock_id").limit(n_stocks)
        df = df.join(F.broadcast(chosen), "stock_id", "left_semi")  # n_stocks rows
    return df


def event_bars(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """Tumbling-window bars of an event table (event_id, ts, event_type, value); batch or stream."""
    k = F.struct("ts", "event_id")
    out = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(
        F.min_by("value", k).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", k).alias("close"), F.count("*").alias("volume"),
    )
    return out.select(F.col("event_type").alias("stock_id"), F.col("w.start").alias("date"), "open", "high", "low", "close", "volume")
