"""Ticker universe operations: normalising, junk filters, share classes, download lists, stratified choice."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.order import quantiles

# Exchange suffixes, suffixes of preferred shares, letters of preferred series, starts of fund symbols.
EXCHANGES = (".ST", ".TO", ".L", ".AX", ".HK", ".T")
PREFERRED = ("P", "PR", "PRA", "PRB", "PRC", "PRD", "PRE", "PRF", "PRG", "PRH", "PRI")
SERIES_LETTERS = "DEFGHIJKLMNOZ"
FUNDS = (
    "SPY", "QQQ", "IWM", "EEM", "VT", "VO", "AGG", "BND", "XL", "IWR", "IWV", "VEA", "VWO", "GLD", "SLV", "USO", "EFA", "VNQ", "TLT",
    "HYG", "LQD", "IEMG", "IEFA",
)
# Fixed cap bounds (right-closed) and quotas of the stratified choice.
CAPS = {"US": (2e9, 10e9, 200e9), "SE": (5e8, 2e9, 1e10)}
BUCKETS, QUOTAS = ("small", "mid", "large", "mega"), {"mega": 0.15, "large": 0.25, "mid": 0.30, "small": 0.20}

_EXCHANGE = "(" + "|".join(x.replace(".", r"\.") for x in EXCHANGES) + ")$"


def normalised(t: Column, source: str = "us") -> Column:
    """us: dots of share classes to hyphens unless an exchange suffix ends the symbol. se: sto/X.B to X-B.ST."""
    if source == "se":
        return F.concat(F.regexp_replace(F.regexp_replace(t, "^sto/", ""), r"\.", "-"), F.lit(".ST"))
    return F.when(t.rlike(_EXCHANGE), t).otherwise(F.regexp_replace(t, r"\.", "-"))


def base_name(t: Column) -> Column:
    return F.split(F.regexp_replace(t, _EXCHANGE, ""), "-")[0]


def share_class(t: Column) -> Column:
    return F.get(F.split(F.regexp_replace(t, _EXCHANGE, ""), "-"), F.lit(1))


def without_junk(df: DataFrame, c: str = "ticker") -> DataFrame:
    """Symbols that are no derivatives, preferred shares, series of preferred shares or funds."""
    t = F.col(c)
    junk = t.rlike(r"[$+=^]|\.W|\.U") | t.rlike("[WUR]$") | (F.length(t) > 6) | t.rlike("(" + "|".join(PREFERRED) + ")$")
    df = df.where(~junk)
    family = F.count("*").over(Window.partitionBy(F.expr(f"left({c}, length({c}) - 1)"), F.length(t)))
    df = df.withColumn("__family", F.when(F.length(t) >= 4, family).otherwise(0))
    df = df.where(~((F.col("__family") >= 3) & t.rlike(f"[{SERIES_LETTERS}]$"))).drop("__family")
    return df.where(~t.rlike("^(" + "|".join(FUNDS) + ")"))


def without_class_a(df: DataFrame, listed: DataFrame, c: str = "ticker") -> DataFrame:
    """Symbols that are not listed elsewhere; of XA and XB (five letters at most) XB stays."""
    df = df.join(listed.select(c).distinct(), c, "left_anti")
    b = df.where((F.length(c) <= 5) & F.col(c).endswith("B")).select(F.expr(f"concat(left({c}, length({c}) - 1), 'A')").alias(c))
    return df.join(b.distinct(), c, "left_anti")


def one_class(df: DataFrame, c: str = "ticker", position: str = "pos") -> DataFrame:
    """One symbol a company: class B if there is one, else the first."""
    w = Window.partitionBy(base_name(F.col(c))).orderBy(F.coalesce(share_class(F.col(c)) != "B", F.lit(True)), position)
    return df.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def reason_of(message: Column) -> Column:
    """Class of a validator's message."""
    m = F.lower(message)
    has = lambda *words: F.array_contains(F.array(*[m.contains(w) for w in words]), True)
    return (
        F.when(has("delisted", "no price data"), "delisted").when(has("timezone"), "no_timezone").when(has("rate limit", "429"), "rate_limited")
        .when(has("not found", "404"), "not_found").when(has("timeout"), "timeout").otherwise("error_other")
    )


def reason_counts(df: DataFrame, c: str = "message") -> DataFrame:
    return df.groupBy(reason_of(F.col(c)).alias("reason")).agg(F.count("*").alias("n"))


def from_lists(df: DataFrame) -> DataFrame:
    """(market, ticker, pos) from a row of a JSON file {"US": [...], "SP500": [...], ...}."""
    markets = F.map_from_arrays(F.array(*[F.lit(m) for m in df.columns]), F.array(*[F.col(m) for m in df.columns]))
    return df.select(F.explode(markets).alias("market", "tickers")).select("market", F.posexplode("tickers").alias("pos", "ticker"))


def download_list(df: DataFrame, us: int) -> DataFrame:
    """SP500, then the shortest US symbols, then Sweden; each symbol once, under its first market."""
    rank = F.row_number().over(Window.partitionBy("market").orderBy(F.length("ticker"), "pos"))
    df = df.withColumn("__r", rank).where((F.col("market") != "US") | (F.col("__r") <= us))
    order = F.when(F.col("market") == "SP500", 0).when(F.col("market") == "US", 1).otherwise(2)
    first = F.row_number().over(Window.partitionBy("ticker").orderBy(order, "__r"))
    return df.withColumn("__f", first).where("__f = 1").drop("__r", "__f")


def cap_bucket(cap: Column, market: str = "US") -> Column:
    a, b, c = CAPS[market]
    return F.when(cap.isNull() | (cap <= 0), None).when(cap <= a, BUCKETS[0]).when(cap <= b, BUCKETS[1]).when(cap <= c, BUCKETS[2]).otherwise(BUCKETS[3])


def enrich(df: DataFrame, meta: DataFrame) -> DataFrame:
    """Sector and market cap by symbol; unknown ones are "Unknown" and 0."""
    out = df.join(meta.select("ticker", "sector", "market_cap"), "ticker", "left")
    return out.withColumns({"sector": F.coalesce("sector", F.lit("Unknown")), "market_cap": F.coalesce("market_cap", F.lit(0.0))})


def stratified(df: DataFrame, total: int, seed: int = 42, failed_share: float = 0.10, dice: Column | None = None) -> DataFrame:
    """At most ``total`` symbols: quotas by cap bucket, topped up to nine tenths from the rest, and failures on top.

    df: ticker, market_cap, country, avg_volume, is_failed. Where less than half of the symbols have a market cap,
    quarters by volume take the place of cap buckets. The order inside a bucket is a hash of the symbol (or ``dice``). Buckets are
    ranked by (bucket, hash); a bucket's quota is all that is kept of it.
    """
    dice = F.xxhash64("ticker", F.lit(seed)) if dice is None else dice
    able = df.agg(F.count(F.when(~F.col("is_failed"), 1)).alias("n"), F.count(F.when(~F.col("is_failed") & (F.col("market_cap") > 0), 1)).alias("caps")).first()
    if able["caps"] > 0.5 * able["n"]:
        bucket = F.when(F.col("country") == "Sweden", cap_bucket(F.col("market_cap"), "SE")).otherwise(cap_bucket(F.col("market_cap"), "US"))
        quotas = {b: int(total * q) for b, q in QUOTAS.items()}
        top_up = int(total * 0.9)
    else:
        asked = {f"q{k}": ("avg_volume", k / 4) for k in (1, 2, 3)}
        cuts = [x or 0 for x in quantiles(df.where(~F.col("is_failed")), asked).first()]
        v = F.col("avg_volume")
        bucket = F.when(v <= cuts[0], "low").when(v <= cuts[1], "medium").when(v <= cuts[2], "high").otherwise("very_high")
        quotas, top_up = dict.fromkeys(("low", "medium", "high", "very_high"), int(total * 0.9 / 4)), 0
    df = df.withColumns({"bucket": bucket, "__d": dice})
    quota = F.lit(0)
    for b, q in quotas.items():
        quota = F.when(F.col("bucket") == b, q).otherwise(quota)
    inside = F.row_number().over(Window.partitionBy("bucket", "is_failed").orderBy("__d", "ticker"))
    df = df.withColumn("__in", F.coalesce(~F.col("is_failed") & (inside <= quota), F.lit(False)))
    n_in = df.agg(F.sum(F.col("__in").cast("int"))).first()[0] or 0
    rest = df.where(~F.col("is_failed") & ~F.col("__in")).orderBy("__d", "ticker").limit(max(0, top_up - n_in))
    failed = df.where("is_failed").orderBy("__d", "ticker").limit(int(total * failed_share))
    return df.where("__in").unionByName(rest).unionByName(failed).drop("__d", "__in")


def listed_symbols(spark: SparkSession, path: str) -> DataFrame:
    """Symbols of landed pipe-delimited listings: the first field of each line but the header and the closing line."""
    rows = spark.read.option("sep", "|").option("header", True).option("quote", "").csv(path)
    first = F.trim(F.col("`" + rows.columns[0] + "`"))
    rows = rows.select(first.alias("listed")).where("listed is not null and listed <> ''").where(~F.col("listed").startswith("File Creation Time"))
    return rows.select(normalised(F.col("listed")).alias("ticker"))


def read_tickers(spark: SparkSession, path: str, column: str = "ticker") -> DataFrame:
    """(ticker, pos) of a JSON list of symbols."""
    text = F.from_json(F.col("value"), "array<string>")
    return spark.read.text(path, wholetext=True).select(F.posexplode(text).alias("pos", column)).select(column, "pos")


def write_tickers(df: DataFrame, path: str, column: str = "ticker") -> None:
    """The distinct symbols in order as one JSON list; a universe of symbols is small enough for one line."""
    one = df.select(column).distinct().agg(F.to_json(F.sort_array(F.collect_list(column))).alias("value"))
    one.coalesce(1).write.mode("overwrite").text(path)


def latest_dated(names: list[str], start: str, without: tuple[str, ...] = ()) -> str | None:
    """Of names like tickers_20240131.json that begin with ``start``, the one with the latest date of eight digits."""
    able = [n for n in names if n.startswith(start) and not n.startswith(without or ("\0",))]
    dated = [(int(m.group(1)) if (m := re.search(r"(\d{8})", n)) else 0, n) for n in able]
    return max(dated)[1] if dated else None
