"""Queries of dataset, universe and stream operations."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import calculator as calc
from tidemark.operators import dataset as ds
from tidemark.operators import evaluate as ev
from tidemark.operators import features as feat
from tidemark.operators import indicators as ind
from tidemark.operators import legacy
from tidemark.operators import universe as un
from tidemark.operators.rolling import Series
from tidemark.plans.registry import BARS_SQL, lag, moving, on_bars, over, pct, register
from tidemark.sources import bars as src

S = Series()
D = datetime.datetime
OHLCV = {"open": 6, "high": 6, "low": 6, "close": 6, "volume": 3}


def _dirty(b: DataFrame) -> DataFrame:
    """Bars with planted faults, by day of month: missing closes, no volume, high under low, and one penny series."""
    day = F.dayofmonth("date")
    return b.withColumns({
        "close": F.when(day == 3, None).when(F.col("stock_id") == "R-O", F.col("close") / 1999.37).otherwise(F.col("close")),
        "volume": F.when(day == 5, 0.0).otherwise(F.col("volume")), "high": F.when(day == 7, F.col("low") - 1).otherwise(F.col("high")),
        "low": F.when(F.col("stock_id") == "R-O", F.col("low") / 3999.37).otherwise(F.col("low")),
    })


DIRTY = """db AS (
  SELECT stock_id, date, open, CASE WHEN day(date) = 7 THEN low - 1 ELSE high END AS high, CASE WHEN stock_id = 'R-O' THEN low / 3999.37::DOUBLE ELSE low END AS low,
         CASE WHEN day(date) = 3 THEN NULL WHEN stock_id = 'R-O' THEN close / 1999.37::DOUBLE ELSE close END AS close, CASE WHEN day(date) = 5 THEN 0 ELSE volume END AS volume FROM bars),
gb AS (SELECT * FROM db WHERE close IS NOT NULL AND open > 0 AND high > 0 AND low > 0 AND close > 0 AND volume > 0 AND high >= greatest(open, close, low) AND low <= least(open, close))"""
on_bars("clean_ohlcv", lambda b: ds.clean_ohlcv(_dirty(b)), f", {DIRTY}\nFINAL\nSELECT * FROM gb WHERE stock_id NOT IN (SELECT stock_id FROM gb WHERE close < 1)", **OHLCV)
on_bars("penny_anti_join", lambda b: ds.clean_ohlcv(b, penny=23.0), "\nFINAL\nSELECT * FROM bars WHERE volume > 0 AND stock_id NOT IN (SELECT stock_id FROM bars WHERE close < 23)", **OHLCV)
on_bars("min_history_filter", lambda b: feat.min_history(b, 2450), "\nFINAL\nSELECT * FROM bars WHERE stock_id IN (SELECT stock_id FROM bars GROUP BY 1 HAVING count(*) >= 2450)", **OHLCV)
on_bars("missing_purge", lambda b: ds.clean_dataset(_dirty(b).withColumn("ret", F.when(F.dayofmonth("date") == 9, float("inf")).otherwise(F.col("close"))), ["ret"]), f", {DIRTY}\nFINAL\nSELECT *, close AS ret FROM db WHERE day(date) <> 9 AND close IS NOT NULL", ret=6, volume=3)
on_bars("load_filtered_projection", lambda b: ds.projected(b, ("stock_id", "date", "close"), ("A-F", "N-O"), D(1996, 1, 1)), "\nFINAL\nSELECT * FROM bars WHERE stock_id IN ('A-F', 'N-O') AND date >= TIMESTAMP '1996-01-01'", close=6)
register("quality_gate", lambda spark, d: ds.quality_gate(src.nation_bars(spark, d).withColumn("volume", F.col("volume") * 20000), F.lit(D(1998, 11, 1))), """nb AS (
  SELECT 'N' || c_nationkey AS stock_id, o_orderdate AS date, arg_max(o_totalprice, row(o_orderkey, o_totalprice)) AS close, count(*)::DOUBLE * 20000 AS volume
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
g AS (SELECT stock_id, count(*) AS n_rows, avg(close) AS avg_price, avg(volume) AS avg_volume, max(date) AS last_date, arg_max(close, date) AS last_price FROM nb GROUP BY 1)
FINAL
SELECT *, CASE WHEN n_rows < 100 THEN 'rejected' WHEN avg_price < 1 THEN 'penny' WHEN avg_volume < 50000 THEN 'illiquid' WHEN n_rows < 252 THEN 'insufficient'
  WHEN date_diff('day', last_date, TIMESTAMP '1998-11-01') > 90 THEN 'delisted' WHEN last_price < 1 AND avg_price > 5 THEN 'delisted' ELSE 'valid' END AS status FROM g""",
         {"n_rows": None, "avg_price": 4, "avg_volume": 4, "last_date": None, "last_price": 4, "status": None}, ("stock_id",))


def _tickers(spark: SparkSession, d: str) -> DataFrame:
    """Symbols from part keys: two to six letters, some with endings that the filters look for."""
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_retailprice", "p_size")
    k = F.col("p_partkey")
    letter = lambda x: F.char(65 + F.pmod(x, F.lit(26)))
    stem = F.concat(letter(F.floor(k / 40)), letter(F.floor(k / 12) * 7), F.when(k % 4 != 0, letter(k * 5)).otherwise(""))
    ends = F.array(*[F.lit(x) for x in ("", "A", "B", "$A", ".W", "W", "PRA", "-A", "-B", "-B.ST", ".B", "D", "E")])
    t = F.when(k % 97 == 0, F.concat(F.lit("SPY"), letter(k))).otherwise(F.concat(stem, ends[F.pmod(k, F.lit(13)).cast("int")]))
    return p.select(t.alias("ticker"), k.alias("pos"), (F.col("p_retailprice") * F.when(k % 3 == 0, 1e6).when(k % 3 == 1, 1e7).otherwise(2e8)).alias("market_cap"),
                    F.when(k % 5 == 0, "Sweden").otherwise("United States").alias("country"), F.col("p_size").cast("double").alias("avg_volume"), (k % 17 == 0).alias("is_failed"),
                    F.when(k % 3 == 0, "SP500").when(k % 3 == 1, "US").otherwise("Sweden").alias("market"))


TICKERS = """tk AS (
  SELECT CASE WHEN p_partkey % 97 = 0 THEN 'SPY' || chr((65 + p_partkey % 26)::INTEGER) ELSE
           chr((65 + (p_partkey // 40) % 26)::INTEGER) || chr((65 + ((p_partkey // 12) * 7) % 26)::INTEGER) || CASE WHEN p_partkey % 4 <> 0 THEN chr((65 + (p_partkey * 5) % 26)::INTEGER) ELSE '' END
           || ['', 'A', 'B', '$A', '.W', 'W', 'PRA', '-A', '-B', '-B.ST', '.B', 'D', 'E'][p_partkey % 13 + 1] END AS ticker,
         p_partkey AS pos, p_retailprice * CASE WHEN p_partkey % 3 = 0 THEN 1e6 WHEN p_partkey % 3 = 1 THEN 1e7 ELSE 2e8 END AS market_cap,
         CASE WHEN p_partkey % 5 = 0 THEN 'Sweden' ELSE 'United States' END AS country, p_size::DOUBLE AS avg_volume, p_partkey % 17 = 0 AS is_failed,
         CASE WHEN p_partkey % 3 = 0 THEN 'SP500' WHEN p_partkey % 3 = 1 THEN 'US' ELSE 'Sweden' END AS market
  FROM part)"""
EX = r"\.(ST|TO|L|AX|HK|T)$"
register("ticker_normalise", lambda spark, d: _tickers(spark, d).withColumns({"us": un.normalised(F.col("ticker")), "se": un.normalised(F.concat(F.lit("sto/"), "ticker"), "se"), "base": un.base_name(F.col("ticker")), "share_class": un.share_class(F.col("ticker"))}), TICKERS + rf"""
FINAL
SELECT *, CASE WHEN regexp_matches(ticker, '{EX}') THEN ticker ELSE replace(ticker, '.', '-') END AS us, replace(ticker, '.', '-') || '.ST' AS se,
  string_split(regexp_replace(ticker, '{EX}', ''), '-')[1] AS base, string_split(regexp_replace(ticker, '{EX}', ''), '-')[2] AS share_class FROM tk""", {"ticker": None, "us": None, "se": None, "base": None, "share_class": None}, ("pos",))  # fmt: skip
JUNK = rf"""{TICKERS},
j1 AS (SELECT * FROM tk WHERE NOT (regexp_matches(ticker, '[$+=^]|\.W|\.U') OR regexp_matches(ticker, '[WUR]$') OR length(ticker) > 6 OR regexp_matches(ticker, '({"|".join(un.PREFERRED)})$'))),
j2 AS (SELECT *, CASE WHEN length(ticker) >= 4 THEN count(*) OVER (PARTITION BY left(ticker, length(ticker) - 1), length(ticker)) ELSE 0 END AS fam FROM j1),
j3 AS (SELECT * FROM j2 WHERE NOT (fam >= 3 AND regexp_matches(ticker, '[{un.SERIES_LETTERS}]$')) AND NOT regexp_matches(ticker, '^({"|".join(un.FUNDS)})'))"""
register("symbol_junk_filter", lambda spark, d: un.without_junk(_tickers(spark, d)), f"{JUNK}\nFINAL\nSELECT * FROM j3", {"ticker": None}, ("pos",))
register("class_share_dedupe", lambda spark, d: un.without_class_a(_tickers(spark, d).where("market <> 'SP500'"), _tickers(spark, d).where("market = 'SP500'")), f"""{TICKERS},
us AS (SELECT * FROM tk WHERE market <> 'SP500' AND ticker NOT IN (SELECT ticker FROM tk WHERE market = 'SP500'))
FINAL
SELECT * FROM us WHERE NOT (length(ticker) <= 5 AND ticker LIKE '%A' AND left(ticker, length(ticker) - 1) || 'B' IN (SELECT ticker FROM us WHERE length(ticker) <= 5))""", {"ticker": None}, ("pos",))  # fmt: skip
register("share_class_cleaner", lambda spark, d: un.one_class(_tickers(spark, d)), rf"""{TICKERS},
r AS (SELECT *, row_number() OVER (PARTITION BY string_split(regexp_replace(ticker, '{EX}', ''), '-')[1] ORDER BY coalesce(string_split(regexp_replace(ticker, '{EX}', ''), '-')[2] <> 'B', TRUE), pos) AS rn FROM tk)
FINAL
SELECT * FROM r WHERE rn = 1""", {"ticker": None}, ("pos",))  # fmt: skip
register("download_list", lambda spark, d: un.download_list(_tickers(spark, d), 200), f"""{TICKERS},
r AS (SELECT *, row_number() OVER (PARTITION BY market ORDER BY length(ticker), pos) AS rn FROM tk),
f AS (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY CASE market WHEN 'SP500' THEN 0 WHEN 'US' THEN 1 ELSE 2 END, rn) AS fn FROM r WHERE market <> 'US' OR rn <= 200)
FINAL
SELECT * FROM f WHERE fn = 1""", {"ticker": None, "market": None}, ("pos",))  # fmt: skip
QUOTA = {"mega": 0.15, "large": 0.25, "mid": 0.30, "small": 0.20}
register("stratified_sample", lambda spark, d: un.stratified(_tickers(spark, d).withColumn("ticker", F.concat("ticker", F.lit("/"), F.col("pos"))), 300, dice=F.md5("ticker")), f"""{TICKERS},
t AS (SELECT * EXCLUDE (ticker), ticker || '/' || pos AS ticker, md5(ticker || '/' || pos) AS dice,
  CASE WHEN market_cap > 0 THEN CASE WHEN country = 'Sweden' THEN CASE WHEN market_cap <= 5e8 THEN 'small' WHEN market_cap <= 2e9 THEN 'mid' WHEN market_cap <= 1e10 THEN 'large' ELSE 'mega' END
    ELSE CASE WHEN market_cap <= 2e9 THEN 'small' WHEN market_cap <= 10e9 THEN 'mid' WHEN market_cap <= 200e9 THEN 'large' ELSE 'mega' END END END AS bucket FROM tk),
r AS (SELECT *, row_number() OVER (PARTITION BY bucket, is_failed ORDER BY dice, ticker) AS rn FROM t),
i AS (SELECT *, NOT is_failed AND rn <= CASE bucket WHEN 'mega' THEN 45 WHEN 'large' THEN 75 WHEN 'mid' THEN 90 WHEN 'small' THEN 60 ELSE 0 END AS inside FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY inside, is_failed ORDER BY dice, ticker) AS ro, sum(inside::INTEGER) OVER () AS n_in FROM i)
FINAL
SELECT * FROM o WHERE inside OR (NOT is_failed AND NOT inside AND ro <= 270 - n_in) OR (is_failed AND ro <= 30)""", {"bucket": None, "is_failed": None}, ("ticker",))  # fmt: skip
register("validation_reasons", lambda spark, d: un.reason_counts(spark.read.parquet(f"{d}/events.parquet").select(F.concat("event_type", F.when(F.col("event_id") % 7 == 0, ": 404 not found").when(F.col("event_id") % 7 == 1, " Timeout").when(F.col("event_id") % 7 == 2, ": possibly delisted; no timezone").otherwise("")).alias("message"))), """m AS (
  SELECT lower(event_type || CASE event_id % 7 WHEN 0 THEN ': 404 not found' WHEN 1 THEN ' Timeout' WHEN 2 THEN ': possibly delisted; no timezone' ELSE '' END) AS m FROM events)
FINAL
SELECT CASE WHEN contains(m, 'delisted') OR contains(m, 'no price data') THEN 'delisted' WHEN contains(m, 'timezone') THEN 'no_timezone' WHEN contains(m, 'rate limit') OR contains(m, '429') THEN 'rate_limited'
  WHEN contains(m, 'not found') OR contains(m, '404') THEN 'not_found' WHEN contains(m, 'timeout') THEN 'timeout' ELSE 'error_other' END AS reason, count(*) AS n FROM m GROUP BY 1""", {"n": None}, ("reason",))  # fmt: skip
register("metadata_enrichment", lambda spark, d: un.enrich(_tickers(spark, d).select("ticker", "pos"), _tickers(spark, d).where("pos % 4 = 0").groupBy("ticker").agg(F.min("country").alias("sector"), F.max("market_cap").alias("market_cap"))), f"""{TICKERS},
m AS (SELECT ticker, min(country) AS sector, max(market_cap) AS market_cap FROM tk WHERE pos % 4 = 0 GROUP BY 1)
FINAL
SELECT tk.pos, tk.ticker, coalesce(m.sector, 'Unknown') AS sector, coalesce(m.market_cap, 0) AS market_cap FROM tk LEFT JOIN m USING (ticker)""", {"ticker": None, "sector": None, "market_cap": 2}, ("pos",))  # fmt: skip

CUT = "TIMESTAMP '1997-01-01'"
_new = lambda b: b.where(F.col("date") >= F.lit(D(1997, 1, 1))).withColumn("close", F.col("close") * 2)
on_bars("upsert_keep_last", lambda b: ds.upsert(b.where(F.col("date") < F.lit(D(1997, 7, 1))), _new(b)), f"\nFINAL\nSELECT * REPLACE (CASE WHEN date >= {CUT} THEN close * 2 ELSE close END AS close) FROM bars", **OHLCV)
on_bars("merge_inherits_failed", lambda b: ds.merge_ohlcv(b.where((F.col("date") < F.lit(D(1997, 1, 1))) & (F.col("stock_id") != "N-O")).withColumn("is_failed", F.col("stock_id") == "A-F"), _new(b)), f"\nFINAL\nSELECT * REPLACE (CASE WHEN date >= {CUT} THEN close * 2 ELSE close END AS close), stock_id = 'A-F' AS is_failed FROM bars WHERE date >= {CUT} OR stock_id <> 'N-O'", close=6, is_failed=None)
register("incremental_overlap_check", lambda spark, d: ds.compare_datasets(src.lineitem_bars(spark, d), src.lineitem_bars(spark, d).where(F.col("date") >= F.lit(D(1996, 1, 1))).withColumn("close", F.when(F.dayofmonth("date") == 1, F.col("close") + 0.5).otherwise(F.col("close"))), ["open", "close"]).withColumnRenamed("column", "name"), f"""{BARS_SQL},
o AS (SELECT count(*) AS n, count(CASE WHEN day(date) = 1 THEN 1 END) AS d FROM bars WHERE date >= TIMESTAMP '1996-01-01')
FINAL
SELECT 'open' AS name, n AS n_rows, 0.0::DOUBLE AS largest, 0::BIGINT AS differ FROM o UNION ALL SELECT 'close', n, 0.5::DOUBLE, d FROM o""", {"n_rows": None, "largest": 6, "differ": None}, ("name",))  # fmt: skip
register("lost_stocks", lambda spark, d: ds.lost_keys(src.nation_bars(spark, d), src.nation_bars(spark, d).where("close > 485000 and dayofmonth(date) < 3")), """nb AS (
  SELECT 'N' || c_nationkey AS stock_id, o_orderdate AS date, arg_max(o_totalprice, row(o_orderkey, o_totalprice)) AS close FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
FINAL
SELECT DISTINCT stock_id FROM nb WHERE stock_id NOT IN (SELECT stock_id FROM nb WHERE close > 485000 AND day(date) < 3)""", {}, ("stock_id",))  # fmt: skip
register("update_range", lambda spark, d: ds.update_range(src.lineitem_bars(spark, d), F.lit(datetime.date(1999, 1, 31))), f"{BARS_SQL}\nFINAL\nSELECT (max(date)::DATE + 1)::DATE AS first_day, DATE '1999-01-24' AS last_day FROM bars", {"first_day": None, "last_day": None}, ())


def _incremental(b: DataFrame) -> DataFrame:
    build = lambda x: x.withColumn("sma_20", S.mean("close", 20)).select("stock_id", "date", "close", "sma_20")
    return ds.incremental(b, build(b.where(F.col("date") < F.lit(D(1997, 6, 1)))), build, 100)


on_bars("incremental_build", _incremental, f"close, {moving('avg', 'close', 20)} AS sma_20", close=6, sma_20=6)


def _labelled(b: DataFrame) -> DataFrame:
    from tidemark.operators import patterns as pat

    return pat.events(b, S)


def _register_labels() -> None:
    from tidemark.plans.patterns import EVENTS_SQL

    register("dataset_summary", lambda spark, d: ds.summary(_labelled(src.lineitem_bars(spark, d))), f"""{BARS_SQL}, {EVENTS_SQL}
FINAL
SELECT count(*) AS n_rows, count(DISTINCT stock_id) AS n_stocks, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS n_dates, sum("PivotLow")::BIGINT AS n_labels,
  avg("PivotLow") AS label_rate, count(DISTINCT CASE WHEN "PivotLow_event_id" > 0 THEN row(stock_id, "PivotLow_event_id") END) AS n_events FROM ev""",
             {"n_rows": None, "n_stocks": None, "first_date": None, "last_date": None, "n_dates": None, "n_labels": None, "label_rate": 8, "n_events": None}, ())
    register("label_distribution", lambda spark, d: _labelled(src.lineitem_bars(spark, d)).groupBy("stock_id", F.col("PivotLow").cast("int").alias("label")).agg(F.count("*").alias("n")), f'{BARS_SQL}, {EVENTS_SQL}\nFINAL\nSELECT stock_id, "PivotLow"::INTEGER AS label, count(*) AS n FROM ev GROUP BY ALL', {"label": None, "n": None}, ("stock_id",))


T, V = D(1995, 12, 31), D(1996, 12, 31)
SPLIT = """, ss AS (SELECT DISTINCT date, CASE WHEN date <= TIMESTAMP '1995-12-31' THEN 'train' WHEN date <= TIMESTAMP '1996-12-31' THEN 'val' ELSE 'test' END AS part FROM bars),
rk AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY date DESC) AS back FROM ss),
sp AS (SELECT b.*, part AS split FROM bars b JOIN rk USING (date) WHERE part = 'test' OR back > 14)"""
on_bars("temporal_split_embargo", lambda b: ds.temporal_split(b, T, V), f"{SPLIT}\nFINAL\nSELECT * FROM sp", split=None, close=6)
on_bars("standard_scale", lambda b: ds.scale(ds.temporal_split(b, T, V), ["close", "volume"]), f"""{SPLIT}, st AS (SELECT avg(close) AS mc, stddev_pop(close) AS sc, avg(volume) AS mv, stddev_pop(volume) AS sv FROM sp WHERE split = 'train')
FINAL
SELECT stock_id, date, split, (close - mc) / sc AS close, (volume - mv) / sv AS volume FROM sp CROSS JOIN st""", split=None, close=6, volume=6)  # fmt: skip
FOLDS = [("f1", D(1994, 6, 30), D(1994, 12, 31)), ("f2", D(1995, 6, 30), D(1995, 12, 31)), ("f3", D(1996, 6, 30), D(1996, 12, 31)), ("f4", D(1997, 6, 30), D(1997, 12, 31))]
register("walk_forward_folds", lambda spark, d: ds.walk_forward(src.lineitem_bars(spark, d), FOLDS).groupBy("fold", "split").agg(F.count("*").alias("n_rows"), F.min("date").alias("first_date"), F.max("date").alias("last_date")), f"""{BARS_SQL},
fd(fold, te, ve) AS (VALUES {', '.join(f"('{n}', TIMESTAMP '{a:%Y-%m-%d}', TIMESTAMP '{v:%Y-%m-%d}')" for n, a, v in FOLDS)}),
ss AS (SELECT DISTINCT fold, date, CASE WHEN date <= te THEN 'train' ELSE 'val' END AS split FROM bars, fd WHERE date <= ve),
rk AS (SELECT *, row_number() OVER (PARTITION BY fold, split ORDER BY date DESC) AS back FROM ss)
FINAL
SELECT fold, split, count(*) AS n_rows, min(date) AS first_date, max(date) AS last_date FROM rk JOIN bars USING (date) WHERE back > 14 GROUP BY 1, 2""", {"n_rows": None, "first_date": None, "last_date": None}, ("fold", "split"))  # fmt: skip
on_bars("adr_execution_filter", lambda b: ds.adr_filter(b, S, 2100), f""", a AS (SELECT *, {moving('avg', 'high / low', 20, 10)} AS m FROM bars), l AS (SELECT stock_id, arg_max(100 * (m - 1), date) AS last_adr FROM a WHERE m IS NOT NULL GROUP BY 1)
FINAL
SELECT * FROM bars WHERE stock_id IN (SELECT stock_id FROM l WHERE last_adr >= 2100)""", close=6)  # fmt: skip


def _filled(b: DataFrame) -> DataFrame:
    b = _dirty(b).withColumns({"filled": F.col("close"), "zero": F.col("close")})
    for how, c in (("ffill", "filled"), ("bfill", "filled"), ("zero", "zero")):
        b = calc.handle_missing(b, (c,), how, S)
    return b


on_bars("fill_forward", _filled, f""", {DIRTY}
FINAL
SELECT *, coalesce(last_value(close IGNORE NULLS) {over()}, first_value(close IGNORE NULLS) OVER (PARTITION BY stock_id ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS filled, coalesce(close, 0) AS zero FROM db""", filled=6, zero=6)  # fmt: skip
EVENT_BARS = """w AS (
  SELECT event_type AS stock_id, time_bucket(INTERVAL 1 HOUR, ts) AS date, arg_min(value, row(ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, row(ts, event_id)) AS close, count(*) AS volume
  FROM events GROUP BY ALL)
FINAL
SELECT * FROM w"""


def _stream(spark: SparkSession, d: str) -> DataFrame:
    from tidemark.streaming.bars import stream_bars

    return stream_bars(spark.read.parquet(f"{d}/events.parquet"))


register("stream_bars_tumbling", _stream, EVENT_BARS, {"open": 6, "high": 6, "low": 6, "close": 6, "volume": None})


def _sides(spark: SparkSession, d: str) -> DataFrame:
    bars = src.lineitem_bars(spark, d)
    return ds.key_sets(bars.where("close < 5000"), bars.where("close > 20000"), ("date",))


register("set_operations", _sides, f"""{BARS_SQL}, a AS (SELECT DISTINCT date FROM bars WHERE close < 5000), b AS (SELECT DISTINCT date FROM bars WHERE close > 20000)
FINAL
SELECT date, 'both' AS side FROM (SELECT * FROM a INTERSECT SELECT * FROM b) UNION ALL SELECT date, 'old' FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT date, 'new' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""", {"side": None}, ("date",))  # fmt: skip
register("importance_aggregation", lambda spark, d: ev.importances(spark.read.parquet(f"{d}/supplier.parquet").select(F.concat(F.lit("f"), F.pmod("s_suppkey", F.lit(7)).cast("string")).alias("feature"), F.pmod("s_suppkey", F.lit(4)).alias("fold"), F.abs("s_acctbal").alias("value"))), """i AS (
  SELECT 'f' || (s_suppkey % 7) AS feature, s_suppkey % 4 AS fold, sum(abs(s_acctbal)) AS v FROM supplier GROUP BY ALL),
s AS (SELECT *, v / sum(v) OVER (PARTITION BY fold) AS share FROM i),
m AS (SELECT feature, avg(share) AS mean_share, stddev_pop(share) AS std_share FROM s GROUP BY 1)
FINAL
SELECT *, (row_number() OVER (ORDER BY mean_share DESC, feature))::INTEGER AS rank, sum(mean_share) OVER (ORDER BY mean_share DESC, feature ROWS UNBOUNDED PRECEDING) AS running_share FROM m""",
         {"mean_share": 8, "std_share": 8, "rank": None, "running_share": 8}, ("feature",))
register("fold_summary", lambda spark, d: ev.fold_summary(spark.read.parquet(f"{d}/supplier.parquet").select(F.pmod("s_suppkey", F.lit(7)).alias("cell"), F.col("s_acctbal").alias("score")), ("cell",), ("score",)), "SELECT s_suppkey % 7 AS cell, avg(s_acctbal) AS score_mean, stddev_pop(s_acctbal) AS score_std FROM supplier GROUP BY 1", {"score_mean": 6, "score_std": 6}, ("cell",))
register("progress_running_best", lambda spark, d: ev.progress(spark.read.parquet(f"{d}/supplier.parquet").select(F.col("s_suppkey").alias("iter"), F.col("s_acctbal").alias("score"), F.when(F.col("s_suppkey") % 5 == 0, "crash").when(F.col("s_suppkey") % 3 == 0, "keep").otherwise("discard").alias("status"))), """r AS (
  SELECT s_suppkey AS iter, s_acctbal AS score, CASE WHEN s_suppkey % 5 = 0 THEN 'crash' WHEN s_suppkey % 3 = 0 THEN 'keep' ELSE 'discard' END AS status FROM supplier)
FINAL
SELECT *, max(CASE WHEN status = 'keep' THEN score END) OVER (ORDER BY iter ROWS UNBOUNDED PRECEDING) AS best FROM r WHERE status <> 'crash'""", {"score": 2, "status": None, "best": 2}, ("iter",))  # fmt: skip
on_bars("legacy_lags", lambda b: legacy.lagged_returns(b, S), f""", r AS (SELECT *, {pct('close', 1)} AS r FROM bars)
FINAL
SELECT *, {', '.join(f"{lag('r', k)} AS r_lag{k}" for k in range(1, 9))}, sum(r * volume) {over()} AS price_volume_trend FROM r""", **{f"r_lag{k}": 8 for k in range(1, 9)}, price_volume_trend=3)  # fmt: skip
_register_labels()
