"""Loading, cleaning, splitting, scaling, upserting, saving."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from tidemark.operators import dataset as ds
from tidemark.operators import features as feat
from tidemark.operators import universe as un
from tidemark.sources import bars as src

D = datetime.datetime


@pytest.fixture
def table(spark):
    rows = [("S1", D(2024, 1, d), 1.0, 2.0, 0.5, 1.5, 100.0, float(d), 2.0 * d, 1 if d == 2 else 0, 1 if d == 2 else 0, 1 if d == 2 else 0, 0.0 if d == 2 else None) for d in (1, 2, 3)]
    return spark.createDataFrame(rows, "stock_id string, date timestamp_ntz, open double, high double, low double, close double, volume double, feat_a double, feat_b double, PivotLow int, PivotLow_base int, PivotLow_event_id int, PivotLow_event_offset double")


def test_load(spark, table, tmp_path):
    table.write.parquet(str(tmp_path / "d"))
    df, names, unknown = ds.load_dataset(spark, str(tmp_path / "d"))
    assert names == ["feat_a", "feat_b"] and df.count() == 3 and unknown == {"features": [], "stocks": []}
    df, names, unknown = ds.load_dataset(spark, str(tmp_path / "d"), ["S1", "S9"], ["feat_a", "nope"])
    assert names == ["feat_a"] and unknown == {"features": ["nope"], "stocks": ["S9"]}
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "feat_b" not in plan and "PushedFilters: [" in plan


def test_missing_values_go(spark, table):
    odd = table.withColumn("feat_a", F.when(F.dayofmonth("date") == 1, float("inf")).when(F.dayofmonth("date") == 2, float("nan")).otherwise(F.col("feat_a")))
    assert ds.clean_dataset(odd, ["feat_a"]).count() == 1


def test_validation(table):
    assert ds.validate_final(table, ["feat_a", "feat_b"]) == []
    assert any("label among" in x for x in ds.validate_final(table, ["feat_a", "PivotLow_base"]))
    assert "labels are all alike" in ds.validate_final(table.withColumn("PivotLow", F.lit(1)), ["feat_a"])
    assert any("null values" in x for x in ds.validate_final(table.withColumn("feat_a", F.lit(None).cast("double")), ["feat_a"]))
    assert any("offsets" in x for x in ds.validate_final(table.withColumn("PivotLow_event_offset", F.lit(0.0)), ["feat_a"]))


def test_split_leaves_a_gap_and_scaling_fits_train(spark):
    rows = [(s, D(2020, 1, 1) + datetime.timedelta(days=i), float(i * k)) for i in range(200) for s, k in (("A", 1), ("B", 3))]
    df = spark.createDataFrame(rows, "stock_id string, date timestamp_ntz, x double")
    out = ds.temporal_split(df, D(2020, 3, 31), D(2020, 5, 31))
    ends = {r.split: (r.a, r.b) for r in out.groupBy("split").agg(F.min("date").alias("a"), F.max("date").alias("b")).collect()}
    assert ends["train"][1] == D(2020, 3, 31) - datetime.timedelta(days=14) and ends["val"][0] == D(2020, 4, 1)
    assert ends["val"][1] == D(2020, 5, 31) - datetime.timedelta(days=14) and ends["test"][0] == D(2020, 6, 1)
    m = ds.scale(out, ["x"]).where("split = 'train'").agg(F.avg("x"), F.stddev_pop("x")).first()
    assert m[0] == pytest.approx(0, abs=1e-9) and m[1] == pytest.approx(1)
    assert {r.x for r in ds.scale(out.withColumn("x", F.lit(5.0)), ["x"]).collect()} == {0.0}


def test_upsert(spark):
    old = spark.createDataFrame([("A", 1, 1.0), ("A", 2, 2.0)], "stock_id string, date int, x double")
    new = spark.createDataFrame([("A", 2, 9.0, 1), ("B", 1, 3.0, 1)], "stock_id string, date int, x double, y int")
    assert sorted((r.stock_id, r.date, r.x, r.y) for r in ds.upsert(old, new).collect()) == [("A", 1, 1.0, None), ("A", 2, 9.0, 1), ("B", 1, 3.0, 1)]


def test_save_and_find(spark, table, tmp_path):
    for day in ("20240101", "20240301", "notes"):
        ds.save_dataset(table, str(tmp_path / day), ["feat_a"], by_year=day == "20240301")
    found = ds.dated_folders(spark, str(tmp_path), "dataset.parquet")
    assert [f[-8:] for f in found] == ["20240301", "20240101"]
    ds.write_json(spark, f"{found[0]}/metadata.json", ds.read_json(spark, f"{found[0]}/metadata.json") | {"source": "bars"})
    ds.save_dataset(table, found[0], ["feat_a"])
    whole = ds.read_json(spark, f"{found[0]}/metadata.json")
    meta = whole["features"]
    assert whole["source"] == "bars" and meta["features"] == ["feat_a"] and meta["n_rows"] == 3 and meta["n_events"] == 1
    narrow = dict(ds.optimize_types(table.withColumn("flag", F.lit(1.0)), ["open", "high", "low", "close", "volume"]).dtypes)
    assert narrow["flag"] == "tinyint" and narrow["feat_a"] == "float" and narrow["close"] == "double"


def test_catalog():
    assert {g: len(v) for g, v in feat.CATALOG.items()} == {"base": 55, "advanced": 22, "lag": 75, "rolling": 64, "roc": 6, "percentile": 2, "interaction": 3}
    assert len(feat.list_features()) == 227 and feat.list_features(["nope", "percentile"]) == ["close_percentile_252", "rsi_percentile_60"]


def test_features_do_not_leak_between_series(spark):
    bars = src.lineitem_bars(spark, "/root/testdata/sf0.001")
    one, all_ = (feat.build_features(b, 252).where("stock_id = 'A-F'").orderBy("date").toPandas() for b in (bars.where("stock_id = 'A-F'"), bars))
    import pandas as pd

    pd.testing.assert_frame_equal(one, all_, rtol=1e-9)
    assert list(one.columns) == [*feat.META, *feat.list_features(), *feat.LABELS]


def test_read_ohlcv(spark, tmp_path):
    df = spark.createDataFrame([(f"T{i % 5}", D(2024, 1, 1 + i), 1.0, float("nan"), 1.0, 1.0, 5.0, "x") for i in range(20)], "Ticker string, Date timestamp_ntz, Open double, High double, Low double, Close double, Volume double, extra string")
    df.write.parquet(str(tmp_path / "o"))
    got = src.read_ohlcv(spark, str(tmp_path / "o"), 2)
    assert got.columns == list(src.BAR_COLUMNS) and got.select("stock_id").distinct().count() == 2 and got.where("high is not null").count() == 0
    with pytest.raises(ValueError):
        src.read_ohlcv(spark, "/root/testdata/sf0.001/region.parquet")


def test_ticker_lists(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"US": ["BRK.A", "BRK.B", "AAPL"], "SP500": ["AAPL"], "Sweden": ["ERIC-B.ST"]}, indent=1))
    rows = un.from_lists(spark.read.json(str(tmp_path / "t.json"), multiLine=True))
    assert rows.count() == 5
    us = rows.where("market = 'US'").withColumn("ticker", un.normalised(F.col("ticker")))
    assert sorted(r.ticker for r in un.one_class(us).collect()) == ["AAPL", "BRK-B"]
    assert {r.ticker: r.market for r in un.download_list(rows, 1).collect()} == {"AAPL": "SP500", "ERIC-B.ST": "Sweden"}


def test_stratified_by_volume_without_caps(spark):
    rows = [(f"T{i}", 0.0, "US", float(i), i >= 90) for i in range(100)]
    df = spark.createDataFrame(rows, "ticker string, market_cap double, country string, avg_volume double, is_failed boolean")
    got = un.stratified(df, 40)
    assert got.where("is_failed").count() == 4 and {r["count"] for r in got.where("not is_failed").groupBy("bucket").count().collect()} == {9}


def test_bars_with_their_files(spark, table, tmp_path):
    ds.save_ohlcv(table, str(tmp_path / "o"), {"kept": 1})
    assert ds.read_json(spark, str(tmp_path / "o" / "all_tickers.json")) == sorted({r.stock_id for r in table.collect()})
    assert ds.read_json(spark, str(tmp_path / "o" / "selection_stats.json")) == {"kept": 1} and ds.read_json(spark, str(tmp_path / "none.json")) == {}


def test_landed_listings_and_dated_lists(spark, tmp_path):
    from tidemark.operators import universe as un

    (tmp_path / "listed.txt").write_text("Symbol|Security Name|Test Issue\nABC|A b c|N\nBRK.B|\"Quoted|N\n XYZ |x|Y\nFile Creation Time: 0101202400:00||\n")
    got = un.listed_symbols(spark, str(tmp_path / "listed.txt"))
    assert [r.ticker for r in got.collect()] == ["ABC", "BRK-B", "XYZ"]
    un.write_tickers(got.unionByName(got), str(tmp_path / "list.json"))
    assert [(r.ticker, r.pos) for r in un.read_tickers(spark, str(tmp_path / "list.json")).collect()] == [("ABC", 0), ("BRK-B", 1), ("XYZ", 2)]
    names = ["tickers_20240101.json", "tickers_20240301.json", "tickers_filtered_20250101.json", "notes.txt"]
    assert un.latest_dated(names, "tickers_", ("tickers_filtered_", "tickers_validated_")) == "tickers_20240301.json"
    assert un.latest_dated(names, "tickers_filtered_") == "tickers_filtered_20250101.json" and un.latest_dated([], "x") is None


def test_quantiles_and_running_sums(spark):
    import numpy as np

    from tidemark.operators.order import quantiles, running

    r = np.random.default_rng(0)
    x = np.concatenate([r.normal(size=700), np.zeros(300)])
    df = spark.createDataFrame([(float(v), None if i % 3 else float(v) * 2, None) for i, v in enumerate(x)], "a double, b double, c double")
    got = quantiles(df, {"p1": ("a", 0.01), "p50": ("a", 0.5), "b90": ("b", 0.9), "b100": ("b", 1.0), "none": ("c", 0.5)}).first()
    want = [np.quantile(x, 0.01), np.quantile(x, 0.5), np.quantile(x[::3] * 2, 0.9), (x[::3] * 2).max()]
    assert np.allclose(got[:4], want) and got[4] is None
    per = df.groupBy("a").agg(F.count("*").alias("n"))
    rows = sorted(((v.a, v.upto) for v in running(per, "a", {"upto": "n"}).collect()))
    assert all(u == (x >= a).sum() for a, u in rows) and len(rows) == len(set(x))
