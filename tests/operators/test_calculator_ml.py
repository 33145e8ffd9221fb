"""The configured calculator, the older set, models and the command line."""

import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import cli
from tidemark.operators import calculator as calc
from tidemark.operators import legacy, ml
from tidemark.operators.rolling import Series
from tidemark.sources.bars import lineitem_bars

FOLDER = "/root/testdata/sf0.001"
S = Series()


@pytest.fixture(scope="module")
def one(spark):
    r = np.random.default_rng(42)
    close = 100 + np.cumsum(r.normal(0, 2, 500))
    high, low = close + r.uniform(0.5, 3, 500), close - r.uniform(0.5, 3, 500)
    pdf = pd.DataFrame({"date": pd.date_range("2023-01-01", periods=500), "open": low + (high - low) * 0.4, "high": high, "low": low, "close": close, "volume": r.uniform(1e6, 1e7, 500)})
    return spark.createDataFrame(pdf)


def test_default_names(one):
    out = calc.calculate_all(one)
    for c in ("SMA_200", "EMA_89", "VWAP", "RSI_14", "MACD_12_26", "MACD_signal_12_26", "ADX_14", "ROC_10", "MOM_10", "STOCH_K_14", "STOCH_D_14", "BBands_upper_20", "ATR_14", "ADR_20", "APZ_lower_21", "SAR", "OBV", "OBV_EMA_8", "OBV_EMA_55", "ADOSC_3_10", "PivotHigh", "PivotLow", "Hammer", "HT_SINE", "HT_LEADSINE", "HT_TRENDMODE"):
        assert c in out.columns
    assert "stock_id" not in out.columns and not [c for c in out.columns if c.startswith("__")]
    p = out.orderBy("date").toPandas()
    assert len(p) == 500 and p.RSI_14.dropna().between(0, 100).all() and p.STOCH_K_14.dropna().between(0, 100).all()
    both = p.dropna(subset=["BBands_upper_20"])
    assert (both.BBands_upper_20 >= both.BBands_middle_20).all() and (both.BBands_middle_20 >= both.BBands_lower_20).all()
    assert np.allclose(p.SMA_21, p.close.rolling(21, min_periods=1).mean())


def test_configured(one):
    own = lambda df, s: df.withColumn("gap", F.col("open") - s.lag("close"))
    c = calc.IndicatorConfig(sma_periods=[3], ema_periods=[], calculate_ht_sine=False, calculate_advanced_features=True, own=[own])
    out = calc.calculate_all(one, c)
    assert "SMA_3" in out.columns and "EMA_5" not in out.columns and "HT_SINE" not in out.columns
    assert {"gap", "multi_divergence_score", "price_zscore"} <= set(out.columns) and out.count() == 500


def test_errors(one):
    with pytest.raises(ValueError):
        calc.calculate_all(one.drop("close"))
    with pytest.raises(ValueError):
        calc.calculate_all(one, calc.IndicatorConfig(rsi_periods=[1]))
    with pytest.raises(ValueError):
        calc.handle_missing(one, ("close",), "other")


def test_missing(one):
    odd = one.withColumns({"stock_id": F.lit("A"), "x": F.when(F.dayofmonth("date") > 2, F.lit(1.0))})
    assert calc.handle_missing(odd, ("x",), "drop").count() < 500
    for how, left in (("zero", 0), ("ffill", 2), ("bfill", 0)):
        assert calc.handle_missing(odd, ("x",), how).where("x is null").count() == left


def test_strength(one):
    df = legacy.normalised_parts(one.withColumn("stock_id", F.lit("A")), S)
    p = df.toPandas()
    for c in ("rsi_n", "macd_n", "obv_n", "roc_n", "mom_n"):
        assert p[c].dropna().between(-1.0000001, 1.0000001).all()
    w = legacy.best_weights(df, S)
    nxt = p.sort_values("date").close.pct_change().shift(-1)
    q = p.sort_values("date")
    corr = lambda v: (q[list(legacy.PARTS)] @ v).corr(nxt)
    assert corr(w) >= corr(np.full(7, 1 / 7)) - 1e-9
    out = legacy.strength_index(one.withColumn("stock_id", F.lit("A")), S, w)
    assert out.where("strength is not null").count() > 400
    from tidemark.operators.recursive import recursive

    div = legacy.pivot_divergence(recursive(one.withColumn("stock_id", F.lit("A")), {"rsi_14": ("rsi", 14)}), S)
    assert {r[0] for r in div.select("RSI_Divergence").distinct().collect()} <= {0, 1}


@pytest.fixture(scope="module")
def learnable(spark):
    r = np.random.default_rng(7)
    rows = []
    for s in "AB":
        for i in range(1500):
            a, b = r.normal(size=2)
            rows.append((s, datetime.datetime(2020, 1, 1) + datetime.timedelta(days=i), float(a), float(b), float(a) * 2, int(a + 0.3 * r.normal() > 1)))
    return spark.createDataFrame(rows, "stock_id string, date timestamp_ntz, a double, b double, a2 double, y0 int").cache()


@pytest.mark.parametrize("model", [lambda: ml.Baseline(10, 3), lambda: ml.Stack(8, 10)])
def test_models_learn(learnable, model):
    folds = [("f1", datetime.datetime(2022, 7, 1), datetime.datetime(2022, 12, 1)), ("f2", datetime.datetime(2022, 12, 1), datetime.datetime(2023, 5, 1))]
    out, found = ml.run_folds(learnable, ["a", "b"], "y0", folds, model)
    from tidemark.operators.evaluate import classification, importances

    assert classification(out, "y0", score="score").first().roc_auc > 0.9
    assert out.where("score < 0 or score > 1").count() == 0 and out.select("fold").distinct().count() == 2
    table = learnable.sparkSession.createDataFrame(found, "fold string, model string, feature string, value double")
    assert importances(table).orderBy("rank").first().feature == "a"


def test_perceptron_and_correlation(learnable):
    m = ml.perceptron((4,), 60)(learnable, ["a", "b"], "y0")
    assert m.layers == [2, 4, 2] if isinstance(m.layers, list) else True
    assert ml.correlated(learnable, ["a", "b", "a2"]) == ["a2"]


def test_sequences(learnable):
    out = ml.sequences(learnable, ["a", "b"], 5)
    assert out.where("sequence is null").count() == 10
    row = out.where("stock_id = 'A'").orderBy("date").collect()
    assert row[5].sequence == [[row[i].a, row[i].b] for i in range(5)]


def test_tsv(learnable, tmp_path):
    ml.write_tsv(learnable.groupBy("y0").count(), str(tmp_path / "t"))
    assert ml.read_tsv(learnable.sparkSession, str(tmp_path / "t")).columns == ["y0", "count"]


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(cli, "local_session", lambda: spark)
    lineitem_bars(spark, FOLDER).write.parquet(str(tmp_path / "bars"))
    assert cli.main(["features", str(tmp_path / "bars"), str(tmp_path / "out")]) == 0
    made = spark.read.parquet(str(tmp_path / "out/dataset.parquet"))
    assert made.count() > 100 and dict(made.dtypes)["PivotLow"] == "tinyint"
    assert cli.main(["show", str(tmp_path / "out/dataset.parquet")]) == 0
    assert "n_rows" in capsys.readouterr().out
