import datetime as dt
import os
import threading

from pyspark.sql import functions as F

from tidemark.operators import dataset as ds
from tidemark.operators import features as feat
from tidemark.operators import ml
from tidemark.plans import registry
from tidemark.plans.relational import FOLDS


def test_query_runs_the_whole_job(spark, monkeypatch):
    asked = {}

    def run(df, features, label, folds, model=ml.Baseline, embargo=14):
        asked.update(features=list(features), folds=list(folds), model=model().make())
        rows = [(name, i % 2, i / 10) for name, _, _ in folds for i in range(4)]
        return spark.createDataFrame(rows, "fold string, PivotLow int, score double"), []

    monkeypatch.setattr(ml, "run_folds", run)
    got = registry.QUERIES["walk_forward_gbt"](spark, "/root/testdata/sf0.001").collect()
    assert sorted(x.fold for x in got) == ["f1", "f2", "f3", "f4"]
    assert asked["features"] == feat.list_features() and asked["folds"] == FOLDS
    assert asked["model"].getMaxIter() == 50 and asked["model"].getMaxDepth() == 5


def test_fold_without_rows_is_passed_over(spark):
    df = spark.range(60).select(F.lit("a").alias("stock_id"), F.date_add(F.lit(dt.date(2020, 1, 1)), F.col("id").cast("int")).cast("timestamp").alias("date"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).alias("y"))
    folds = [("early", dt.datetime(2019, 1, 1), dt.datetime(2019, 6, 1)), ("late", dt.datetime(2020, 2, 1), dt.datetime(2020, 2, 28))]
    out, _ = ml.run_folds(df, ["x"], "y", folds, lambda: ml.Baseline(1, 1), embargo=1)
    assert {x.fold for x in out.collect()} == {"late"}
    out, found = ml.run_folds(df, ["x"], "y", folds[:1], embargo=1)
    assert not out.collect() and not found and {"fold", "score", "y"} <= set(out.columns)


def test_folds_get_rows_without_the_plan_that_made_them(spark, monkeypatch):
    """Else each step of each fold analyses some thousand expressions again, and each task carries them."""
    plans = []

    def run(df, features, label, folds, model=ml.Baseline, embargo=14):
        plans.append(df._jdf.queryExecution().analyzed().toString())
        rows = [(name, i % 2, i / 10) for name, _, _ in folds for i in range(4)]
        return spark.createDataFrame(rows, "fold string, PivotLow int, score double"), []

    monkeypatch.setattr(ml, "run_folds", run)
    got = registry.QUERIES["walk_forward_gbt"](spark, "/root/testdata/sf0.001")
    assert "Window" not in plans[0] and "Window" not in got._jdf.queryExecution().analyzed().toString()
    assert {x.fold: (x.roc_auc, x.avg_precision) for x in got.collect()} == {f"f{k}": (0.75, 0.833333) for k in (1, 2, 3, 4)}


def test_settled_keeps_all_rows_and_leaves_nothing(spark):
    df = spark.range(1000).withColumn("x", F.col("id") / 3).repartition(3)
    with ds.settled(df) as rows:
        path = rows.inputFiles()[0].removeprefix("file://")
        assert os.path.exists(path) and sorted(rows.collect()) == sorted(df.collect()) and rows.dtypes == df.dtypes
    assert not os.path.exists(path) and not df.storageLevel.useMemory
    with ds.settled(df.persist()):
        pass
    assert df.storageLevel.useMemory
    df.unpersist()


def test_folds_run_side_by_side(spark):
    df = spark.range(90).select(F.lit("a").alias("stock_id"), F.date_add(F.lit(dt.date(2020, 1, 1)), F.col("id").cast("int")).cast("timestamp").alias("date"), (F.col("id") % 7).cast("double").alias("x"), (F.col("id") % 2).alias("y"))
    both = threading.Barrier(2)

    class Meeting(ml.Baseline):
        def fit(self, df, features, label):
            both.wait(60)
            return super().fit(df, features, label)

    folds = [("one", dt.datetime(2020, 2, 1), dt.datetime(2020, 2, 20)), ("two", dt.datetime(2020, 2, 20), dt.datetime(2020, 3, 15))]
    out, found = ml.run_folds(df, ["x"], "y", folds, lambda: Meeting(1, 1), embargo=1, at_once=2)
    assert {x.fold: x.n for x in out.groupBy("fold").agg(F.count("*").alias("n")).collect()} == {"one": 18, "two": 23} and [f[0] for f in found] == ["one", "two"]
