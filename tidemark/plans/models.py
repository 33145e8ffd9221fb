"""Queries of the configured calculator, the older indicator set and models."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators import features as feat
from tidemark.operators import legacy
from tidemark.operators import patterns as pat
from tidemark.operators.dataset import clean_dataset, settled
from tidemark.operators.recursive import recursive
from tidemark.operators.rolling import Series
from tidemark.plans.patterns import PAST, prev
from tidemark.plans.recurrences import RSI_SQL
from tidemark.plans.registry import lag, on_bars, over, pct, register
from tidemark.plans.relational import FOLDS
from tidemark.sources.bars import lineitem_bars

S = Series()
on_bars("strength_index", lambda b: legacy.strength_index(b, S), None, strength=6)
MID = f"count(*) {over(back=-8, ahead=8)} = 17"
on_bars("legacy_pivot_divergence", lambda b: legacy.pivot_divergence(recursive(b, {"rsi_14": ("rsi", 14)}), S), f""", {RSI_SQL},
x AS (SELECT *, CASE WHEN {MID} AND low = min(low) {over(back=-8, ahead=8)} THEN 1 ELSE 0 END AS ll FROM rs),
y AS (SELECT *, {prev('close', 'll', PAST)} AS lp, nullif({prev('coalesce(rsi_14, -1)', 'll', PAST)}, -1) AS lr FROM x)
FINAL
SELECT *, CASE WHEN ll = 1 AND close < lp AND rsi_14 > lr THEN 1 ELSE 0 END AS "RSI_Divergence" FROM y""", RSI_Divergence=None)  # fmt: skip


def _sequences(b: DataFrame) -> DataFrame:
    from tidemark.operators.ml import sequences

    b = sequences(b.withColumn("r", S.pct("close", 1)), ["close", "volume"], 5)
    return b.withColumns({"oldest": F.col("sequence")[0][0], "newest_volume": F.col("sequence")[4][1]})


NUM = "row_number() OVER (PARTITION BY stock_id ORDER BY date)"
on_bars("sequence_windows", _sequences, f"CASE WHEN {NUM} > 5 THEN {lag('close', 5)} END AS oldest, CASE WHEN {NUM} > 5 THEN {lag('volume', 1)} END AS newest_volume", oldest=6, newest_volume=3)


def _walk_forward(spark, d: str) -> DataFrame:
    """Out-of-sample scores of the weighted baseline on the feature table, fold by fold, with their ranking measures."""
    from tidemark.operators.evaluate import classification
    from tidemark.operators.ml import Baseline, run_folds

    features = feat.list_features()
    with settled(clean_dataset(feat.build_features(lineitem_bars(spark, d)), features).select("stock_id", "date", "PivotLow", *features)) as rows:
        out, _ = run_folds(rows, features, "PivotLow", FOLDS, Baseline)
        with settled(out.select("fold", "PivotLow", "score")) as scores:
            parts = [classification(scores.where(F.col("fold") == name), "PivotLow", score="score").withColumn("fold", F.lit(name)) for name, _, _ in FOLDS]
            per = reduce(DataFrame.unionByName, parts).collect()  # a row a fold
    return spark.createDataFrame(per, parts[0].schema).coalesce(1)


register("walk_forward_gbt", _walk_forward, None, {"roc_auc": 6, "avg_precision": 6}, ("fold",))
on_bars("returns_by_market", lambda b: b.withColumn("r", S.pct("close", 1)).withColumn("excess", F.col("r") - F.avg("r").over(_day())), f""", r AS (SELECT *, {pct('close', 1)} AS r FROM bars)
FINAL
SELECT *, r - avg(r) OVER (PARTITION BY date) AS excess FROM r""", excess=7)  # fmt: skip


def _day():
    from pyspark.sql import Window

    return Window.partitionBy("date")
