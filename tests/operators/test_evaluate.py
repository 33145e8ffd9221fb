"""The evaluator on frames whose results are known by hand."""

import datetime
import math

import pytest
from pyspark.sql import functions as F

from tidemark.operators import evaluate as ev
from tidemark.operators import patterns as pat

SCHEMA = "stock_id string, date timestamp_ntz, open double, high double, low double, close double, PivotLow tinyint, PivotLow_base tinyint, PivotLow_event_id int, PivotLow_event_offset float"


def frame(spark, n=14, events=((4, 1, 1, 0.0), (5, 0, 1, 1.0), (9, 1, 2, 0.0)), price=lambda i: 100.0):
    known = {i: (base, no, off) for i, base, no, off in events}
    rows = []
    for i in range(n):
        base, no, off = known.get(i, (0, 0, None))
        p = price(i)
        rows.append(("TEST", datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i), p, p + 5, p - 5, p, int(no > 0), base, no, off))
    return spark.createDataFrame(rows, SCHEMA)


def select(df, at):
    days = [datetime.datetime(2024, 1, 1) + datetime.timedelta(days=i) for i in at]
    return df.withColumn("weight", F.col("date").isin(days).cast("double"))


def analytics(df, horizon=2):
    return ev.analytics(df, df.select("stock_id", "date", "weight"), (horizon,))[1].first()


def test_duplicates_collapse(spark):
    x = analytics(select(frame(spark), (2, 4, 5)))
    assert (x.raw_rows, x.n_rows, x.event_hits, x.exact_hits, x.duplicate_rows) == (3, 2, 1, 1, 1)
    assert (x.duplicate_mass, x.event_recall, x.exact_recall, x.zone_precision) == (1.0, 0.5, 0.5, 0.5)


def test_near_hit_is_not_exact(spark):
    x = analytics(select(frame(spark), (5,)))
    assert (x.event_hits, x.exact_hits, x.avg_offset) == (1, 0, 1.0)


def test_one_trade_an_event(spark):
    df = select(frame(spark), (4, 5)).withColumn("prediction", F.col("weight").cast("int"))
    assert ev.backtest(df).count() == 1


@pytest.mark.parametrize(("scores", "frac", "weights"), [
    ([0.1, 0.5, 0.3, 0.9, 0.2], 1.0, [1, 1, 1, 1, 1]),
    ([0.5] * 50, 0.1, [0.1] * 50),
    ([0.9, 0.8, 0.8, 0.1], 0.5, [1, 0.5, 0.5, 0]),
    ([i / 100 for i in range(100)], 0.0001, [0] * 99 + [1]),
])
def test_top_weights(spark, scores, frac, weights):
    df = spark.createDataFrame(list(enumerate(scores)), "i int, score double")
    got = {r.i: r.weight for r in ev.top_weights(df, "score", (frac,)).collect()}
    assert [got.get(i, 0) for i in range(len(scores))] == pytest.approx(weights)


def test_forward_return(spark):
    rows = ev.panel(frame(spark, 12, (), lambda i: 100.0 + i), 10).orderBy("date").collect()
    assert rows[0].exit / rows[0].entry - 1 == pytest.approx((111 - 101) / 101)
    assert all(r.ret is None for r in rows[1:])


def test_too_short_scores_nothing(spark):
    df = frame(spark, 3, ()).withColumn("score", F.rand(1))
    x = ev.multi_budget(df, "score").first()
    assert x.composite == -math.inf and x.valid_cells == 0


def test_weighted_quantile(spark):
    df = spark.createDataFrame([(1, 3.0, 1.0), (1, 1.0, 1.0), (1, 2.0, 2.0)], "g int, v double, w double")
    assert ev.weighted_quantile(df, "v", "w", 0.25, ("g",), "q").first().q == 1.0
    assert ev.weighted_quantile(df, "v", "w", 0.26, ("g",), "q").first().q == 2.0


def test_winsorising_comes_after_the_market(spark):
    jump = lambda i: 1000.0 if i == 60 else 100.0 + i % 3
    rows = ev.panel(frame(spark, 120, (), jump), 5).where("valid").collect()
    raw = [r.exit / r.entry - 1 for r in rows]
    assert max(raw) > max(r.ret for r in rows)
    assert max(r.market for r in rows) == pytest.approx(max(raw))


def test_ranking_measures(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.7), (0, 0.1)], "y int, s double")
    x = ev.classification(df, "y", score="s").first()
    assert x.roc_auc == pytest.approx(0.75) and x.avg_precision == pytest.approx((1 + 2 / 3) / 2)
    assert ev.classification(df.where("y = 1"), "y", score="s").first().roc_auc is None


def test_events_are_added_if_missing(spark):
    df = frame(spark, 40, (), lambda i: 100.0 + abs(i - 20)).drop(pat.LABEL, pat.BASE, pat.EVENT, pat.OFFSET)
    assert pat.EVENT in ev.panel(df, 5).columns
