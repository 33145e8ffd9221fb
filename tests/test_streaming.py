"""Streams give what the batch gives."""

import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.operators.recursive import recursive
from tidemark.sources.bars import event_bars, lineitem_bars
from tidemark.streaming import bars as st

FOLDER = "/root/testdata/sf0.001"


def drain(df, tmp_path, mode="append"):
    name = f"t{abs(hash(str(tmp_path))) % 10**8}"
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name)


@pytest.fixture
def landed(spark, tmp_path):
    events = spark.read.parquet(f"{FOLDER}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    return events, spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_bars(landed, tmp_path):
    events, stream = landed
    got = drain(st.stream_bars(stream, late="400 days"), tmp_path, "complete")
    want = event_bars(events)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_dedup(landed, tmp_path):
    events, stream = landed
    got = drain(st.once_per_key(stream.union(stream), late="400 days"), tmp_path)
    assert got.count() == events.select("event_id").distinct().count()


def test_upserts(spark, tmp_path):
    write = st.upsert_sink(str(tmp_path / "t"))
    a = spark.createDataFrame([("A", datetime.datetime(2024, 1, 1), 1.0)], "stock_id string, date timestamp_ntz, close double")
    write(a, 0)
    write(a.withColumn("close", F.lit(2.0)), 1)
    write(a.withColumn("close", F.lit(3.0)), 1)  # the same batch again
    write(a.withColumn("date", F.col("date") + F.expr("interval 1 day")), 2)
    assert sorted(r.close for r in spark.read.parquet(str(tmp_path / "t/v2")).collect()) == [1.0, 2.0]


def test_state_equals_batch(spark, tmp_path):
    bars = lineitem_bars(spark, FOLDER).cache()
    days = [r.date for r in bars.select("date").distinct().orderBy("date").collect()]
    cut = days[len(days) // 2]
    for k, part in enumerate((bars.where(F.col("date") <= cut), bars.where(F.col("date") > cut))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    import os
    import time

    files = sorted((f for f in os.listdir(tmp_path / "in") if f.endswith("parquet")), key=lambda f: os.path.getmtime(tmp_path / "in" / f))
    for k, f in enumerate(files):
        os.utime(tmp_path / "in" / f, (time.time() - 100 + k, time.time() - 100 + k))
    stream = spark.readStream.schema(bars.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = drain(st.running_indicators(stream), tmp_path)
    want = recursive(bars, {"w_ewm": ("ewm", 20), "w_rsi": ("rsi", 14)})
    both = got.join(want, ["stock_id", "date"])
    assert both.count() == bars.count()
    far = both.where("abs(ewm - w_ewm) > 1e-6 or (w_rsi is null) <> (rsi is null or isnan(rsi)) or abs(rsi - w_rsi) > 1e-6").count()
    assert far == 0
