"""Bars as streams: tumbling windows with a watermark, deduplication, upserts, and indicators with kept state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.dataset import upsert
from tidemark.sources.bars import event_bars

LATE = "7 days"


def _watermarked(events: DataFrame, late: str) -> DataFrame:
    """Watermarks are kept on instants only: local times are read in the session's time zone."""
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def stream_bars(events: DataFrame, width: str = "1 hour", late: str = LATE) -> DataFrame:
    """Tumbling-window bars; events later than the watermark are dropped. On a batch frame the watermark does nothing."""
    if not events.isStreaming:
        return event_bars(events, width)
    out = event_bars(_watermarked(events, late), width)
    return out.withColumn("date", F.col("date").cast("timestamp_ntz"))


def once_per_key(events: DataFrame, keys: tuple[str, ...] = ("event_id",), late: str = LATE) -> DataFrame:
    """The first event of each key inside the watermark."""
    if not events.isStreaming:
        return events.dropDuplicates(list(keys))
    return _watermarked(events, late).dropDuplicatesWithinWatermark(list(keys)).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def upsert_sink(path: str):
    """A foreachBatch function that upserts bars into a Parquet table, by writing the next version beside the last."""

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        root = jvm.org.apache.hadoop.fs.Path(path)
        fs = root.getFileSystem(conf)
        old = sorted(int(x.getPath().getName()[1:]) for x in fs.listStatus(root)) if fs.exists(root) else []
        if number in old:  # the batch was written before a restart
            return
        merged = upsert(spark.read.parquet(f"{path}/v{old[-1]}"), batch) if old else batch.dropDuplicates(["stock_id", "date"])
        merged.write.mode("overwrite").parquet(f"{path}/v{number}")
        for v in old[:-1]:
            fs.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/v{v}"), True)

    return write


def running_indicators(bars: DataFrame, span: int = 20, n: int = 14) -> DataFrame:
    """(stock_id, date, ewm, rsi, obv) with state kept by series: the batch recurrences, one bar after another.

    A batch's bars of a series are taken in date order; bars must not arrive before earlier ones of their series.
    """
    schema = "stock_id string, date timestamp_ntz, ewm double, rsi double, obv double"
    state = "seen int, last double, ewm double, up double, down double, obv double"

    def step(key: tuple, frames: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        seen, last, ewm, up, down, obv = kept.get if kept.exists else (0, 0.0, 0.0, 0.0, 0.0, 0.0)
        rows = []
        for bar in pd.concat(list(frames)).sort_values("date").itertuples():
            move = bar.close - last if seen else 0.0
            if seen == 0:
                ewm, obv = bar.close, bar.volume
            else:
                ewm += 2 / (span + 1) * (bar.close - ewm)
                obv += bar.volume if move > 0 else -bar.volume if move < 0 else 0.0
            rise, fall = max(move, 0.0), max(-move, 0.0)
            if 1 <= seen <= n:
                up, down = up + rise / n, down + fall / n
            elif seen > n:
                up, down = up + (rise - up) / n, down + (fall - down) / n
            rsi = None if seen < n else 100.0 if down == 0 else 100 - 100 / (1 + up / down)
            rows.append((key[0], bar.date, ewm, rsi, obv))
            seen, last = seen + 1, bar.close
        kept.update((seen, float(last), float(ewm), float(up), float(down), float(obv)))
        yield pd.DataFrame(rows, columns=["stock_id", "date", "ewm", "rsi", "obv"])

    return bars.groupBy("stock_id").applyInPandasWithState(step, schema, state, "append", GroupStateTimeout.NoTimeout)


def complete_days(bars: DataFrame, today, buffer_days: int = 7) -> DataFrame:
    """Bars old enough to be complete."""
    return bars.where(F.col("date") <= F.date_sub(F.lit(today), buffer_days))
