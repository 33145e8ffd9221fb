"""Dataset operations: cleaning, checks, splits, scaling, upserts, incremental builds."""

from __future__ import annotations

import atexit
import contextlib
import json
import re
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.operators.rolling import Series
from tidemark.sources.bars import PRICES, clean_nan

# Fixed thresholds of the quality gate.
GATE = {"rejected_rows": 100, "penny": 1.0, "illiquid": 50_000, "short_rows": 252, "stale_days": 90, "fallen_from": 5.0}


def consistent_bar() -> Column:
    """A bar whose values are all there, positive, and inside its range."""
    there = F.lit(True)
    for c in (*PRICES, "volume"):
        there = there & F.col(c).isNotNull()
    positive = F.col("volume") > 0
    for c in PRICES:
        positive = positive & (F.col(c) > 0)
    inside = (F.col("high") >= F.greatest("open", "close", "low")) & (F.col("low") <= F.least("open", "close"))
    return F.coalesce(there & positive & inside, F.lit(False))


def clean_ohlcv(df: DataFrame, penny: float = 1.0, key: str = "stock_id") -> DataFrame:
    """Consistent bars of series that never close under the penny price (judged on consistent bars)."""
    df = df.where(consistent_bar())
    return df.join(df.where(F.col("close") < penny).select(key).distinct(), key, "left_anti")


def clean_dataset(df: DataFrame, features: Iterable[str]) -> DataFrame:
    """Rows with all features; infinities count as missing."""
    features = list(features)
    return clean_nan(df, tuple(features)).dropna(subset=features)


def projected(df: DataFrame, columns: Iterable[str], stocks: Iterable[str] | None = None, since=None) -> DataFrame:
    """Some columns of some series from a day on: what a scan can skip."""
    if stocks is not None:
        df = df.where(F.col("stock_id").isin(list(stocks)))
    if since is not None:
        df = df.where(F.col("date") >= F.lit(since))
    return df.select(*columns)


def adr_filter(df: DataFrame, s: Series, least: float, n: int = 20, seen: int = 10) -> DataFrame:
    """Series whose last average daily range (percent, unrounded, over n bars of which ``seen`` are there) reaches ``least``."""
    frame = s.last(n)
    wide = F.when(F.count("close").over(frame) >= seen, 100 * (F.avg(F.try_divide("high", "low")).over(frame) - 1))
    last = df.withColumn("__adr", wide).where("__adr is not null").groupBy(s.key).agg(F.max_by("__adr", s.order).alias("__last"))
    return df.join(last.where(F.col("__last") >= least).select(s.key), s.key, "left_semi")


def key_sets(old: DataFrame, new: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Distinct keys with the side they stand on: both, old or new."""
    keys = list(keys)
    marks = old.select(*keys, F.lit(1).alias("__s")).unionByName(new.select(*keys, F.lit(2).alias("__s")))
    side = F.when(F.bit_or("__s") == 3, "both").when(F.bit_or("__s") == 1, "old").otherwise("new")
    return marks.groupBy(*keys).agg(side.alias("side"))


def column_sets(old: DataFrame, new: DataFrame) -> DataFrame:
    """(column, side): columns of both tables, of the old one or of the new one alone."""
    rows = [(c, "both" if c in new.columns else "old") for c in old.columns] + [(c, "new") for c in new.columns if c not in old.columns]
    return old.sparkSession.createDataFrame(rows, "column string, side string")


def incremental_verdict(old: DataFrame, new: DataFrame, most_lost: int = 50, most_rows: float = 5.0) -> DataFrame:
    """One row on a rebuilt dataset: does it extend the old one, keep its columns and its series; and does it pass.

    row_change is the change of rows in the overlap in percent; over ``most_rows`` is a warning and no failure.
    """
    span = old.agg(F.min("date").alias("old_first"), F.max("date").alias("old_last"), F.count_distinct("stock_id").alias("old_stocks")).crossJoin(
        F.broadcast(new.agg(F.min("date").alias("new_first"), F.max("date").alias("new_last")))  # one row
    )
    begin = F.greatest("old_first", "new_first")
    mine = old.select("date").crossJoin(F.broadcast(span)).agg(F.sum(((F.col("date") >= begin) & (F.col("date") <= F.col("old_last"))).cast("long")).alias("old_rows"))
    late = F.col("date") > F.col("old_last")
    theirs = new.select("stock_id", "date").crossJoin(F.broadcast(span)).agg(
        F.sum(((F.col("date") >= begin) & ~late).cast("long")).alias("kept_rows"), F.sum(late.cast("long")).alias("new_rows"),
        F.count_distinct(F.when(late, F.col("date"))).alias("new_dates"), F.count_distinct(F.when(late, F.col("stock_id"))).alias("new_stocks"),
    )
    lost = lost_keys(old, new).agg(F.count("*").alias("lost_stocks"))
    gained = lost_keys(new, old).agg(F.count("*").alias("gained_stocks"))
    out = span
    for one in (mine, theirs, lost, gained):
        out = out.crossJoin(F.broadcast(one))  # one row each
    missing, extra = len(set(old.columns) - set(new.columns)), len(set(new.columns) - set(old.columns))
    out = out.withColumns({"missing_columns": F.lit(missing), "extra_columns": F.lit(extra), "extends": F.col("new_last") > F.col("old_last")})
    change = F.coalesce(F.try_divide(F.col("kept_rows") - F.col("old_rows"), F.col("old_rows")) * 100, F.lit(0.0))
    out = out.withColumns({"row_change": change, "rows_warned": F.abs(change) > most_rows})
    return out.withColumn("passed", F.col("extends") & (F.col("new_rows") > 0) & (F.col("missing_columns") == 0) & (F.col("lost_stocks") < most_lost))


def load_dataset(spark: SparkSession, path: str, stocks: Iterable[str] | None = None, features: Iterable[str] | None = None, meta: tuple[str, ...] = ("date", "stock_id", "open", "high", "low", "close", "volume"), labels: tuple[str, ...] = ("PivotLow", "PivotLow_base", "PivotLow_event_id", "PivotLow_event_offset")) -> tuple[DataFrame, list[str], dict[str, list[str]]]:
    """(rows without missing features, feature names, unknown names asked for). Projection and series filter reach the scan."""
    df = spark.read.parquet(path)
    if "PivotHigh" in df.columns:
        df = df.drop("PivotHigh")
    able = [c for c in df.columns if c not in meta and c not in labels]
    asked = list(features) if features is not None else able
    use = [f for f in asked if f in able]
    unknown = {"features": [f for f in asked if f not in able], "stocks": []}
    df = df.select(*[c for c in (*meta, *use, *labels) if c in df.columns])
    if stocks is not None:
        stocks = list(stocks)
        df = df.where(F.col("stock_id").isin(stocks))
        found = {r[0] for r in df.select("stock_id").distinct().collect()}  # no more than were asked for
        unknown["stocks"] = [x for x in stocks if x not in found]
    return clean_dataset(df, use), use, unknown


def preview(df: DataFrame, n: int = 5, label: str = "PivotLow") -> tuple[DataFrame, DataFrame]:
    """First rows, and one row with the table's size, range and label rate."""
    return df.orderBy("date", "stock_id").limit(n), summary(df, label)


def summary(df: DataFrame, label: str = "PivotLow") -> DataFrame:
    events = F.count_distinct(F.when(F.col("PivotLow_event_id") > 0, F.struct("stock_id", "PivotLow_event_id"))) if "PivotLow_event_id" in df.columns else F.lit(None).cast("long")
    return df.agg(
        F.count("*").alias("n_rows"), F.count_distinct("stock_id").alias("n_stocks"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.count_distinct("date").alias("n_dates"), F.sum(F.col(label).cast("long")).alias("n_labels"), F.avg(F.col(label).cast("double")).alias("label_rate"), events.alias("n_events"),
    )


def _shared_dir(spark: SparkSession) -> str | None:
    """A folder that driver and executors share: under spark.checkpoint.dir, or one of our own in local mode; else none."""
    sc = spark.sparkContext
    if given := sc.getConf().get("spark.checkpoint.dir", None):
        return f"{given.rstrip('/')}/tidemark-{sc.applicationId}"
    if not sc.master.startswith("local[") and sc.master != "local":
        return None
    own = tempfile.mkdtemp(prefix="tidemark-settled-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


@contextlib.contextmanager
def settled(df: DataFrame) -> Iterator[DataFrame]:
    """df written and read again inside the block: neither plans nor tasks built on it carry what made it.

    Where driver and executors share no folder, df is cached instead. It is cached while it is written, which keeps the
    partitions of its last exchange: a feature table is much wider than the bars by whose size they would be merged.
    """
    spark, before = df.sparkSession, df.storageLevel
    kept, folder = df if before.useMemory or before.useDisk else df.persist(), _shared_dir(spark)
    if folder is None:
        yield kept
        return
    path = f"{folder}/settled-{uuid.uuid4().hex[:12]}"
    try:
        kept.write.parquet(path)
        if not (before.useMemory or before.useDisk):
            kept.unpersist()
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def validate_final(df: DataFrame, features: Iterable[str], labels: tuple[str, ...] = ("PivotLow", "PivotLow_base", "PivotLow_event_id", "PivotLow_event_offset")) -> list[str]:
    """What is wrong with a finished dataset; one pass over the data."""
    features = list(features)
    wrong = [f"label among features: {c}" for c in features if c in labels or c == "PivotHigh"]
    wrong += [f"missing label: {c}" for c in labels if c not in df.columns] + [f"missing feature: {c}" for c in features if c not in df.columns]
    use = [c for c in features if c in df.columns]
    kinds = dict(df.dtypes)
    checks = [F.count("*").alias("n")]
    checks += [F.sum(F.col(c).isNull().cast("long") + (F.isnan(c).cast("long") if kinds[c] in ("double", "float") else 0)).alias(f"null:{c}") for c in use]
    checks += [F.sum((F.abs(F.col(c)) == float("inf")).cast("long")).alias(f"inf:{c}") for c in use if kinds[c] in ("double", "float")]
    if "PivotLow" in df.columns:
        checks.append(F.sum(F.col("PivotLow").cast("long")).alias("ones"))
    if "PivotLow_event_id" in df.columns and "PivotLow_event_offset" in df.columns:
        checks.append(F.sum(((F.col("PivotLow_event_id") > 0) == (F.col("PivotLow_event_offset").isNull() | F.isnan("PivotLow_event_offset"))).cast("long")).alias("offset"))
    got = df.agg(*checks).first().asDict()
    for k, v in got.items():
        if ":" in k and v:
            wrong.append(f"{k.split(':')[0]} values in {k.split(':', 1)[1]}: {v}")
    if "ones" in got and got["ones"] in (0, None, got["n"]):
        wrong.append("labels are all alike")
    if got.get("offset"):
        wrong.append(f"offsets do not match events: {got['offset']}")
    return wrong


def quality_gate(df: DataFrame, today: Column, key: str = "stock_id") -> DataFrame:
    """One row a series with the first rule it fails, in order, or ``valid``."""
    g = df.groupBy(key).agg(F.count("*").alias("n_rows"), F.avg("close").alias("avg_price"), F.avg("volume").alias("avg_volume"), F.max("date").alias("last_date"), F.max_by("close", "date").alias("last_price"))
    status = (
        F.when(F.col("n_rows") < GATE["rejected_rows"], "rejected").when(F.col("avg_price") < GATE["penny"], "penny").when(F.col("avg_volume") < GATE["illiquid"], "illiquid")
        .when(F.col("n_rows") < GATE["short_rows"], "insufficient").when(F.datediff(today, "last_date") > GATE["stale_days"], "delisted")
        .when((F.col("last_price") < GATE["penny"]) & (F.col("avg_price") > GATE["fallen_from"]), "delisted").otherwise("valid")
    )
    return g.withColumn("status", status)


def session_bounds(df: DataFrame, train_end, val_end, embargo: int = 14) -> tuple[DataFrame, dict]:
    """Last session of train and of validation after the embargo. A row a session is all that is ordered."""
    days = df.select("date").distinct()
    part = F.when(F.col("date") <= F.lit(train_end), "train").when(F.col("date") <= F.lit(val_end), "val").otherwise("test")
    days = days.withColumn("part", part)
    back = F.row_number().over(Window.partitionBy("part").orderBy(F.desc("date")))
    last = days.withColumn("back", back).where((F.col("part") != "test") & (F.col("back") > embargo)).groupBy("part").agg(F.max("date").alias("last"))
    return days, {r["part"]: r["last"] for r in last.collect()}


def temporal_split(df: DataFrame, train_end, val_end, embargo: int = 14, include_test: bool = True) -> DataFrame:
    """df with a ``split`` column; the last ``embargo`` sessions of train and of validation are left out."""
    _, last = session_bounds(df, train_end, val_end, embargo)
    d = F.col("date")
    never = F.lit(False)
    train = (d <= F.lit(last["train"])) if "train" in last else never
    val = ((d > F.lit(train_end)) & (d <= F.lit(last["val"]))) if "val" in last else never
    split = F.when(train, "train").when(val, "val").when(d > F.lit(val_end), "test")
    out = df.withColumn("split", split).where("split is not null")
    return out if include_test else out.where("split <> 'test'")


def walk_forward(df: DataFrame, folds: Iterable[tuple[str, object, object]], embargo: int = 14) -> DataFrame:
    """Rows of all folds (name, end of train, end of validation), with columns fold and split."""
    out = None
    for name, train_end, val_end in folds:
        one = temporal_split(df, train_end, val_end, embargo, include_test=False).withColumn("fold", F.lit(name))
        out = one if out is None else out.unionByName(one)
    return out


def scale(df: DataFrame, columns: Iterable[str], split: str = "split", fit_on: str = "train") -> DataFrame:
    """Columns standardised by mean and population deviation of the fitting part; a deviation of zero counts as one."""
    columns = list(columns)
    on = F.col(split) == fit_on
    stats = df.agg(*[f(F.when(on, F.col(c))).alias(f"{n}:{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first().asDict()
    scaled = {c: (F.col(c) - F.lit(stats[f"m:{c}"])) / F.lit(stats[f"s:{c}"] or 1.0) for c in columns}
    return df.withColumns(scaled)


def upsert(old: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("stock_id", "date")) -> DataFrame:
    """Rows of both, the new one where both have a key; columns that one side lacks are NULL."""
    both = old.withColumn("__src", F.lit(0)).unionByName(new.withColumn("__src", F.lit(1)), allowMissingColumns=True)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("__src")))
    return both.withColumn("__r", rank).where("__r = 1").drop("__src", "__r")


def merge_ohlcv(old: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert of bars; new rows take over is_failed from their series (false if unknown)."""
    if "is_failed" in old.columns and "is_failed" not in new.columns:
        known = old.groupBy("stock_id").agg(F.max(F.col("is_failed").cast("int")).cast("boolean").alias("__f"))
        new = new.join(known, "stock_id", "left").withColumn("is_failed", F.coalesce("__f", F.lit(False))).drop("__f")
    return upsert(old, new)


def update_range(df: DataFrame, today: Column, buffer_days: int = 7) -> DataFrame:
    """One row: the first day to fetch and the last complete one."""
    return df.agg(F.max("date").alias("latest")).select(F.date_add("latest", 1).alias("first_day"), F.date_sub(today, buffer_days).alias("last_day"))


def incremental(bars: DataFrame, old: DataFrame, build: Callable[[DataFrame], DataFrame], lookback_days: int = 365) -> DataFrame:
    """Old rows before a cutoff (latest old day less the lookback), and rows rebuilt from one more lookback of bars.

    Exact for finite windows; features that accumulate over all history have to be built over all of it.
    """
    latest = old.agg(F.max("date")).first()[0]
    cutoff = F.lit(latest) - F.expr(f"interval {lookback_days} days")
    fresh = build(bars.where(F.col("date") >= cutoff - F.expr(f"interval {lookback_days} days"))).where(F.col("date") >= cutoff)
    return upsert(old.where(F.col("date") < cutoff), fresh.select(*[c for c in old.columns if c in fresh.columns]))


def compare_datasets(old: DataFrame, new: DataFrame, columns: Iterable[str], tolerance: float = 1e-6) -> DataFrame:
    """For each column: overlapping rows, the largest difference, and rows over the tolerance or missing on one side."""
    columns = list(columns)
    both = old.select("stock_id", "date", *[F.col(c).alias(f"o:{c}") for c in columns]).join(new.select("stock_id", "date", *[F.col(c).alias(f"n:{c}") for c in columns]), ["stock_id", "date"])
    aggs = [F.count("*").alias("rows")]
    for c in columns:
        d = F.abs(F.col(f"o:{c}") - F.col(f"n:{c}"))
        odd = (F.col(f"o:{c}").isNull() != F.col(f"n:{c}").isNull()) | F.coalesce(d > tolerance, F.lit(False))
        aggs.append(F.struct(F.max(d).alias("largest"), F.sum(odd.cast("long")).alias("differ")).alias(c))
    one = both.agg(*aggs)
    parts = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col("rows").alias("n_rows"), F.col(f"`{c}`.largest").alias("largest"), F.col(f"`{c}`.differ").alias("differ")) for c in columns]))
    return one.select(parts.alias("x")).select("x.*")


def lost_keys(old: DataFrame, new: DataFrame, key: str = "stock_id") -> DataFrame:
    return old.select(key).distinct().join(new.select(key).distinct(), key, "left_anti")


def optimize_types(df: DataFrame, keep: Iterable[str]) -> DataFrame:
    """Doubles to float, and to tinyint where all values are 0 or 1; one pass to find out."""
    keep = set(keep)
    doubles = [f.name for f in df.schema if f.dataType.simpleString() == "double" and f.name not in keep]
    if not doubles:
        return df
    binary = df.agg(*[F.bool_and(F.col(c).isin(0.0, 1.0) & F.col(c).isNotNull()).alias(c) for c in doubles]).first().asDict()
    narrow = {c: F.coalesce(F.col(c), F.lit(None)).cast("tinyint" if binary[c] else "float") for c in doubles}
    return df.select(*[narrow.get(c, F.col(c)).alias(c) for c in df.columns])


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_json(spark: SparkSession, path: str) -> dict:
    """A JSON file by Hadoop's file systems; {} if it is not there."""
    p, fs = _file(spark, path)
    return json.loads("\n".join(r.value for r in spark.read.text(path).collect())) if fs.exists(p) else {}  # one small file


def write_json(spark: SparkSession, path: str, value) -> None:
    p, fs = _file(spark, path)
    out = fs.create(p, True)
    try:
        out.write(bytearray(json.dumps(value, indent=2, default=str).encode()))
    finally:
        out.close()


def save_dataset(df: DataFrame, path: str, features: Iterable[str], by_year: bool = False) -> dict:
    """Parquet (optionally by year, so that date filters prune folders), and its facts merged into metadata.json.

    What other steps wrote into metadata.json stays; the part "features" is replaced.
    """
    spark, out = df.sparkSession, df.withColumn("year", F.year("date")) if by_year else df
    writer = out.write.mode("overwrite")
    (writer.partitionBy("year") if by_year else writer).parquet(f"{path}/dataset.parquet")
    row = summary(df).first().asDict()
    meta = {k: (str(v) if k.endswith("date") else v) for k, v in row.items()} | {"features": list(features)}
    write_json(spark, f"{path}/metadata.json", read_json(spark, f"{path}/metadata.json") | {"features": meta})
    return meta


def save_ohlcv(df: DataFrame, path: str, stats: dict, key: str = "stock_id") -> None:
    """Bars with the files that stand beside them: metadata.json, selection_stats.json and all_tickers.json."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(f"{path}/ohlcv.parquet")
    tickers = [r[0] for r in df.select(key).distinct().orderBy(key).collect()]  # a universe of symbols
    write_json(spark, f"{path}/selection_stats.json", stats)
    write_json(spark, f"{path}/all_tickers.json", tickers)
    write_json(spark, f"{path}/metadata.json", read_json(spark, f"{path}/metadata.json") | {"selection_stats": stats, "total_stocks": len(tickers)})


def dated_folders(spark: SparkSession, root: str, holding: str) -> list[str]:
    """Folders named YYYYMMDD under root that hold a file or folder of the name, the newest first."""
    jvm = spark.sparkContext._jvm
    base = jvm.org.apache.hadoop.fs.Path(root)
    fs = base.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(base):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(base) if x.isDirectory()]
    return [f"{root}/{n}" for n in sorted((n for n in names if re.fullmatch(r"\d{8}", n)), reverse=True) if fs.exists(jvm.org.apache.hadoop.fs.Path(f"{root}/{n}/{holding}"))]
