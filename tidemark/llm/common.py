"""What the operators share: code shipping, written scratch tables, free column names, sorted groups, components."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows of an Arrow batch: long texts make wide rows, and a Python worker holds a batch or two.
BATCH_ROWS = 1000
#: A table is broadcast only if it has been counted and has at most so many rows (of a few longs each).
BROADCAST_ROWS = 500_000

_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def prepare(spark: SparkSession) -> None:
    """Sends this package to the executors, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    to = os.path.join(os.path.realpath(tempfile.mkdtemp(prefix="tidemark-")), f"tidemark_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(to, "w") as z:
        for p in sorted((root / "tidemark").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(to)
    _shipped.add(app)


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of BATCH_ROWS rows for the jobs run inside; the session's own setting holds again behind."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(BATCH_ROWS))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


@contextlib.contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries run inside delete their shuffle files when they end, not when the driver collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own in local mode."""
    sc = spark.sparkContext
    if given := sc.getConf().get("spark.checkpoint.dir", None):
        return f"{given.rstrip('/')}/tidemark-{sc.applicationId}"
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.applicationId not in _own_dirs:
        _own_dirs[sc.applicationId] = d = tempfile.mkdtemp(prefix="tidemark-shared-")
        atexit.register(__import__("shutil").rmtree, d, ignore_errors=True)
    return f"file://{_own_dirs[sc.applicationId]}"


class Scratch:
    """Written tables of one operator call. A table cuts lineage: a lost executor costs no recomputation.

    Tables that a result still reads live until ``close``, until the ``released`` block around the call ends, or until
    the application does; what nothing reads any more is dropped on the way. With ``lean`` the shuffle files behind a
    table go as soon as it stands, and a folder of the local file system is written by the Python workers (``stored``).
    """

    _all: list[Scratch] = []

    def __init__(self, spark: SparkSession, name: str, lean: bool = False):
        self.spark, self.base = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.made, self.lean = 0, lean
        Scratch._all.append(self)

    def write(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        self.made += 1
        path = f"{self.base}/{self.made:03d}-{name}"
        folder = self._local(path) if self.lean and not options else None
        writer = df.write.mode("overwrite").option("compression", "zstd")
        for k, v in options.items():
            writer = writer.option(k, v)
        with small_batches(self.spark), freed_shuffles(self.spark) if self.lean else contextlib.nullcontext():
            writer.parquet(path) if folder is None else stored(df, folder)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def _local(self, path: str) -> str | None:
        """The path as Python opens it, or None where only Hadoop reaches it."""
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        return fs.makeQualified(p).toUri().getPath() if fs.getUri().getScheme() == "file" else None

    def _delete(self, path: str) -> None:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing will read any more."""
        for t in tables:
            self._delete(t.scratch_path)

    def close(self) -> None:
        """Deletes all tables: results that read them must have been written before."""
        self._delete(self.base)
        if self in Scratch._all:
            Scratch._all.remove(self)


@contextlib.contextmanager
def released() -> Iterator[None]:
    """Closes the scratch tables of all operators called inside. Their results must be written inside too."""
    before = set(map(id, Scratch._all))
    try:
        yield
    finally:
        for s in [s for s in Scratch._all if id(s) not in before]:
            s.close()


def plain(docs: DataFrame | list[str]) -> list[Column]:
    """All columns of docs (or of these names) as they came, whatever signs stand in their names."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in (docs if isinstance(docs, list) else docs.columns)]


def free(docs: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them until no column of docs (in any case) has them."""
    taken, out = {c.lower() for c in docs.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the identifier as text leaves 1 modulo 3; false without an identifier."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def bounded(df: DataFrame, rows: int, most: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast where its counted rows stay under the bound, else as it is."""
    return F.broadcast(df) if rows <= most else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def by_bytes(b: pa.RecordBatch, most: int = 6_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about so many bytes each: long texts come a few at a time."""
    if b.nbytes <= most or b.num_rows == 1:
        yield b
        return
    half = b.num_rows // 2
    for part in (b.slice(0, half), b.slice(half)):
        yield from by_bytes(part, most)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType, most: int = 6_000_000) -> DataFrame:
    """fn applied to Arrow batches of bounded size; a function marked ``factory`` makes fn once a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = fn() if getattr(fn, "factory", False) else fn
        for b in batches:
            for part in by_bytes(b, most):
                if part.num_rows and (out := step(part)) is not None:
                    yield out

    out = df.mapInArrow(run, schema)
    out.made_by = df, run
    return out


def stored(df: DataFrame, folder: str, most: int = 16_000_000) -> None:
    """Writes df as Parquet into a local folder, from the Python workers; what ``map_arrow`` makes is written where it is made.

    Hadoop's local file system starts three chmod processes for each file. Between its start and its exec such a child
    has the JVM's whole memory as its own, and an executor is seen with twice its size. A file gets its name when it is
    whole; another attempt of its task puts the same rows under the same name. A row group has about ``most`` bytes.
    """
    os.makedirs(folder)
    source, make = getattr(df, "made_by", (df, iter))
    schema = to_arrow_schema(df.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        part, held, writer = f"{folder}/.{task.partitionId():05d}-{task.taskAttemptId()}", [], None

        def flush() -> None:
            writer.write_table(pa.Table.from_batches(held).select(schema.names).cast(schema))
            held.clear()

        try:
            for b in make(batches):
                if not b.num_rows:
                    continue
                writer = writer or pq.ParquetWriter(part, schema, compression="zstd")
                held.append(b)
                if sum(x.nbytes for x in held) >= most:
                    flush()
            if held:
                flush()
        finally:
            if writer:
                writer.close()
        if writer:
            os.replace(part, f"{folder}/part-{task.partitionId():05d}.parquet")
        yield from ()

    source.mapInArrow(run, "n long").write.format("noop").mode("overwrite").save()


def factory(fn):
    fn.factory = True
    return fn


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, rows: int = 4000) -> Iterator[pa.Table]:
    """Tables of rows sorted by key, cut only between keys; a table has about ``rows`` rows, or one group."""
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        if not b.num_rows:
            continue
        held.append(b)
        n += b.num_rows
        if n < rows:
            continue
        t = pa.Table.from_batches(held)
        keys = t.column(key).to_numpy()
        cut = int((keys != keys[-1]).nonzero()[0][-1]) + 1 if keys[0] != keys[-1] else 0
        if cut:
            yield t.slice(0, cut)
            held = t.slice(cut).combine_chunks().to_batches()
            n = t.num_rows - cut
    if held:
        yield pa.Table.from_batches(held)


def components(scratch: Scratch, edges: DataFrame, most: int = 60) -> DataFrame:
    """(node, label): label is the smallest node of its component. edges: (a long, b long), any order.

    Large-star and small-star steps in turn (Kiveris et al., 2014) until the edges stay as they are:
    O(log n) rounds. Minima are aggregated on the map side and written, so a join has two plain exchanges and a hub's
    partition can be split; each round is a written table.
    """
    e = scratch.write(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(most):
        # large star: neighbours larger than the node hang under the node's smallest neighbour (or itself)
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.write(both.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = scratch.write(large, "large")
        # small star: smaller neighbours and the node itself hang under the smallest
        low2 = scratch.write(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v"))).distinct()
        new = scratch.write(small, "edges")
        now = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(e, low, large, low2)
        e = new
        if before is not None and tuple(now) == tuple(before):
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("label"))
