"""Exact dedup by a log-structured merge index of content digests. DataFrame functions only.

* memtable: the rows a scan task reads, as (digest, identifier, row number). A flush writes them as one run, sorted
  by digest (a run never holds a text), with a filter: a bit for each digest, by hash.
* lookup: a later batch asks the filters of the runs before it, and only what a filter lets through is joined with
  the index.
* compaction: merges by size. A flush starts as a segment of its own; ``FANOUT`` segments of one size class are
  merged into the next class, and ``compact`` merges all that is left. A merge pre-aggregates by digest in each task,
  so that a group of copies costs a task one row however large it is; the first identifier of the order stays: the
  smallest, or the largest if asked.
* hits (digests with more than one row) receive byte verification: the texts of a digest must be one byte string.
  A filter over the hits drops all other texts before they are sent; what it lets through wrongly is a digest of one
  text, which verifies at once. Texts that only share a digest are told apart by their bytes.

A filter has 16 bits for each digest, and ``MOST_BITS`` (32 MB, the most that is broadcast) at most: at that size a
filter over h hits lets 1 - exp(-h / 2**28) of the other texts through, which is 6 % at 16 million hits. Beyond that
more texts are sent, never more than once for each task that holds them; results stay the same.

Defined cases: a null text counts as empty; a null identifier never stays if its group has another; of rows that
repeat an identifier and a text one stays; an empty table gives no rows; a very long text is hashed where it is read,
and sent only if it is a hit; other columns, whatever their names, are ignored here and kept by ``keep_one``.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, bounded, free, plain

#: Segments of one size class that are merged; rows of the smallest class, and how much larger the next one is.
FANOUT, SMALLEST = 4, 1 << 20
#: Bits of a filter's block (what bitmap_construct_agg makes), for each digest, and at most.
BLOCK, EACH, MOST_BITS = 1 << 15, 16, 1 << 28


def normalised(text: Column) -> Column:
    """A-Z lower-cased, nothing else."""
    return F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def digest_of(text: Column, bits: int = 256) -> Column:
    """SHA-256 of the normalised text in UTF-8, as bytes; fewer bits only to test verification."""
    whole = F.unhex(F.sha2(normalised(text).cast("binary"), 256))
    return whole if bits == 256 else F.substring(whole, 1, bits // 8)


class Filter:
    """A bit for the hash of each digest, in blocks: never denies a digest that it was made of."""

    def __init__(self, scratch: Scratch, digests: DataFrame, n: int, name: str, most: int = MOST_BITS):
        self.bits = min(most, -(-max(1, EACH * n) // BLOCK) * BLOCK)
        marks = digests.select(self._block().alias("block"), self._bit().alias("bit")).repartition("block")
        self.blocks = scratch.write(marks.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bits")), name)

    def _at(self) -> Column:
        return F.pmod(F.xxhash64("digest"), F.lit(self.bits))

    def _block(self) -> Column:
        return F.floor(self._at() / BLOCK)

    def _bit(self) -> Column:
        return F.pmod(self._at(), F.lit(BLOCK))

    def passed(self, rows: DataFrame) -> DataFrame:
        """Rows (with a digest) that may have one of the digests; at most MOST_BITS / 8 bytes are broadcast."""
        of = F.broadcast(self.blocks.withColumnsRenamed({"block": "filter_block", "bits": "filter_bits"}))
        byte = F.conv(F.hex(F.substring("filter_bits", (self._bit() / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        met = rows.join(of, self._block() == F.col("filter_block")).where(F.getbit(byte, F.pmod(self._bit(), F.lit(8)).cast("int")) == 1)
        return met.drop("filter_block", "filter_bits")


class DigestLog:
    """The index: runs as they were flushed, and segments (digest, k, n) in size classes with a filter each."""

    def __init__(self, spark: SparkSession, keep: str = "smallest", bits: int = 256, smallest: int = SMALLEST):
        if keep not in ("smallest", "largest"):
            raise ValueError("keep: smallest or largest")
        self.scratch, self.keep, self.bits, self.smallest = Scratch(spark, "digest-log"), keep, bits, smallest
        self.runs: list[DataFrame] = []
        self.segments: list[tuple[int, DataFrame, Filter | None]] = []  # size class, entries, filter
        self.index: DataFrame | None = None

    def _order(self) -> Column:
        if self.keep == "largest":
            return F.struct("id", (-F.col("run")).alias("r"), (-F.col("row")).alias("w"))
        return F.struct(F.coalesce("id", F.lit(2**63 - 1)).alias("o"), "id", "run", "row")

    def _first(self, c: Column | str) -> Column:
        return (F.max if self.keep == "largest" else F.min)(c)

    def flush(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Adds docs as a run: a sorted file of digests for each task that reads them."""
        rows = docs.select(digest_of(F.col(text_col), self.bits).alias("digest"), F.col(id_col).cast("long").alias("id"))
        rows = rows.withColumns({"row": F.monotonically_increasing_id(), "run": F.lit(len(self.runs))})
        run = self.scratch.write(rows.sortWithinPartitions("digest"), f"run{len(self.runs)}")
        self.runs.append(run)
        self.segments.append((self._size(run.count()), run.select("digest", self._order().alias("k"), F.lit(1).cast("long").alias("n")), None))
        while len(same := [s for s in self.segments if s[0] == self.segments[-1][0]]) >= FANOUT:
            self._merge(same)
        return run

    def _size(self, rows: int) -> int:
        size, most = 0, self.smallest
        while rows > most:
            size, most = size + 1, most * FANOUT
        return size

    def _merge(self, some: list[tuple[int, DataFrame, Filter | None]]) -> DataFrame:
        """One segment in place of some: each digest once, with the first of the order and the number of rows."""
        entries = some[0][1]
        for _, more, _ in some[1:]:
            entries = entries.unionByName(more)
        merged = entries.groupBy("digest").agg(self._first("k").alias("k"), F.sum("n").alias("n"))
        merged = self.scratch.write(merged.sortWithinPartitions("digest"), "segment")
        gone = set(map(id, some))
        self.segments = [s for s in self.segments if id(s) not in gone]
        # of a higher class than what it was made of, so that merges of one class come to an end
        self.segments.append((max(self._size(merged.count()), max(s[0] for s in some) + 1), merged, None))
        return merged

    def lookup(self, batch: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """(doc_id, digest, keep_id, n) of the rows of a batch whose text a run holds; filters are asked first."""
        rows = batch.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(F.col(text_col), self.bits).alias("digest"))
        found = None
        for i, (size, entries, own) in enumerate(self.segments):
            if own is None:
                own = Filter(self.scratch, entries.select("digest"), entries.count(), "filter")
                self.segments[i] = (size, entries, own)
            met = own.passed(rows).join(entries, "digest").select("doc_id", "digest", "k", "n")
            found = met if found is None else found.unionByName(met)
        if found is None:
            return rows.limit(0).select("doc_id", "digest", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("long").alias("n"))
        # a digest may stand in several runs, and in several entries of a run that was not merged yet
        one = found.groupBy("doc_id", "digest").agg(self._first("k").alias("k"), F.sum("n").alias("n"))
        return one.select("doc_id", "digest", F.col("k.id").alias("keep_id"), "n")

    def compact(self) -> DataFrame:
        """Merges all segments: (digest, id, run, row of the one that stays, n)."""
        merged = self._merge(self.segments)
        run, row = ((-F.col("k.r")), (-F.col("k.w"))) if self.keep == "largest" else (F.col("k.run"), F.col("k.row"))
        self.index = merged.select("digest", F.col("k.id").alias("keep_id"), run.cast("int").alias("keep_run"), row.alias("keep_row"), "n")
        return self.index

    def collisions(self, docs: DataFrame, text_col: str = "text", most: int = MOST_BITS) -> DataFrame | None:
        """Byte verification of the hits: digests that more than one byte string shares; None if there are none.

        Equal bytes meet in the map-side hash table, so a task sends each text once, whatever the group's size.
        """
        hits = self.index.where("n > 1").select("digest")
        n = hits.count()
        if not n:
            return None
        texts = docs.select(digest_of(F.col(text_col), self.bits).alias("digest"), F.col(text_col).alias("text"))
        texts = Filter(self.scratch, hits, n, "hits", most).passed(texts).select("digest", normalised(F.col("text")).alias("bytes"))
        bad = texts.groupBy("digest", "bytes").agg(F.lit(1).alias("one")).groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1")
        bad = self.scratch.write(bad.select("digest"), "collisions")
        return None if bad.isEmpty() else bad


def exact_dedup(docs: DataFrame, keep: str = "smallest", id_col: str = "doc_id", text_col: str = "text", bits: int = 256, most: int = MOST_BITS) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, digest."""
    log = DigestLog(docs.sparkSession, keep, bits)
    log.flush(docs, id_col, text_col)
    index = log.compact()
    bad = log.collisions(docs, text_col, most)
    rows = log.runs[0]
    out = rows.join(index, "digest")
    if bad is not None:
        out = out.join(bad, "digest", "left_anti")
    out = out.select(F.col("id").alias("doc_id"), "keep_id", F.col("n").alias("group_size"), ((F.col("row") == F.col("keep_row")) & (F.col("run") == F.col("keep_run"))).alias("kept"), "digest")
    if bad is None:
        return out
    # texts that share a digest: told apart by their bytes
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), digest_of(F.col(text_col), bits).alias("digest"), normalised(F.col(text_col)).alias("bytes"), F.monotonically_increasing_id().alias("row"))
    texts = log.scratch.write(texts.join(bad, "digest", "left_semi"), "texts")
    order = F.struct("doc_id", (-F.col("row")).alias("w")) if keep == "largest" else F.struct(F.coalesce("doc_id", F.lit(2**63 - 1)).alias("o"), "doc_id", "row")
    by_bytes = texts.groupBy("digest", "bytes").agg((F.max if keep == "largest" else F.min)(order).alias("k"), F.count("*").alias("n"))
    row = -F.col("k.w") if keep == "largest" else F.col("k.row")
    by_bytes = by_bytes.select("digest", "bytes", F.col("k.doc_id").alias("keep_id"), row.alias("keep_row"), F.col("n").alias("group_size"))
    apart = texts.join(by_bytes, ["digest", "bytes"]).select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest")
    return out.unionByName(apart)


def keep_one(docs: DataFrame, keep: str = "largest", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies that do not stay; all columns as they came."""
    scratch = Scratch(docs.sparkSession, "keep-one")
    found = scratch.write(exact_dedup(docs, keep, id_col, text_col).select("doc_id", "digest", "kept"), "found")
    again = found.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 or doc_id is null")
    again = scratch.write(again.select("doc_id"), "repeated")
    mark, key, digest = free(docs, "id", "key", "digest")
    marked = docs.withColumn(mark, F.col(id_col).cast("long"))
    gone = found.where("not kept and doc_id is not null").select(F.col("doc_id").alias(mark))
    gone = bounded(gone, gone.count())
    if again.isEmpty():
        return marked.join(gone, mark, "left_anti").select(*plain(docs))
    # identifiers that stand in more than one row: the digest decides, then one row of each
    usual = marked.where(F.col(mark).isNotNull()).join(again.select(F.col("doc_id").alias(mark)), mark, "left_anti")
    usual = usual.join(gone, mark, "left_anti").select(*plain(docs))
    none = -(2**63)
    odd = docs.withColumns({key: F.coalesce(F.col(id_col).cast("long"), F.lit(none)), digest: digest_of(F.col(text_col))})
    odd = odd.join(again.select(F.coalesce("doc_id", F.lit(none)).alias(key)), key, "left_semi")
    stay = found.where("kept").select(F.coalesce("doc_id", F.lit(none)).alias(key), F.col("digest").alias(digest)).distinct()
    odd = odd.join(stay, [key, digest], "left_semi").dropDuplicates([key, digest])
    return usual.unionByName(odd.select(*plain(docs)))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = exact_dedup(docs, keep="largest")
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP1_SQL = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = max(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
