"""Packing, concatenate and cut: two passes over partition token totals.

Pass 1 tokenizes each document once and writes its ids with the chunk (scan task) and the offset inside it. The
totals of the chunks give, by a running sum, each chunk's global offset. Pass 2 adds the two and cuts the stream
into windows of ``size`` tokens: a document yields one boundary record for each window it touches. Only chunk totals
are ordered in one place (a row of two longs for each scan task, broadcast up to ``CHUNKS`` of them, which is
250 TB in splits of 128 MB); no ids are shuffled.

Defined cases: a null text counts as empty and yields the end id alone; repeated rows are packed each by itself;
a document longer than a window spans several; only the stream's last window is not full; an empty table gives no
rows; a very long text is one row of ids until it is cut; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, bounded, factory, map_arrow, prepare

SIZE, END, CHUNKS = 2048, 1, 2_000_000


def tokenized(docs: DataFrame, vocabulary: str, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids binary, n, chunk, at): at is the number of ids before the document in its chunk."""
    prepare(docs.sparkSession)

    @factory
    def start():
        from tidemark.llm.tokens import word_encoder

        encoder, before = word_encoder(vocabulary), 0

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            nonlocal before
            ids = encoder.encode(b.column("text").to_pylist(), end)
            n = np.array([len(x) // 4 for x in ids], np.int64)
            at = before + np.cumsum(n) - n
            before += int(n.sum())
            return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(ids, pa.binary()), pa.array(n), b.column("chunk"), pa.array(at)], names=["doc_id", "ids", "n", "chunk", "at"])

        return step

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.spark_partition_id().alias("chunk"))
    return map_arrow(rows, start, "doc_id long, ids binary, n long, chunk int, at long")


def pack(docs: DataFrame, vocabulary: str, size: int = SIZE, end: int = END, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces: doc_id, start, length, doc_tokens, sequence_id, offset, piece_ids (little-endian unsigned 32-bit)."""
    scratch = Scratch(docs.sparkSession, "packing")
    rows = scratch.write(tokenized(docs, vocabulary, end, id_col, text_col), "ids")
    totals = rows.groupBy("chunk").agg(F.sum("n").alias("total"))
    base = F.sum("total").over(Window.orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    bases = scratch.write(totals.select("chunk", F.coalesce(base, F.lit(0)).alias("base")).coalesce(1), "bases")
    placed = rows.join(bounded(bases, bases.count(), CHUNKS), "chunk").withColumn("g", F.col("base") + F.col("at"))
    w = F.lit(size).cast("long")

    def piece(s):
        begin = F.greatest(F.col("g"), s * w)
        length = F.least(F.col("g") + F.col("n"), (s + 1) * w) - begin
        cut = F.substring("ids", ((begin - F.col("g")) * 4 + 1).cast("int"), (length * 4).cast("int"))
        return F.struct((begin - F.col("g")).alias("start"), length.alias("length"), s.alias("sequence_id"), (begin - s * w).alias("offset"), cut.alias("piece_ids"))

    windows = F.sequence(F.floor(F.col("g") / w), F.floor((F.col("g") + F.col("n") - 1) / w))
    return placed.select("doc_id", F.col("n").alias("doc_tokens"), F.inline(F.transform(windows, piece)))


def op3(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = pack(docs, vocabulary or public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", F.crc32("piece_ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
