"""Substring dedup by level-wise doubling of repeated word windows.

Lengths go from about ``FIRST`` words to the window by doubling (13, 25, 50). Level 0 looks at windows of the least
length, and of these only at minimizers: in each window of the next length the smallest hash of the shorter ones.
Equal long windows hold equal minimizers, so a long window without a repeated minimizer repeats nowhere. Windows that
stand over a repeated one are extended to the next length and counted again, whole; from there on a window goes on only
if both its halves repeat. It ends when the asked length is reached or no candidate survives. A window repeats if its
words stand in two documents; its first document is a minimum, aggregated on the map side, so a passage that a third
of all documents share costs a task one row. Copies of a whole document are told by a digest of their words first and
take no part in the levels: whatever stands in them stands in the first of them.

Window keys are 128 bits at the last level, and 64 bits before it, where a wrong hit costs a candidate and nothing else.
Words are as the contract has them: ``[^\\x20\\x09-\\x0D]+``. A level's tables are deleted when the next one stands.

Defined cases: a null text has no words; texts shorter than the window lose nothing; a row without an identifier
loses nothing and takes nothing from others; rows that repeat an identifier take nothing from each other; a very long
text is one row whose windows go out in one Arrow batch; an empty table gives no rows; other columns, whatever their
names, are ignored.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, bounded, factory, map_arrow, prepare

WINDOW, FIRST = 50, 13
#: Words whose hashes a worker remembers; longs that a broadcast may hold, and bytes where rows hold texts.
REMEMBERED, BROADCAST_LONGS, BROADCAST_BYTES = 400_000, 4_000_000, 32_000_000
#: Bytes of the texts that a worker cuts into words at once.
AT_ONCE = 2_000_000


def levels_of(window: int, first: int = FIRST) -> list[int]:
    """Lengths from about ``first`` on, each at most twice the one before, up to the window; two at least."""
    out = [window]
    while (out[0] > first or len(out) == 1) and out[0] > 1:
        out.insert(0, (out[0] + 1) // 2)
    return out


class _Words(dict):
    """Word -> number of the word in two growing arrays of hashes."""

    def __init__(self):
        super().__init__()
        self.low, self.high = array("Q"), array("Q")

    def __missing__(self, word: bytes) -> int:
        h = xxhash.xxh3_128_intdigest(word)
        self.low.append(h & 0xFFFFFFFFFFFFFFFF)
        self.high.append(h >> 64)
        self[word] = n = len(self.low) - 1
        return n


def join_hashes(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """Hash of two adjacent windows from their hashes."""
    with np.errstate(over="ignore"):
        z = a * np.uint64(0x9E3779B97F4A7C15 + 2 * salt) + (b ^ (b >> np.uint64(31))) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(salt)
        z = (z ^ (z >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return z ^ (z >> np.uint64(32))


def window_hashes(words: np.ndarray, length: int, salt: int) -> np.ndarray:
    """Hashes of all windows of a length, by doubling; the last doubling overlaps if the length asks for it."""
    x, n = words, 1
    while n < length:
        step = min(n, length - n)
        x = join_hashes(x[: max(0, len(x) - step)], x[step:], salt + n)
        n += step
    return x


def sliding(x: np.ndarray, size: int, op) -> np.ndarray:
    """op over x[i : i + size]."""
    n = 1
    while n < size:
        step = min(n, size - n)
        x = op(x[: max(0, len(x) - step)], x[step:])
        n += step
    return x


class Texts:
    """Words of the texts of a batch, one after another."""

    def __init__(self, texts: list[str | None], table: _Words):
        if len(table) > REMEMBERED:
            table.clear()
            del table.low[:], table.high[:]
        self.words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        sizes = np.array([len(w) for w in self.words], np.int64)
        ids = np.fromiter((table[w] for ws in self.words for w in ws), np.int64, int(sizes.sum()))
        self.low = np.frombuffer(table.low, np.uint64)[ids] if len(ids) else np.zeros(0, np.uint64)
        self.high = np.frombuffer(table.high, np.uint64)[ids] if len(ids) else np.zeros(0, np.uint64)
        self.sizes, self.ends = sizes, np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.doc = np.repeat(np.arange(len(sizes)), sizes)
        self.left = self.ends[self.doc] - np.arange(len(ids)) if len(ids) else ids  # words from here to the document's end

    def anchors(self, short: int, long: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions and hashes of the minimizers: short windows that are the least of some long window."""
        h = window_hashes(self.low, short, 1)
        span = long - short + 1
        least = sliding(h, span, np.minimum)
        if not len(least):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        least = np.where(self.left[: len(least)] >= long, least, np.uint64(0))
        padded = np.concatenate([np.zeros(span - 1, np.uint64), least, np.zeros(len(h) - len(least), np.uint64)])
        most = sliding(padded, span, np.maximum)[: len(h)]
        at = np.flatnonzero((most == h) & (h != 0))
        return at, h[at]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


def described(docs: DataFrame, short: int, long: int) -> DataFrame:
    """doc_id, th, digest, n_words, sha (of all words), anchors: one row per row."""
    prepare(docs.sparkSession)

    @factory
    def start():
        table = _Words()

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            t = Texts(b.column("text").to_pylist(), table)
            at, h = t.anchors(short, long)
            cuts = np.searchsorted(at, np.append(t.starts, len(t.low)))
            joined = [b" ".join(w) for w in t.words]
            anchors = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), _signed(h))
            return pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"), b.column("th"), pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in joined], pa.binary()),
                    pa.array(t.sizes), pa.array([hashlib.sha256(x).hexdigest() for x in joined]), anchors,
                ],
                names=["doc_id", "th", "digest", "n_words", "sha", "anchors"],
            )

        return step

    return map_arrow(docs, start, "doc_id long, th long, digest binary, n_words long, sha string, anchors array<long>", AT_ONCE)


def extended(docs: DataFrame, short: int, long: int, over_anchors: bool, last: bool) -> DataFrame:
    """(doc_id, th, pos, h1; h2 at the last level) of candidate windows of the longer length. docs: doc_id, th, text, hits.

    hits are hashes of repeated minimizers, or runs of positions of repeated windows of the shorter length (``runs``).
    """

    @factory
    def start():
        table = _Words()

        def step(b: pa.RecordBatch) -> pa.RecordBatch | None:
            t = Texts(b.column("text").to_pylist(), table)
            if len(t.low) < long:
                return None
            hits, begin = b.column("hits"), None
            count = np.array([len(x) for x in hits], np.int64)
            flat = hits.flatten().to_numpy()
            if over_anchors:
                at, h = t.anchors(short, long)
                at = at[np.isin(h.view(np.int64), flat)]
                begin = np.maximum(at - (long - short), t.starts[t.doc[at]])
                end = np.minimum(at, t.ends[t.doc[at]] - long)
                fine = end >= begin
                edge = np.zeros(len(t.low) + 1, np.int64)
                np.add.at(edge, begin[fine], 1)
                np.add.at(edge, end[fine] + 1, -1)
                able = np.cumsum(edge[:-1]) > 0
            else:
                base, edge = np.repeat(t.starts, count), np.zeros(len(t.low) + 1, np.int64)
                np.add.at(edge, base + (flat >> 32), 1)
                np.add.at(edge, base + (flat & 0xFFFFFFFF), -1)
                seen = np.cumsum(edge[:-1]) > 0
                able = seen.copy()
                step_ = long - short
                able[: len(able) - step_] &= seen[step_:]
                able[max(0, len(able) - step_) :] = False
            at = np.flatnonzero(able & (t.left >= long))
            if not len(at):
                return None
            keys = [window_hashes(t.low, long, 1)[at]] + ([window_hashes(t.high, long, 77)[at]] if last else [])
            d = t.doc[at]
            ids, th = b.column("doc_id").to_numpy(), b.column("th").to_numpy()
            return pa.RecordBatch.from_arrays([pa.array(ids[d]), pa.array(th[d]), pa.array((at - t.starts[d]).astype(np.int32)), *map(_signed, keys)], names=["doc_id", "th", "pos", "h1", "h2"][: 3 + len(keys)])

        return step

    return map_arrow(docs.select("doc_id", "th", "text", "hits"), start, "doc_id long, th long, pos int, h1 long" + (", h2 long" if last else ""), AT_ONCE)


def without(docs: DataFrame, texts: bool) -> DataFrame:
    """(doc_id, th, n_removed, kept; kept_text with texts) of docs: doc_id, th, text, starts, ends (ranges of covered words)."""

    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        gone, shas, kept_texts = [], [], []
        for text, starts, ends in zip(b.column("text").to_pylist(), b.column("starts").to_pylist(), b.column("ends").to_pylist(), strict=True):
            words = (text or "").encode("utf-8", "surrogatepass").split()
            kept, at = [], 0
            for s, e in zip(starts, ends, strict=True):
                kept += words[at:s]
                at = e
            kept += words[at:]
            out = b" ".join(kept)
            gone.append(len(words) - len(kept))
            shas.append(hashlib.sha256(out).hexdigest())
            if texts:
                kept_texts.append(out.decode("utf-8", "replace"))
        more = [pa.array(kept_texts, pa.string())] if texts else []
        return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), pa.array(gone, pa.int64()), pa.array(shas), *more], names=["doc_id", "th", "n_removed", "kept", "kept_text"][: 4 + len(more)])

    return map_arrow(docs.select("doc_id", "th", "text", "starts", "ends"), step, "doc_id long, th long, n_removed long, kept string" + (", kept_text string" if texts else ""), AT_ONCE)


def runs(ps: str, reach: int) -> tuple[Column, Column]:
    """(starts, ends) of the ranges that a sorted array of positions covers, if each covers ``reach`` places."""
    starts = F.expr(f"filter({ps}, (p, i) -> i = 0 or p > {ps}[greatest(i - 1, 0)] + {reach})")
    ends = F.expr(f"transform(filter({ps}, (p, i) -> i = size({ps}) - 1 or {ps}[least(i + 1, size({ps}) - 1)] > p + {reach}), p -> p + {reach})")
    return starts, ends


def substring_dedup(docs: DataFrame, window: int = WINDOW, first: int = FIRST, texts: bool = False, id_col: str = "doc_id", text_col: str = "text", seen: dict[int, int] | None = None) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, and with ``texts`` kept_text (null where nothing was removed).

    ``seen`` is filled with the number of candidate windows of each length.
    """
    if window < 2:
        raise ValueError("window: two words at least")
    spark = docs.sparkSession
    prepare(spark)
    scratch, lengths = Scratch(spark, "substrings", lean=True), levels_of(window, first)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    docs = docs.withColumn("th", F.coalesce(F.xxhash64("text"), F.lit(0)))
    all_ = scratch.write(described(docs, lengths[0], lengths[1]), "described")

    # copies of a whole document: only the first takes part
    copies = all_.where(f"n_words >= {window} and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where("n > 1")
    copies = scratch.write(copies.select("digest", "first_id"), "copies")
    copies = bounded(copies, copies.count())
    whole = (F.col("n_words") >= window) & (F.col("doc_id") > F.col("first_id"))
    base = all_.select("doc_id", "th", "digest", "n_words", "sha").join(copies, "digest", "left")
    base = scratch.write(base.select("doc_id", "th", "n_words", "sha", whole.alias("whole")), "base")
    takes_part = all_.join(copies, "digest", "left").where(F.coalesce(~whole, F.lit(True)) & F.col("doc_id").isNotNull() & (F.col("n_words") >= window))

    # level 0: minimizers that stand in two documents, and the documents that hold them
    anchors = takes_part.select("doc_id", "th", F.explode(F.array_distinct("anchors")).alias("a"))
    repeated = anchors.groupBy("a").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("a")
    repeated = scratch.write(repeated, "repeated")
    hits = anchors.join(repeated, "a", "left_semi").groupBy("doc_id", "th").agg(F.collect_list("a").alias("hits"))
    hits = scratch.write(hits, "hits")
    scratch.drop(repeated, all_)
    keyed = ["doc_id", "th"]
    ranges = None
    for k in range(1, len(lengths)):
        n, longs = hits.agg(F.count("*"), F.coalesce(F.sum(F.size("hits")), F.lit(0))).first()
        if not n:
            break
        last = k == len(lengths) - 1
        chosen = docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(hits) if longs + n <= BROADCAST_LONGS else hits, keyed)
        rows = scratch.write(extended(chosen, lengths[k - 1], lengths[k], k == 1, last), f"windows{lengths[k]}")
        if seen is not None:
            seen[lengths[k]] = rows.count()
        keys = ["h1", "h2"] if last else ["h1"]
        firsts = rows.groupBy(*keys).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
        firsts = scratch.write(firsts.select(*keys, "lo") if last else firsts.select(*keys), "firsts")
        before = hits
        if last:
            dups = rows.join(firsts, keys).where("doc_id > lo").groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("ps"))
            starts, ends = runs("ps", window)
            ranges = scratch.write(dups.select("doc_id", "th", starts.alias("starts"), ends.alias("ends")), "ranges")
        else:
            again = rows.join(firsts, keys, "left_semi").groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("pos")).alias("ps"))
            starts, ends = runs("ps", 1)
            packed = F.zip_with(starts, ends, lambda s, e: F.shiftleft(s.cast("long"), 32).bitwiseOR(e.cast("long")))
            hits = scratch.write(again.select("doc_id", "th", packed.alias("hits")), "hits")
        scratch.drop(rows, firsts, before)
    empty_sha = hashlib.sha256(b"").hexdigest()
    if ranges is None:
        out = base.withColumns({"n_removed": F.lit(None).cast("long"), "kept": F.lit(None).cast("string"), "kept_text": F.lit(None).cast("string")})
    else:
        n, longs = ranges.agg(F.count("*"), F.coalesce(F.sum(F.size("starts")), F.lit(0))).first()
        small = n + longs <= BROADCAST_LONGS
        chosen = docs.where(F.col("doc_id").isNotNull()).join(F.broadcast(ranges) if small else ranges, keyed)
        cut = scratch.write(without(chosen, texts), "cut")
        size = cut.agg(F.sum(F.octet_length("kept_text") + 100)).first()[0] if texts else 100 * n
        cut = cut.dropDuplicates(keyed)
        out = base.join(bounded(cut, size or 0, BROADCAST_BYTES), keyed, "left")
        if not texts:
            out = out.withColumn("kept_text", F.lit(None).cast("string"))
    gone = F.coalesce("whole", F.lit(False))
    out = out.select(
        "doc_id", "n_words",
        F.when(gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(gone, F.lit(empty_sha)).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(gone, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )
    return out if texts else out.drop("kept_text")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return substring_dedup(docs)


OP9_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT k, min(doc_id) AS m FROM p GROUP BY k HAVING min(doc_id) < max(doc_id)),
s AS (SELECT p.doc_id, p.i FROM p JOIN f USING (k) WHERE p.doc_id > f.m),
x AS (SELECT doc_id, unnest(generate_series(1, len(w))) AS i, unnest(w) AS word FROM d),
c AS (SELECT x.doc_id, x.i, x.word, max(CASE WHEN s.i IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY x.doc_id ORDER BY x.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone
  FROM x LEFT JOIN s ON s.doc_id = x.doc_id AND s.i = x.i),
a AS (SELECT doc_id, sum(gone)::BIGINT AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (WHERE gone = 0) AS kept FROM c GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN a USING (doc_id)
"""
