"""Quality classifier: histogram gradient-boosted trees over document statistics.

Statistics are computed from whole texts in Arrow batches. The trees are fitted on the driver with numpy on a
bounded sample of labelled rows (``SAMPLE`` rows, by hash of the identifier) and flattened into arrays: full binary
trees in heap order, which a batch walks level by level for all rows and trees at once.

Defined cases: a null text counts as empty and is scored as such; unlabelled rows, and labels other than 0 and 1,
teach nothing; of several labels of one identifier the smallest counts; without labels of both kinds every score is
the share of label 1 (0.5 without any); an empty table gives no rows; repeated rows are scored alike; very long texts
are read whole, in a batch of their own; other columns, whatever their names, come as they were.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm.common import Scratch, factory, held_out, map_arrow, plain, prepare, small_batches

#: Labelled rows that a fit takes at most.
SAMPLE = 20_000
STATS = (
    "log_words", "log_chars", "word_len", "word_len_sd", "upper", "lower", "digit", "space", "stop", "shout", "bar",
    "symbol", "non_ascii", "control", "distinct_words", "distinct_lines", "line_words", "symbol_ends", "upper_words", "byte_entropy",
)

_KIND = np.full(256, 7, np.int64)  # 0 upper, 1 lower, 2 digit, 3 space, 4 .,;:'"-()?, 5 !, 6 |, 7 other symbol, 8 non-ASCII, 9 control
_KIND[:32], _KIND[127], _KIND[128:] = 9, 9, 8
_KIND[65:91], _KIND[97:123], _KIND[48:58] = 0, 1, 2
_KIND[[9, 10, 11, 12, 13, 32]] = 3
_KIND[list(b".,;:'\"-()?")] = 4
_KIND[ord("!")], _KIND[ord("|")] = 5, 6
_ENDS = (*b"!|", *(b for b in range(33, 127) if _KIND[b] == 7))


def stats_of(text: str | None) -> list[float]:
    """Statistics of one text, in the order of STATS."""
    raw = (text or "").encode("utf-8", "replace")
    if not raw:
        return [0.0] * len(STATS)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    kinds = np.bincount(_KIND, weights=counts, minlength=10) / len(raw)
    words = raw.split()
    n = max(1, len(words))
    sizes = np.fromiter(map(len, words), np.float64, len(words)) if words else np.zeros(1)
    ends = sum(w[-1] in _ENDS for w in words) / n
    upper = sum(w.isupper() and len(w) > 1 for w in words) / n
    lines = [x for x in raw.split(b"\n") if x.strip()]
    p = counts[counts > 0] / len(raw)
    return [
        np.log1p(len(words)), np.log1p(len(raw)), sizes.mean(), sizes.std(), *kinds[:10],
        len(set(words)) / n, len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), ends, upper, float(-(p * np.log2(p)).sum()),
    ]


def stats_batch(texts: list[str | None]) -> np.ndarray:
    return np.array([stats_of(t) for t in texts], np.float64).reshape(len(texts), len(STATS))


class Trees:
    """Boosted trees of equal depth: split features and thresholds in heap order, then leaf values."""

    def __init__(self, base: float, feature: np.ndarray, threshold: np.ndarray, leaf: np.ndarray):
        self.base, self.feature, self.threshold, self.leaf = base, feature, threshold, leaf

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, bins: int = 64, rate: float = 0.15, l2: float = 0.3, least: float = 0.3) -> Trees:
        n, d = x.shape if len(x) else (0, len(STATS))
        share = float(y.mean()) if n else 0.5
        inner, leaves = 2**depth - 1, 2**depth
        if n == 0 or share in (0.0, 1.0):
            share = min(max(share, 0.01), 0.99)
            return Trees(float(np.log(share / (1 - share))), np.zeros((0, inner), np.int32), np.zeros((0, inner)), np.zeros((0, leaves)))
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(d)])  # bin <= k: x <= edge k
        base = float(np.log(share / (1 - share)))
        score = np.full(n, base)
        feature, threshold, leaf = np.zeros((trees, inner), np.int32), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
        for t in range(trees):
            p = 1 / (1 + np.exp(-score))
            g, h = p - y, p * (1 - p)
            node = np.zeros(n, np.int64)
            for level in range(depth):
                width = 2**level
                at = node * bins
                total_g, total_h = np.bincount(node, g, width), np.bincount(node, h, width)
                gain = np.full((width, d, bins), -1.0)
                for j in range(d):
                    key = at + binned[j]
                    lg = np.bincount(key, g, width * bins).reshape(width, bins).cumsum(1)
                    lh = np.bincount(key, h, width * bins).reshape(width, bins).cumsum(1)
                    rg, rh = total_g[:, None] - lg, total_h[:, None] - lh
                    ok = (lh >= least) & (rh >= least)
                    ok[:, len(edges[j]):] = False
                    gain[:, j] = np.where(ok, lg**2 / (lh + l2) + rg**2 / (rh + l2) - (total_g**2 / (total_h + l2))[:, None], -1.0)
                best = gain.reshape(width, -1).argmax(1)
                good = gain.reshape(width, -1).max(1) > 1e-9
                f, b = best // bins, best % bins
                place = width - 1 + np.arange(width)
                feature[t, place] = np.where(good, f, 0)
                threshold[t, place] = [edges[fj][bj] if ok else np.inf for fj, bj, ok in zip(f, b, good, strict=True)]
                right = good[node] & (binned[f[node], np.arange(n)] > b[node])
                node = 2 * node + right
            value = -rate * np.bincount(node, g, leaves) / (np.bincount(node, h, leaves) + l2)
            leaf[t] = value
            score += value[node]
        return Trees(base, feature, threshold, leaf)

    def predict(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of label 1; all trees of all rows go down a level together."""
        trees, inner = self.feature.shape
        if not trees or not len(x):
            return np.full(len(x), 1 / (1 + np.exp(-self.base)))
        depth, rows, each = int(np.log2(inner + 1)), np.arange(len(x))[:, None], np.arange(trees)[None, :]
        node = np.zeros((len(x), trees), np.int64)
        for level in range(depth):
            place = 2**level - 1 + node
            node = 2 * node + (x[rows, self.feature[each, place]] > self.threshold[each, place])
        return 1 / (1 + np.exp(-(self.base + self.leaf[each, node].sum(1))))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str = "quality", most: int = SAMPLE) -> DataFrame:
    """(id, y, text) of at most ``most`` labelled identifiers that are not held out: the first by hash."""
    y = labels.where(F.col(column).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min(column).alias("y"))
    ids = y.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).select(F.col("doc_id").cast("long").alias("id"), F.col("y").cast("int").alias("y"))
    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids), "id")  # at most SAMPLE ids


def fit(docs: DataFrame, labels: DataFrame, most: int = SAMPLE, **params) -> Trees:
    prepare(docs.sparkSession)

    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        x = stats_batch(b.column("text").to_pylist())
        return pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), *(pa.array(c) for c in x.T)], names=["id", "y", *STATS])

    rows = labelled_sample(docs, labels, most=most).select("id", "text", "y")
    # statistics before the exchange: no texts are sent; of rows that share an identifier, one teaches
    one = map_arrow(rows, step, "id long, y int, " + ", ".join(f"{s} double" for s in STATS)).groupBy("id", "y").agg(F.min(F.struct(*STATS)).alias("x"))
    with small_batches(docs.sparkSession):
        got = one.select("id", "y", "x.*").toArrow()
    got = got.sort_by("id")
    x = np.stack([got.column(s).to_numpy() for s in STATS], 1) if got.num_rows else np.zeros((0, len(STATS)))
    return Trees.fit(x, got.column("y").to_numpy().astype(np.float64), **params)


def score(docs: DataFrame, trees: Trees, out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """docs (or the columns to keep of it: a text that is not kept does not go back through Arrow) with a column of
    scores at the end. A column of that name must not be there already."""
    fields = [f for f in docs.schema.fields if keep is None or f.name in keep]
    if out in [f.name for f in fields]:
        raise ValueError(f"docs has a column {out}: name another")
    prepare(docs.sparkSession)
    parts, n = (trees.base, trees.feature, trees.threshold, trees.leaf), len(fields)
    names = [f"c{i}" for i in range(n)]  # the map takes no names with dots

    @factory
    def start():
        model = Trees(*parts)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            p = model.predict(stats_batch(b.column("text").to_pylist()))
            return pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(p)], names=[*names, "score"])

        return step

    own = [c.alias(name) for c, name in zip(plain([f.name for f in fields]), names, strict=True)]
    kinds = T.StructType([*(T.StructField(name, f.dataType) for name, f in zip(names, fields, strict=True)), T.StructField("score", T.DoubleType())])
    return map_arrow(docs.select(*own, F.col("text").alias("text")), start, kinds).toDF(*(f.name for f in fields), out)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    trees = fit(docs, labels)
    scored = Scratch(spark, "quality").write(score(docs, trees, keep=["doc_id"]), "scored")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
