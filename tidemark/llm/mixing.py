"""Mixing to target weights with soft membership.

A softmax classifier, fitted on the driver on a bounded sample of a labelled table (``SAMPLE`` rows, by hash of the
identifier), gives every document posteriors over domains from the hashed presence of its pre-tokens. Posteriors are
given to four decimals, and rows of equal posteriors are a cell with the sum of their tokens. Nonnegative rates r then
minimise

    1/2 sum_k (sum_i r_i a_ik - target_k)^2 + MU/2 sum_i a_i (r_i - 1)^2,   a_ik = tokens_i posterior_ik / all tokens

by accelerated projected gradient. A row's step depends on its own posteriors and on the residual of each domain
alone, so its rate is that of its cell, and what a round sends to the driver and back is one number a domain: a task
replays the residuals so far over its cells (numpy, a few operations a round) and returns its partial totals. Rates
are never gathered, and texts are read once.

With an anchor the documents whose likeliest domain it is have rate 1; the targets hold in proportion to that domain,
and the rates of all others are fitted to them, up as well as down.

Rates turn into whole copies: the integer part, and one more if a hash of the identifier is under the rest, so
that the tokens of the copies meet, in expectation, the targets that the rates meet. Nothing is rounded to 1.

Defined cases: a null text has no tokens; a row without identifier is scored like others; labels outside the
domains teach nothing; with fewer than two labelled domains every posterior is equal and every rate 1; targets of
domains that no label names are left out, and a domain without a target has target 0; targets that cannot be met, or
are not within ``ROUNDS`` rounds, are approached in least squares and a RuntimeWarning names them; repeated rows are
rows like others; rows that share identifier and text have equal copies; a very long text is read whole, in its own
batch; an empty table gives no rows; other columns, whatever their names, are kept as they came.
"""

from __future__ import annotations

import warnings
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, bounded, factory, free, map_arrow, plain, prepare, small_batches

SAMPLE, BUCKETS, TELLING = 10_000, 1 << 14, 1_000
MU, ROUNDS, DECIMALS = 1e-5, 100, 4
#: A target is met within CLOSE of all tokens and within NEAR of itself.
CLOSE, NEAR = 1e-4, 5e-3
#: Shares of tokens that the mix shall have.
TARGETS = {"good": 0.90, "poor": 0.06, "toxic": 0.04}


def domain_of(quality: Column, toxic: Column) -> Column:
    """Domain of a row of the labels table."""
    return F.when(toxic == 1, "toxic").when(quality == 0, "poor").when(quality == 1, "good")


class Features:
    """Token counts and hashed pre-token presence; pre-tokens already met are remembered."""

    def __init__(self, vocabulary: str):
        from tidemark.llm.tokens import word_encoder

        self.encoder = word_encoder(vocabulary)
        self.generation, self.bucket = -1, np.zeros(0, np.int32)

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, list[np.ndarray]]:
        """Token count of each text, and its distinct buckets."""
        e = self.encoder
        numbers = e.numbers(texts)
        if self.generation != e.generation:
            self.generation, self.bucket = e.generation, self.bucket[:0]
        new = e.known.order[len(self.bucket) :]
        self.bucket = np.concatenate([self.bucket, np.array([zlib.crc32(w.encode()) % BUCKETS for w in new], np.int32)])
        tokens, buckets = np.zeros(len(texts), np.int64), []
        for i, at in enumerate(numbers):
            if at is None:
                tokens[i] = len(e.encode_whole(texts[i]))
                found = np.array([zlib.crc32(w.encode("utf-8", "replace")) % BUCKETS for w in e.PIECES.findall(texts[i].lower())], np.int64)
            else:
                tokens[i] = (e.starts[at + 1] - e.starts[at]).sum()
                found = self.bucket[at]
            seen = np.zeros(BUCKETS, bool)
            seen[found] = True
            buckets.append(np.flatnonzero(seen))
        return tokens, buckets


class Softmax:
    """Multinomial logistic regression over hashed presence, on the ``TELLING`` buckets that tell domains apart best."""

    def __init__(self, domains: list[str], weights: np.ndarray, bias: np.ndarray):
        self.domains, self.weights, self.bias = domains, weights, bias

    @staticmethod
    def fit(buckets: list[np.ndarray], y: list[str], rounds: int = 120, rate: float = 0.05, l2: float = 1e-4, telling: int = TELLING) -> Softmax:
        domains = sorted(set(y))
        k, n = len(domains), len(y)
        weights = np.zeros((BUCKETS, max(k, 1)))
        if k < 2:
            return Softmax(domains, weights, np.zeros(max(k, 1)))
        target = np.eye(k)[[domains.index(v) for v in y]]
        share = target.mean(0)
        col, row = np.concatenate(buckets), np.repeat(np.arange(n), [len(x) for x in buckets])
        # chi-square of presence against domain
        seen = np.stack([np.bincount(col, target[row, j], BUCKETS) for j in range(k)], 1)
        expected = np.maximum(seen.sum(1, keepdims=True) * share, 1e-9)
        kept = np.argsort(-((seen - expected) ** 2 / expected).sum(1), kind="stable")[:telling]
        number = np.full(BUCKETS, -1)
        number[kept] = np.arange(len(kept))
        fine = number[col] >= 0
        col, row = number[col[fine]], row[fine]
        w, b = np.zeros((len(kept), k)), np.log(share)
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), np.zeros(k), np.zeros(k)
        for step in range(1, rounds + 1):
            z = np.stack([np.bincount(row, w[col, j], n) for j in range(k)], 1) + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            d = (p - target) / n
            g = np.stack([np.bincount(col, d[row, j], len(kept)) for j in range(k)], 1) + l2 * w
            gb = d.sum(0)
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
            c1, c2 = 1 - 0.9**step, 1 - 0.999**step
            w -= rate * (m / c1) / (np.sqrt(v / c2) + 1e-8)
            b = b - rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-8)
        weights[kept] = w
        return Softmax(domains, weights, b)

    def posteriors(self, buckets: list[np.ndarray]) -> np.ndarray:
        if len(self.domains) < 2:
            return np.ones((len(buckets), 1))
        size = np.array([len(x) for x in buckets], np.int64)
        z = np.zeros((len(buckets), len(self.domains)))
        if size.sum():
            col, row = np.concatenate(buckets), np.repeat(np.arange(len(size)), size)
            for j in range(z.shape[1]):
                z[:, j] = np.bincount(row, self.weights[col, j], len(size))
        z += self.bias
        p = np.exp(z - z.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def fit_domains(docs: DataFrame, labelled: DataFrame, vocabulary: str, most: int = SAMPLE) -> Softmax:
    """labelled: doc_id, domain. At most ``most`` rows reach the driver, as bucket numbers."""
    prepare(docs.sparkSession)
    y = labelled.where("doc_id is not null and domain is not null").groupBy("doc_id").agg(F.min("domain").alias("y"))
    y = y.select(F.col("doc_id").cast("long").alias("id"), "y").join(docs.select(F.col("doc_id").cast("long").alias("id")), "id", "left_semi")
    ids = y.orderBy(F.xxhash64("id"), "id").limit(most)
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(ids), "id")  # at most SAMPLE ids

    @factory
    def start():
        features = Features(vocabulary)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            _, buckets = features.of(b.column("text").to_pylist())
            return pa.RecordBatch.from_arrays([b.column("id"), b.column("y"), pa.array(buckets, pa.list_(pa.int32()))], names=["id", "y", "buckets"])

        return step

    # bucket numbers before the exchange: no texts are sent; of rows that share an identifier, one teaches
    one = map_arrow(rows, start, "id long, y string, buckets array<int>").groupBy("id", "y").agg(F.min("buckets").alias("buckets"))
    with small_batches(docs.sparkSession):
        got = one.toArrow().sort_by("id")
    return Softmax.fit([np.array(x, np.int64) for x in got.column("buckets").to_numpy()], got.column("y").to_pylist())


def exposed(docs: DataFrame, model: Softmax, vocabulary: str) -> DataFrame:
    """doc_id, row, th (hash of the text), tokens, p (posteriors in the order of model.domains, to DECIMALS places)."""
    prepare(docs.sparkSession)
    parts = (model.domains, model.weights.astype(np.float32), model.bias)

    @factory
    def start():
        features, own = Features(vocabulary), Softmax(*parts)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            tokens, buckets = features.of(b.column("text").to_pylist())
            p = own.posteriors(buckets).round(DECIMALS)
            best = (np.arange(len(p)), p.argmax(1))
            p[best] = (p[best] + 1 - p.sum(1)).round(DECIMALS)  # the largest takes what rounding leaves
            lists = pa.FixedSizeListArray.from_arrays(pa.array(p.ravel()), p.shape[1]).cast(pa.list_(pa.float64()))
            return pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("row"), b.column("th"), pa.array(tokens), lists], names=["doc_id", "row", "th", "tokens", "p"])

        return step

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row"), text_hash("text").alias("th"))
    return map_arrow(rows, start, "doc_id long, row long, th long, tokens long, p array<double>")


def text_hash(text: str) -> Column:
    return F.coalesce(F.xxhash64(text), F.lit(0))


class Steps:
    """Replays the accelerated projected gradient: constant step and momentum, and the residual of each round."""

    def __init__(self, gram: np.ndarray, mu: float = MU, anchor: int | None = None):
        self.anchor = anchor
        values = np.linalg.eigvalsh(gram)
        self.mu, self.step = mu, 1 / (max(values[-1], 1e-12) + mu)
        root = np.sqrt(min(1.0, (max(values[0], 0.0) / 2 + mu) * self.step))  # half: rates at zero bend the sum less
        self.momentum = (1 - root) / (1 + root)
        self.residuals: list[np.ndarray] = []
        self.missed = np.zeros(len(gram))

    def rates(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rates after all rounds so far, and the point where the next residual is taken."""
        rate, point = np.ones(len(p)), np.ones(len(p))
        able = np.arange(len(p)) if self.anchor is None else np.flatnonzero(p.argmax(1) != self.anchor)
        p, r, y = p[able], rate[able], rate[able]
        for e in self.residuals:
            new = np.maximum(0.0, y - self.step * (p @ e + self.mu * (y - 1)))
            y = new + self.momentum * (new - r)
            r = new
        rate[able], point[able] = r, y
        return rate, point


def _sums(rows: DataFrame, width: int, sums) -> np.ndarray:
    """The sum over all rows of sums(p, tokens), a vector of ``width`` numbers; a task sends one row."""

    def run(batches):
        here = np.zeros(width)
        for b in batches:
            if b.num_rows:
                here += sums(b.column("p").flatten().to_numpy().reshape(b.num_rows, -1), b.column("tokens").to_numpy().astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(here)], names=["k", "v"])

    got = rows.select("tokens", "p").mapInArrow(run, "k long, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()
    out = np.zeros(width)
    for x in got:
        out[x["k"]] = x["v"]
    return out


def cells_of(rows: DataFrame) -> DataFrame:
    """(tokens, p): the tokens of all rows that have these posteriors, aggregated in each task first."""
    return rows.groupBy("p").agg(F.sum("tokens").cast("double").alias("tokens")).select("tokens", "p")


def fit_rates(rows: DataFrame, shares: np.ndarray, mu: float = MU, rounds: int = ROUNDS, close: float = CLOSE, anchor: int | None = None) -> Steps | None:
    """shares: target of each domain as a part of all tokens (they may sum to any total). rows: tokens, p.

    ``missed`` of the result is what each domain has over its target, or 0 where the target is met.
    """
    k = len(shares)

    def gram(p, t):
        free_ = t if anchor is None else np.where(p.argmax(1) == anchor, 0.0, t)  # what no rate moves bends nothing
        return np.append(((p * free_[:, None]).T @ p).ravel(), t.sum())

    first = _sums(rows, k * k + 1, gram)
    total = first[-1]
    if not total or k < 2:
        return None
    within = np.where(shares > 0, np.minimum(close, NEAR * shares), close)
    # the pull towards 1 moves a total by mu * (1 - r): less than the least tolerance
    steps = Steps(first[:-1].reshape(k, k) / total, min(mu, within.min() / 2), anchor)
    still = 0
    for left in range(rounds, -1, -1):

        def both(p, t, steps=steps):
            r, y = steps.rates(p)
            return np.concatenate([(t * r) @ p, (t * y) @ p])

        at = _sums(rows, 2 * k, both) / total
        over = at[:k] - shares
        steps.missed = np.where(np.abs(over) > within, over, 0.0)
        if steps.residuals and not steps.missed.any():
            break
        e = at[k:] - shares
        # one small move may be the turn of a swing
        still = still + 1 if steps.residuals and np.abs(steps.residuals[-1] - e).max() < within.min() / 100 else 0
        if still == 3 or not left:
            break
        steps.residuals.append(e)
    return steps


def rated(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], vocabulary: str, anchor: str | None = None, most: int = SAMPLE) -> DataFrame:
    """doc_id, row, th, tokens, domain (likeliest), posterior (its own), rate, copies, p: a row for each row of docs.

    The mix has as many tokens as docs. With an anchor the anchored domain's documents are taken once, and the others
    as often as their targets in proportion to that domain ask.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mixing")
    model = fit_domains(docs, labelled, vocabulary, most)
    rows = scratch.write(exposed(docs, model, vocabulary), "exposed")
    domains = model.domains
    steps = None
    if len(domains) >= 2:
        want = np.array([max(0.0, targets.get(d, 0.0)) for d in domains])
        if want.sum() > 0:
            want, j = want / want.sum(), domains.index(anchor) if anchor in domains else None
            cells = scratch.write(cells_of(rows), "cells")
            if j is not None and want[j] > 0:
                natural = cells.agg(F.sum(F.col("tokens") * F.col("p")[j]) / F.sum("tokens")).first()[0]
                want = want * (natural or 0.0) / want[j]
            steps = fit_rates(cells, want, anchor=j)
            if steps and steps.missed.any():
                missed = ", ".join(f"{d} {w:.6f} by {m:+.6f}" for d, w, m in zip(domains, want, steps.missed, strict=True) if m)
                warnings.warn(f"mixing: targets not met after {len(steps.residuals)} rounds: {missed}", RuntimeWarning, stacklevel=2)

    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        p = b.column("p").flatten().to_numpy().reshape(b.num_rows, -1)
        r = steps.rates(p)[0] if steps else np.ones(len(p))
        best = p.argmax(1)
        names = [domains[k] if domains else None for k in best]
        given = [b.column(c) for c in ("doc_id", "row", "th", "tokens", "p")]
        return pa.RecordBatch.from_arrays([*given, pa.array(names, pa.string()), pa.array(p[np.arange(len(p)), best]), pa.array(r)], names=["doc_id", "row", "th", "tokens", "p", "domain", "posterior", "rate"])

    out = map_arrow(rows, step, "doc_id long, row long, th long, tokens long, p array<double>, domain string, posterior double, rate double")
    whole = F.floor(F.col("rate"))
    dice = F.pmod(F.xxhash64(F.coalesce("doc_id", "th"), F.lit("mix")), F.lit(1 << 40)) / float(1 << 40)
    out = out.withColumn("copies", (whole + (dice < F.col("rate") - whole).cast("int")).cast("int"))
    out = scratch.write(out, "rated")
    out.domains = domains
    return out


def achieved(rates: DataFrame, domains: list[str]) -> DataFrame:
    """(domain, by_rates, by_copies, as_it_was): shares of tokens of a rated table, counted softly by posteriors."""
    soft = rates.select("tokens", "rate", "copies", F.posexplode("p").alias("k", "q"))
    sums = soft.groupBy("k").agg(*[F.sum(F.col("tokens") * F.col("q") * w).alias(c) for c, w in (("by_rates", F.col("rate")), ("by_copies", F.col("copies")), ("as_it_was", F.lit(1)))])
    names = F.array(*[F.lit(d) for d in domains])
    total = rates.agg(F.sum(F.col("tokens") * F.col("rate")).alias("r"), F.sum(F.col("tokens") * F.col("copies")).alias("c"), F.sum("tokens").alias("t")).first()
    share = lambda c, n: (F.col(c) / F.lit(float(n or 1))).alias(c)
    return sums.select(names[F.col("k")].alias("domain"), share("by_rates", total["r"]), share("by_copies", total["c"]), share("as_it_was", total["t"]))


def mixed(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], vocabulary: str, anchor: str | None = None) -> DataFrame:
    """docs with each row as many times as its rate gives; all columns as they came."""
    scratch = Scratch(docs.sparkSession, "mixed")
    id_, th, copies, turn = free(docs, "id", "th", "copies", "turn")
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    rates = rated(docs, labelled, targets, vocabulary, anchor)
    # rows that share identifier and text share posteriors and dice, so their copies are equal
    other = rates.where("copies <> 1").groupBy(key.alias(id_), F.col("th").alias(th)).agg(F.max("copies").alias(copies))
    other = scratch.write(other, "other")
    both = docs.withColumns({id_: key, th: text_hash("text")}).join(bounded(other, other.count()), [id_, th], "left")
    times = F.explode(F.array_repeat(F.lit(1), F.coalesce(copies, F.lit(1))))
    return both.select(*plain(docs), times.alias(turn)).drop(turn)


def op4(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    labelled = labels.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    out = rated(docs, labelled, TARGETS, vocabulary or public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "tokens", "domain", "posterior", "rate", "copies")
