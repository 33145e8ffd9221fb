"""Language ID by segmentation-marginalised unigrams over a fixed public vocabulary.

A word's probability under a language is the sum, over all ways to cut it into vocabulary pieces, of the product of
the pieces' probabilities: the forward algorithm. Words (runs of letters, lower-cased, with the piece vocabulary's
word mark) are cut apart first and pieces never span words, so a text's log-probability is the sum over its words.
Piece probabilities per language come from expectation-maximisation (forward and backward) over word counts of a
bounded sample: at most ``DOCS`` texts a language, by hash of the identifier, and their ``WORDS`` most frequent words
of up to ``LONGEST`` letters. Words are scored in numpy, all of one length together; a bounded table remembers scored
words. Longer runs of letters (languages without spaces) are scored whole too, character by character with the sums
rescaled, so that neither length nor underflow leaves a segmentation out.

Letters are what Unicode calls letters (``str.isalpha``); fractions, superscripts and Roman numeral signs are not.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a letter outside the vocabulary costs a
small constant in every language; texts without a language teach nothing; of more than ``LANGUAGES`` languages the
most frequent are learnt; if nothing teaches, every text is ``und``; ties go to the first language by name; very long
texts are read whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter, deque

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, factory, held_out, map_arrow, prepare, small_batches

DOCS, WORDS, LONGEST, LANGUAGES = 800, 40_000, 32, 1000
ROUNDS, FLOOR, UNKNOWN = 4, 1e-8, 1e-9
REMEMBERED = 300_000
LETTERS = regex.compile(r"\p{L}+")
MARK = "▁"


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall((text or "").lower())


def vocabulary_pieces(path: str) -> list[str]:
    """Lower-case letter pieces (with or without the word mark) of a sentencepiece vocabulary."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {model.id_to_piece(i) for i in range(model.get_piece_size())}
    fine = {p for p in pieces if p and (p == MARK or p.removeprefix(MARK).isalpha()) and p == p.lower()}
    return sorted(fine)


class Lattice:
    """Finds the vocabulary pieces in words of one length: a direct-address table of substring hashes."""

    _A, _BITS = np.uint64(0x9E3779B97F4A7C15), 20

    def __init__(self, pieces: list[str]):
        self.pieces, self.unknown = pieces, len(pieces)
        self.longest = max(map(len, pieces), default=1)
        self.slots = np.full(1 << self._BITS, -1, np.int32)
        self.keys = np.zeros(len(pieces), np.uint64)
        self.next = np.full(len(pieces) + 1, -1, np.int32)  # pieces that share a slot
        for i, p in enumerate(pieces):
            h = np.uint64(0)
            for c in p:
                h = self._push(h, np.array([ord(c)], np.uint32))[0]
            self.keys[i] = h
            slot = int(h >> np.uint64(64 - self._BITS))
            self.next[i], self.slots[slot] = self.slots[slot], i

    def _push(self, h, codes):
        with np.errstate(over="ignore"):
            return (h ^ codes.astype(np.uint64)) * self._A + np.uint64(0x632BE59BD9B4E019)

    def of(self, words: list[str]) -> list[list[np.ndarray]]:
        """at[j][k]: for each word, the piece on characters j-k-1 .. j, or ``unknown``; all words of one length."""
        codes = np.array([MARK + w for w in words]).view(np.uint32).reshape(len(words), -1)
        size = codes.shape[1]
        at: list[list[np.ndarray]] = [[] for _ in range(size)]
        for i in range(size):
            h = np.zeros(len(words), np.uint64)
            for j in range(i, min(size, i + self.longest)):
                h = self._push(h, codes[:, j])
                found = self.slots[(h >> np.uint64(64 - self._BITS)).astype(np.int64)]
                while True:  # down the chain where the slot holds another piece
                    wrong = (found >= 0) & (self.keys[found] != h)
                    if not wrong.any():
                        break
                    found = np.where(wrong, self.next[found], found)
                at[j].append(np.where(found < 0, self.unknown, found))
        # at[j] is filled in the order of the start i: turn it so that k counts backwards
        return [x[::-1] for x in at]


def forward(at: list[list[np.ndarray]], p: np.ndarray) -> list[np.ndarray]:
    """alpha[j]: probability of the first j characters; p: (pieces + 1) x languages, the last row zero."""
    n = len(at[0][0])
    alpha = [np.ones((n, p.shape[1]))]
    for j, ends in enumerate(at):
        total = alpha[j] * UNKNOWN
        for k, piece in enumerate(ends):
            if (piece != p.shape[0] - 1).any():
                total = total + alpha[j - k] * p[piece]
        alpha.append(total)
    return alpha


class Unigrams:
    """Piece probabilities of each language, and word scores under them."""

    def __init__(self, languages: list[str], p: np.ndarray, lattice: Lattice):
        self.languages, self.p, self.lattice = languages, p, lattice
        self.known: dict[str, int] = {}
        self.number: dict[str, int] | None = None
        self.scores = np.zeros((0, len(languages)))

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-probabilities, words x languages."""
        out = np.zeros((len(words), len(self.languages)))
        by_size: dict[int, list[int]] = {}
        for i, w in enumerate(words):
            if len(w) > LONGEST:
                out[i] = self.long_score(w)
            else:
                by_size.setdefault(len(w), []).append(i)
        for where in by_size.values():
            for cut in range(0, len(where), 4000):
                part = where[cut : cut + 4000]
                out[part] = np.log(np.maximum(forward(self.lattice.of([words[i] for i in part]), self.p)[-1], 1e-300))
        return out

    def long_score(self, word: str) -> np.ndarray:
        """Log-probabilities of a run of any length: a window of sums, rescaled at each character."""
        if self.number is None:
            self.number = {x: i for i, x in enumerate(self.lattice.pieces)}
        get, longest, text = self.number.get, self.lattice.longest, MARK + word
        sums, log = deque([np.ones(len(self.languages))], maxlen=longest), np.zeros(len(self.languages))
        for j in range(1, len(text) + 1):
            total = sums[-1] * UNKNOWN
            for k in range(1, min(longest, j) + 1):
                if (at := get(text[j - k : j])) is not None:
                    total = total + sums[-k] * self.p[at]
            sums.append(total)
            if not j % 8:
                log += np.log(total)
                for i, x in enumerate(sums):
                    sums[i] = x / total
        return log + np.log(sums[-1])

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        split = [words_of(t) for t in texts]
        if not self.languages:
            return [("und", 0.0)] * len(texts)
        if len(self.known) > REMEMBERED:
            self.known, self.scores = {}, self.scores[:0]
        known = self.known
        new = list(dict.fromkeys(w for s in split for w in s if w not in known))
        if new:
            for w in new:
                known[w] = len(known)
            self.scores = np.concatenate([self.scores, self.word_scores(new)])
        out = []
        for s in split:
            if not s:
                out.append(("und", 0.0))
                continue
            total = self.scores[[known[w] for w in s]].sum(0)
            best = int(total.argmax())
            out.append((self.languages[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())))
        return out


def learn(counts: dict[str, Counter], pieces: list[str]) -> Unigrams:
    """Expectation-maximisation of piece probabilities, from word counts of each language."""
    languages, lattice = sorted(counts), Lattice(pieces)
    p = np.zeros((len(pieces) + 1, len(languages)))
    start = np.ones(len(pieces))
    for k, lang in enumerate(languages):
        words = [(w, c) for w, c in counts[lang].most_common(WORDS) if len(w) <= LONGEST]
        by_size: dict[int, list[tuple[str, int]]] = {}
        for w, c in sorted(words):
            by_size.setdefault(len(w), []).append((w, c))
        groups = [(lattice.of([w for w, _ in g]), np.array([c for _, c in g], np.float64)) for _, g in sorted(by_size.items())]
        q = np.append(start / start.sum(), 0.0)[:, None]
        for _ in range(ROUNDS):
            expected = np.zeros(len(pieces) + 1)
            for at, weight in groups:
                alpha = forward(at, q)
                beta = [None] * len(at) + [np.ones_like(alpha[0])]
                for i in range(len(at) - 1, -1, -1):
                    total = beta[i + 1] * UNKNOWN
                    for j in range(i, min(len(at), i + lattice.longest)):
                        total = total + beta[j + 1] * q[at[j][j - i]]
                    beta[i] = total
                scale = (weight / np.maximum(alpha[-1][:, 0], 1e-300))[:, None]
                for j, ends in enumerate(at):
                    for back, piece in enumerate(ends):
                        expected += np.bincount(piece, (alpha[j - back] * q[piece] * beta[j + 1] * scale)[:, 0], len(expected))
            expected[-1] = 0
            smooth = expected[:-1] + 0.01
            q = np.append(np.maximum(smooth / smooth.sum(), FLOOR), 0.0)[:, None]
        p[:, k] = q[:, 0]
    return Unigrams(languages, p, lattice)


def sample_counts(docs: DataFrame, most: int = DOCS) -> dict[str, Counter]:
    """Word counts of at most ``most`` texts a language that are not held out."""
    prepare(docs.sparkSession)
    able = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    # the first of each language by hash: a threshold from the counts first, so that no window sees all rows
    share = F.least(F.lit(1.0), 1.5 * most / F.col("total"))
    near = able.groupBy("lang").agg(F.count("*").alias("total")).orderBy(F.desc("total"), "lang").limit(LANGUAGES).select("lang", (share * (1 << 30)).alias("under"))
    able = able.join(F.broadcast(near), "lang")  # at most LANGUAGES rows
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    ids = able.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) <= F.col("under")).select("lang", "doc_id").distinct()
    ids = ids.withColumn("r", F.row_number().over(order)).where(F.col("r") <= most).select("lang", "doc_id")
    # at most DOCS identifiers a language; of rows that share one, the least text teaches
    picked = able.join(F.broadcast(ids), ["lang", "doc_id"]).groupBy("lang", "doc_id").agg(F.min("text").alias("text")).select("lang", "text")

    def step(b: pa.RecordBatch) -> pa.RecordBatch:
        got: dict[str, Counter] = {}
        for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist(), strict=True):
            got.setdefault(lang, Counter()).update(words_of(text))
        rows = [(lang, w, c) for lang, words in got.items() for w, c in words.items()]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())], names=["lang", "w", "c"])

    counts = map_arrow(picked, step, "lang string, w string, c long").groupBy("lang", "w").agg(F.sum("c").alias("c"))
    ranked = counts.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("c"), "w"))).where(F.col("r") <= WORDS)
    out: dict[str, Counter] = {}
    with small_batches(docs.sparkSession):
        t = ranked.select("lang", "w", "c").toArrow()
    for lang, w, c in zip(t.column("lang").to_pylist(), t.column("w").to_pylist(), t.column("c").to_pylist(), strict=True):
        out.setdefault(lang, Counter())[w] += c
    return out


def identify(docs: DataFrame, counts: dict[str, Counter], vocabulary: str) -> DataFrame:
    """doc_id, lang_pred, score of every whole text."""
    prepare(docs.sparkSession)
    pieces = vocabulary_pieces(vocabulary)
    model = learn(counts, pieces)
    languages, p = model.languages, model.p.astype(np.float32)

    @factory
    def start():
        own = Unigrams(languages, p.astype(np.float64), Lattice(vocabulary_pieces(vocabulary)))

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            got = own.predict(b.column("text").to_pylist())
            return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x for x, _ in got], pa.string()), pa.array([s for _, s in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

        return step

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = map_arrow(docs.select("doc_id", "text"), start, f"doc_id {kind}, lang_pred string, score double")
    return Scratch(docs.sparkSession, "language").write(found, "identified")


def op5(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    out = identify(docs, sample_counts(docs), vocabulary or public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
