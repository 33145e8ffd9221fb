"""Token counts that follow edits: a segment tree of pre-tokens for each document, kept in a table.

A document is cut into pre-tokens; runs of about ``RUN`` of them are the leaves of a balanced tree whose nodes hold
the token and character totals below them. An edit (start, end, replacement, in characters) re-encodes only the leaf
text it touches plus boundary context: splitting starts at a pre-token before the edit and goes on until a pre-token
ends where an old one ended behind the edit, from where on the old split holds. The changed leaves and their ancestors
are updated, the rest is kept. Leaves that an edit leaves too full or too empty are cut anew, and the sums above with
them.

Boundary context: pre-token patterns look back not at all and ahead by one pre-token (runs of letters, digits or
signs end at another class; white space gives its last character to what follows), so splitting restarts ``BACK``
pre-tokens before the edit, at a place behind which white space does not continue, and an old boundary is taken
over only where a pre-token that is not white space ends in both splits.

A stored tree is a row: the text, the characters of each pre-token, the pre-tokens and the tokens of each leaf.
``built`` makes that table from documents, and ``edited`` from a table of trees and a batch of edits, without counting
again what the edits leave alone: the sums come from the row, and only touched leaves are cut into pre-tokens.

Defined cases: a null text counts as empty; edits out of range are cut to the text; edits apply in order, each to
the result of those before; an empty table gives no rows; repeated rows are counted each, and edits of an identifier
hold for all its rows; edits of identifiers that no row has are ignored, and so are edits with a null; a very long text
is one row, in an Arrow batch of its own; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import Scratch, factory, map_arrow, prepare

RUN, BACK = 64, 3
#: Columns of a stored tree; the numbers are packed (a byte for their width, then unsigned little-endian).
TREE = "doc_id long, text string, piece_chars binary, leaf_pieces binary, leaf_tokens binary, n_tokens long"
Edits = Callable[[str], list[tuple[int, int, str]]]


def packed(x: np.ndarray) -> bytes:
    most = int(x.max(initial=0))
    width = 1 if most < 1 << 8 else 2 if most < 1 << 16 else 4
    return bytes([width]) + x.astype(f"<u{width}").tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"<u{raw[0]}", offset=1).astype(np.int64)


class CountTree:
    """Token count of a text under edits."""

    def __init__(self, encoder, text: str, chars: np.ndarray, pieces: np.ndarray, tokens: np.ndarray):
        """chars: of each pre-token; pieces and tokens: of each leaf."""
        self.encoder, self.encoded, self.rebuilt = encoder, 0, 0
        ends = np.cumsum(pieces)
        self.cuts = np.split(chars, ends[:-1]) if len(pieces) else [chars]
        upto = np.append(0, np.cumsum(chars))[np.append(0, ends)].tolist()
        self.leaves = [text[a:z] for a, z in zip(upto[:-1], upto[1:], strict=True)] or [""]
        self._sum(tokens if len(pieces) else np.zeros(1, np.int64))

    @classmethod
    def of_text(cls, text: str, encoder) -> CountTree:
        pieces = encoder.split(text)
        chars = np.fromiter(map(len, pieces), np.int64, len(pieces))
        at = np.arange(0, len(pieces), RUN)
        tokens = np.add.reduceat(encoder.sizes(pieces), at) if pieces else np.zeros(0, np.int64)
        return cls(encoder, text, chars, np.minimum(RUN, len(pieces) - at), tokens)

    @classmethod
    def stored(cls, text: str, piece_chars: bytes, leaf_pieces: bytes, leaf_tokens: bytes, encoder) -> CountTree:
        return cls(encoder, text, unpacked(piece_chars), unpacked(leaf_pieces), unpacked(leaf_tokens))

    def row(self) -> tuple[str, bytes, bytes, bytes, int]:
        """What a stored tree holds, in the order of TREE without the identifier."""
        leaf_pieces = np.array([len(x) for x in self.cuts], np.int64)
        return self.text(), packed(np.concatenate(self.cuts)), packed(leaf_pieces), packed(self.tokens[self.wide : self.wide + len(self.leaves)]), self.count()

    def _sum(self, tokens: np.ndarray) -> None:
        """All sums from the leaves."""
        n = len(self.leaves)
        self.wide = 1 << (n - 1).bit_length()
        self.tokens, self.chars = np.zeros(2 * self.wide, np.int64), np.zeros(2 * self.wide, np.int64)
        self.tokens[self.wide : self.wide + n] = tokens
        self.chars[self.wide : self.wide + n] = np.fromiter(map(len, self.leaves), np.int64, n)
        width = self.wide
        while width > 1:  # a level from the one below
            for tree in (self.tokens, self.chars):
                tree[width // 2 : width] = tree[width : 2 * width : 2] + tree[width + 1 : 2 * width : 2]
            width //= 2

    def count(self) -> int:
        return int(self.tokens[1])

    def text(self) -> str:
        return "".join(self.leaves)

    def pieces(self, leaf: int) -> list[str]:
        upto = np.cumsum(self.cuts[leaf]).tolist()
        return [self.leaves[leaf][a:z] for a, z in zip([0, *upto], upto, strict=False)]

    def _find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one at the text's end), and the characters before it."""
        node, before = 1, 0
        while node < self.wide:
            node *= 2
            if at >= before + self.chars[node] and before + self.chars[node] < self.chars[1]:
                before += int(self.chars[node])
                node += 1
        return min(node - self.wide, len(self.leaves) - 1), before

    def _put(self, first: int, last: int, pieces: list[str]) -> None:
        """These pre-tokens in place of leaves first to last: dealt evenly, or cut anew where leaves would be out of size."""
        old, n = last - first + 1, len(pieces)
        fits = (n <= 2 * RUN * old and (4 * n >= RUN * old or old == len(self.leaves) == 1))
        leaves = old if fits else max(1, -(-n // RUN))
        bounds = [n * k // leaves for k in range(leaves + 1)]
        parts = [pieces[a:z] for a, z in zip(bounds[:-1], bounds[1:], strict=True)]
        tokens = [int(self.encoder.sizes(p).sum()) for p in parts]
        self.leaves[first : last + 1] = ["".join(p) for p in parts]
        self.cuts[first : last + 1] = [np.fromiter(map(len, p), np.int64, len(p)) for p in parts]
        if leaves != old:
            below = self.tokens[self.wide : self.wide + len(self.leaves) + old - leaves]
            self._sum(np.concatenate([below[:first], tokens, below[last + 1 :]]))
            self.rebuilt += 1
            return
        for leaf, t in zip(range(first, last + 1), tokens, strict=True):
            node = self.wide + leaf
            self.tokens[node], self.chars[node] = t, len(self.leaves[leaf])
        low, high = (self.wide + first) // 2, (self.wide + last) // 2
        while low:
            for node in range(low, high + 1):
                self.tokens[node] = self.tokens[2 * node] + self.tokens[2 * node + 1]
                self.chars[node] = self.chars[2 * node] + self.chars[2 * node + 1]
            low, high = low // 2, high // 2

    def edit(self, start: int, end: int, new: str) -> None:
        size = int(self.chars[1])
        start = max(0, min(start, size))
        end = max(start, min(end, size))
        first, before = self._find(start)
        # back: leaves from which to split anew, until enough pre-tokens stand before the edit
        while first and self._ended(first, start - before) < BACK:
            first -= 1
            before -= len(self.leaves[first])
        last, _ = self._find(max(start, end - 1))
        old = [p for leaf in range(first, last + 1) for p in self.pieces(leaf)]
        # the split restarts at an old boundary, BACK pre-tokens before the edit and not inside white space
        ends = before + np.cumsum(np.fromiter(map(len, old), np.int64, len(old)))
        keep = max(0, int(np.searchsorted(ends, start, side="right")) - BACK)
        while keep and (old[keep - 1].isspace() or old[keep].isspace()):
            keep -= 1
        if first and not keep:  # no safe boundary in these leaves: take all the text before
            first, before = 0, 0
            old = [p for leaf in range(last + 1) for p in self.pieces(leaf)]
        head = old[:keep]
        from_ = before + sum(map(len, head))
        text = "".join(old[keep:])
        text = text[: start - from_] + new + text[end - from_ :]
        shift = len(new) - (end - start)
        edge = start + len(new)  # end of the edit in the new text
        rest = old[keep:]
        while True:
            done = last + 1 >= len(self.leaves)
            ahead = [] if done else self.pieces(last + 1)
            pieces = self.encoder.split(text if done else text + self.leaves[last + 1])
            known = rest + ahead
            known_ends = from_ + np.cumsum(np.fromiter(map(len, known), np.int64, len(known))) + shift
            new_ends = from_ + np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
            stop = behind = None
            for i in range(int(np.searchsorted(new_ends, edge, side="right")), len(pieces) - 1):
                j = int(np.searchsorted(known_ends, new_ends[i]))
                if j < len(known) and known_ends[j] == new_ends[i] and not pieces[i].isspace() and not known[j].isspace():
                    stop, behind = i + 1, j + 1
                    break
            if stop is not None or done:
                break
            last += 1
            text += self.leaves[last]
            rest = known
        if stop is None:
            self.encoded += int(new_ends[-1]) - from_ if pieces else 0
            new_pieces = pieces
        else:
            self.encoded += int(new_ends[stop - 1]) - from_
            new_pieces = pieces[:stop] + known[behind:]
            if not done:
                last += 1
        self._put(first, last, head + new_pieces)

    def _ended(self, leaf: int, chars: int) -> int:
        """Pre-tokens of a leaf that end within its first ``chars`` characters, counted up to BACK."""
        return min(BACK, int(np.searchsorted(np.cumsum(self.cuts[leaf]), chars, side="right")))


def planned_edits(text: str) -> list[tuple[int, int, str]]:
    """Three edits for every text, from its length alone: a replacement, an insertion and a deletion."""
    n = len(text)
    return [(n // 4, n // 4 + min(12, n // 8), " revised 2024"), (n // 2, n // 2, " (see note)"), (3 * n // 4, 3 * n // 4 + min(7, n // 10), "")]


def built(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table of trees of docs: whole texts are split and counted here, and nowhere else."""
    prepare(docs.sparkSession)

    @factory
    def start():
        from tidemark.llm.tokens import byte_encoder

        encoder = byte_encoder(vocabulary, pattern)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            cols = zip(*(CountTree.of_text(t or "", encoder).row() for t in b.column("text").to_pylist()), strict=True)
            kinds = (pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64())
            return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["doc_id", "text", "piece_chars", "leaf_pieces", "leaf_tokens", "n_tokens"])

        return step

    rows = docs.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text")
    return map_arrow(rows, start, TREE)


def edited(trees: DataFrame, edits: DataFrame | Edits, vocabulary: str, pattern: str, digests: bool = False) -> DataFrame:
    """The trees after a batch of edits: a table (doc_id, seq, start, end, new), or a function of the text.

    Columns of TREE and recoded_chars; with ``digests`` the counts and a digest of the text in place of the tree:
    doc_id, n_tokens (before), n_tokens_edited, n_chars (before), recoded_chars, edited_sha256.
    """
    prepare(trees.sparkSession)
    planned = edits if callable(edits) else None
    if planned is None:
        step_ = F.struct("seq", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), F.col("new").alias("new"))
        whole = edits.where("doc_id is not null and seq is not null and start is not null and end is not null and new is not null")
        steps = whole.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.sort_array(F.collect_list(step_)).alias("steps"))
        trees = trees.join(steps, "doc_id", "left")

    @factory
    def start():
        from tidemark.llm.tokens import byte_encoder

        encoder = byte_encoder(vocabulary, pattern)

        def step(b: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            given = [b.column(c).to_pylist() for c in ("text", "piece_chars", "leaf_pieces", "leaf_tokens", "n_tokens")]
            batch = [None] * b.num_rows if planned else b.column("steps").to_pylist()
            for *tree_row, n, steps in zip(*given, batch, strict=True):
                text = tree_row[0]
                tree = CountTree.stored(*tree_row, encoder)
                for s, e, new in planned(text) if planned else ((x["start"], x["end"], x["new"]) for x in steps or ()):
                    tree.edit(s, e, new)
                rows.append((n, tree.count(), len(text), tree.encoded, hashlib.sha256(tree.text().encode("utf-8", "replace")).hexdigest()) if digests else (*tree.row(), tree.encoded))
            kinds = [pa.int64()] * 4 + [pa.string()] if digests else [pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names=names)

        return step

    schema = "doc_id long, n_tokens long, n_tokens_edited long, n_chars long, recoded_chars long, edited_sha256 string" if digests else f"{TREE}, recoded_chars long"
    names = [x.split()[0] for x in schema.split(", ")]
    return map_arrow(trees, start, schema)


def count_edited(docs: DataFrame, vocabulary: str, pattern: str, edits: DataFrame | Edits = planned_edits, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens before the edits, n_tokens_edited after them, n_chars, recoded_chars, edited_sha256."""
    scratch = Scratch(docs.sparkSession, "token-counts")
    trees = scratch.write(built(docs, vocabulary, pattern, id_col, text_col), "trees")
    out = scratch.write(edited(trees, edits, vocabulary, pattern, digests=True), "edited")
    scratch.drop(trees)
    return out


def op2(spark: SparkSession, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return count_edited(docs, vocabulary or public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
