"""Token ids of whole texts with public vocabularies, remembering the ids of pre-tokens already met.

Pre-tokens are encoded independently of each other, so a text's ids are its pre-tokens' ids in a row. A bounded
table from pre-token to ids makes a frequent word cost a lookup. The table is emptied when full: that changes
speed, never ids. Texts whose splitting this module does not reproduce go through the tokenizer whole.
"""

from __future__ import annotations

import base64
import functools
import json
import re

import numpy as np

#: Pre-tokens remembered by a worker at most.
REMEMBERED = 400_000


class _Numbers(dict):
    """Pre-token -> its number; a new one gets the next number and is noted."""

    def __init__(self):
        super().__init__()
        self.order: list[str] = []

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self.order)
        self.order.append(piece)
        return n


class WordEncoder:
    """Ids of ``word_bpe_49k.json`` (tokenizers; lower-cased, white space dropped), add_special_tokens=False."""

    #: ASCII without control characters but \t \n \v \f \r, and precomposed Latin-1 letters: for these the tokenizer's
    #: normal form is the lower-cased text, and its pattern and Python's agree.
    PLAIN = re.compile("[\t-\r -~À-ÖØ-öø-ÿ]*")
    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
    #: Letters, white space, full stops and commas: where no two signs touch, white space around signs is all the pattern does.
    PROSE = re.compile("[\t-\r A-Za-zÀ-ÖØ-öø-ÿ.,]*")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        spec = json.loads(open(path, encoding="utf-8").read())
        vocab = spec["model"]["vocab"]
        self.ends = np.zeros(max(vocab.values()) + 3, bool)  # ids that end a pre-token
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        spec["normalizer"] = None
        spec["added_tokens"] = []
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.pieces = Tokenizer.from_str(json.dumps(spec))
        self.generation = 0
        self._forget()

    def _forget(self) -> None:
        self.known = _Numbers()
        self.flat = np.zeros(0, "<u4")  # ids of all known pre-tokens, in the order of their numbers
        self.starts = np.zeros(1, np.int64)
        self.generation += 1

    def _learn(self) -> None:
        """Encodes the pre-tokens that have a number but no ids yet."""
        new = self.known.order[len(self.starts) - 1 :]
        flat, starts = [self.flat], [self.starts]
        at = len(self.flat)
        for k in range(0, len(new), 4000):
            some = new[k : k + 4000]
            ids = np.array(self.pieces.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            stops = np.flatnonzero(self.ends[ids]) + 1
            if len(stops) != len(some):  # a pre-token that the vocabulary cannot spell
                each = [self.pieces.encode_batch_fast([x], add_special_tokens=False)[0].ids for x in some]
                ids, stops = np.array([i for x in each for i in x], "<u4"), np.cumsum([len(x) for x in each])
            flat.append(ids)
            starts.append(at + stops)
            at += len(ids)
        self.flat, self.starts = np.concatenate(flat), np.concatenate(starts)

    def split(self, text: str) -> list[str] | None:
        """Pre-tokens; None for a text that has to be encoded whole."""
        if self.PROSE.fullmatch(text) and ".." not in text and ",," not in text and ".," not in text and ",." not in text:
            return text.lower().replace(".", " . ").replace(",", " , ").split()
        return self.PIECES.findall(text.lower()) if self.PLAIN.fullmatch(text) and "<|" not in text else None

    def numbers(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Numbers of each text's pre-tokens, all of them known; None for a text that has to be encoded whole."""
        if len(self.known) > REMEMBERED:
            self._forget()
        number, out = self.known.__getitem__, []
        for t in texts:
            s = self.split(t or "")
            out.append(None if s is None else np.fromiter(map(number, s), np.int64, len(s)))
        if len(self.known.order) >= len(self.starts):
            self._learn()
        return out

    def encode_whole(self, text: str) -> np.ndarray:
        return np.array(self.whole.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def encode(self, texts: list[str | None], end: int | None = None) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, then the end id if there is one."""
        out, tail = [], b"" if end is None else np.array([end], "<u4").tobytes()
        for t, at in zip(texts, self.numbers(texts), strict=True):
            if at is None:
                ids = self.encode_whole(t)
            else:
                begin = self.starts[at]
                size = self.starts[at + 1] - begin
                upto = np.cumsum(size)
                ids = self.flat[np.repeat(begin - upto + size, size) + np.arange(upto[-1] if len(upto) else 0)]
            out.append(ids.tobytes() + tail)
        return out


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    """One encoder for all tasks of a Python worker: what it remembers is held once."""
    return WordEncoder(path)


class _Sizes(dict):
    """Pre-token -> its token count, encoded when first asked for."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self.encode(piece))
        return n


class ByteEncoder:
    """Counts and ids of ``byte_bpe_50k.tiktoken`` (byte-level BPE), pre-token by pre-token."""

    def __init__(self, path: str, pattern: str):
        import regex
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(path, "rb"))}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known = _Sizes(self.encoding.encode_ordinary)

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def sizes(self, pieces: list[str]) -> np.ndarray:
        """Token count of each pre-token."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def count(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))


@functools.cache
def byte_encoder(path: str, pattern: str) -> ByteEncoder:
    """One encoder for all tasks of a Python worker."""
    return ByteEncoder(path, pattern)
