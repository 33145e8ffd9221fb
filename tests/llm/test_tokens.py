import random
import zlib

import numpy as np
import public_tokenizers as public
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tidemark.llm import packing, token_counts, tokens

WORDS, BYTES = public.path("word_bpe_49k.json"), public.path("byte_bpe_50k.tiktoken")
WHOLE = Tokenizer.from_file(WORDS)
ENCODER, COUNTER = tokens.WordEncoder(WORDS), tokens.ByteEncoder(BYTES, public.PATTERN)
ODD = [
    "it's THE_end__x  a²³ ½ İstanbul ΣΑΣ don't'll  \x1c a\x0bb", "", " ", "<|endoftext|> hi", "naïve CAFÉ—déjà vu…  1234 12ab_cd", "áb é", "日本語 text 中文",
    "_a_!_b", "É'S x's", "'''s", "x\x85y  z", "!!!'re$$'d", "a.b,c", "a. .b ,. ..", "end.", ".x", "ÿÀ×÷", " x y",
]


def ids(text):
    return WHOLE.encode(text, add_special_tokens=False).ids


def test_word_encoder_on_odd_texts():
    assert [np.frombuffer(x, "<u4").tolist() for x in ENCODER.encode(ODD)] == [ids(t) for t in ODD]


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(list("aAbtTsSdré ÉÿÖ.,,..'!_|<>-12\n\t   漢é")), max_size=40))
def test_word_encoder_on_any_text(text):
    assert np.frombuffer(ENCODER.encode([text])[0], "<u4").tolist() == ids(text)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBERED", 3)
    e = tokens.WordEncoder(WORDS)
    for _ in range(2):
        for t in ODD:
            assert np.frombuffer(e.encode([t])[0], "<u4").tolist() == ids(t)


def test_edits_against_recounting():
    r = random.Random(1)
    parts = ["a", "b ", "  ", "\n", "'s", "12", " the", "É", "!!", "  x", "\n\n", "\t", "don't"]
    for _ in range(600):
        text = "".join(r.choice(parts) for _ in range(r.choice([0, 1, 5, 30, 400])))
        tree, now = token_counts.CountTree.of_text(text, COUNTER), text
        for _ in range(r.randint(1, 4)):
            n = len(now)
            s = r.randint(0, n)
            e = r.randint(s, min(n, s + r.choice([0, 3, 50, 300])))
            new = "".join(r.choice(parts) for _ in range(r.randint(0, 4)))
            tree.edit(s, e, new)
            now = now[:s] + new + now[e:]
            assert tree.text() == now and tree.count() == COUNTER.count(now)
            if r.random() < 0.3:  # kept and read again
                tree = token_counts.CountTree.stored(*tree.row()[:4], COUNTER)


def test_leaves_stay_in_size_and_sums_with_them():
    """Many edits at one place: no leaf holds the document, and the tree stays that of its leaves."""
    r = random.Random(2)
    tree, now = token_counts.CountTree.of_text("some words of a text " * 40, COUNTER), "some words of a text " * 40
    for k in range(400):
        at = r.randint(90, 110) if k < 300 else 50
        cut = 0 if k < 300 else 40
        new = " and more of it," if k < 300 else ""
        tree.edit(at, at + cut, new)
        now = now[:at] + new + now[at + cut :]
        assert max(map(len, tree.cuts)) <= 2 * token_counts.RUN
    fresh = token_counts.CountTree(COUNTER, now, np.concatenate(tree.cuts), np.array([len(x) for x in tree.cuts]), tree.tokens[tree.wide : tree.wide + len(tree.leaves)])
    assert tree.text() == now and tree.count() == COUNTER.count(now) and (fresh.tokens == tree.tokens).all() and (fresh.chars == tree.chars).all()
    assert 0 < tree.rebuilt < 60


def test_a_second_batch_of_edits_reads_stored_trees(spark, tmp_path):
    """The trees are a table; a batch of edits re-encodes what it touches, and gives a table of trees again."""
    texts = {1: "word " * 5000, 2: "a short one", 3: None, None: "no name"}
    docs = spark.createDataFrame([*texts.items(), (2, "a short one")], "doc_id long, text string")
    token_counts.built(docs, BYTES, public.PATTERN).write.parquet(str(tmp_path / "0"))
    now = [(d, t or "") for d, t in [*texts.items(), (2, "a short one")]]
    batches = [[(1, 0, 10_000, 10_004, "thing"), (1, 1, 30, 40, ""), (2, 0, 0, 1, "One"), (9, 0, 0, 0, "x"), (None, 0, 0, 0, "x"), (2, 1, None, 0, "x")], [(1, 0, 24_000, 99_000, " end"), (3, 5, 7, 3, "new text"), (2, 0, 3, 3, "!")]]
    for k, batch in enumerate(batches):
        edits = spark.createDataFrame(batch, "doc_id long, seq int, start int, end int, new string")
        trees = spark.read.parquet(str(tmp_path / str(k)))
        token_counts.edited(trees, edits, BYTES, public.PATTERN).write.parquet(str(tmp_path / str(k + 1)))
        for d, _, s, e, new in batch:
            if None not in (d, s):
                now = [(i, t[: min(s, len(t))] + new + t[max(min(s, len(t)), min(e, len(t))) :] if i == d else t) for i, t in now]
        got = spark.read.parquet(str(tmp_path / str(k + 1))).collect()
        assert sorted(((x.doc_id, x.text, x.n_tokens) for x in got), key=str) == sorted(((d, t, COUNTER.count(t)) for d, t in now), key=str)
        assert max(x.recoded_chars for x in got) < 700
    assert sorted(trees.columns) == sorted(x for x in spark.read.parquet(str(tmp_path / "1")).columns)


def test_an_edit_recodes_little():
    text = " ".join(f"word{i}" for i in range(20_000))
    tree = token_counts.CountTree.of_text(text, COUNTER)
    tree.edit(70_000, 70_005, " changed")
    assert tree.encoded < 200 and tree.count() == COUNTER.count(text[:70_000] + " changed" + text[70_005:])


def test_count_query(spark):
    df = spark.createDataFrame([(1, "Hello there, world. " * 50, "z"), (2, None, "z"), (2, "", "z"), (None, "x", "z")], "doc_id long, text string, n_tokens string")
    got = token_counts.count_edited(df, BYTES, public.PATTERN).collect()
    assert len(got) == 4
    for x in got:
        text = {1: "Hello there, world. " * 50, None: "x"}.get(x.doc_id, "")
        after = text
        for s, e, new in token_counts.planned_edits(text):
            after = after[: min(s, len(after))] + new + after[min(e, len(after)) :]
        assert (x.n_tokens, x.n_tokens_edited) == (COUNTER.count(text), COUNTER.count(after))
    assert token_counts.count_edited(df.limit(0), BYTES, public.PATTERN).count() == 0


def test_packing(spark):
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["alpha", "beta", "x1"]) for _ in range(r.choice([0, 3, 40, 900])))) for i in range(60)]
    rows += [(None, "no name"), (7, rows[7][1]), (99, None), (100, "long " * 9000)]
    df = spark.createDataFrame([(d, t, 5) for d, t in rows], "doc_id long, text string, chunk int").repartition(4)
    size = 128
    pieces = packing.pack(df, WORDS, size).collect()
    at = (0, 0)
    streams = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert (p.sequence_id, p.offset) == at and 0 < p.length <= size - p.offset and len(p.piece_ids) == 4 * p.length
        at = (p.sequence_id, p.offset + p.length) if p.offset + p.length < size else (p.sequence_id + 1, 0)
        streams.setdefault(p.doc_id, []).append((p.start, bytes(p.piece_ids), p.doc_tokens))
    total = 0
    for d, t in {d: t for d, t in rows}.items():
        want = np.array([*ids(t or ""), 1], "<u4").tobytes()
        copies = sum(x == d for x, _ in rows)
        total += copies * len(want)
        got = sorted(streams[d])
        assert sum(len(b) for _, b, _ in got) == copies * len(want)
        assert {n for _, _, n in got} == {len(want) // 4}
        if copies == 1:
            assert b"".join(b for _, b, _ in got) == want
    assert sum(4 * p.length for p in pieces) == total
    assert packing.pack(df.limit(0), WORDS).count() == 0
    assert zlib.crc32(b"") == 0
