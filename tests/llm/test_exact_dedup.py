import hashlib
import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm import exact_dedup as xd

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, keep):
    groups = {}
    for d, t in rows:
        groups.setdefault((t or "").translate(LOWER), []).append(d)
    out = []
    for t, ids in groups.items():
        real = [d for d in ids if d is not None]
        best = (max(real) if keep == "largest" else min(real)) if real else None
        out += [(d, best, len(ids)) for d in ids]
    return sorted(out, key=str)


def rows_of(seed):
    r = random.Random(seed)
    texts = ["", None, "Straße ÄÖ", "straße äö", "STRASSE", *["w" * i for i in range(8)], "É", "é", "x" * 50_000, "X" * 50_000]
    rows = [(i, r.choice(texts)) for i in range(300)]
    return rows + [(5, "abc"), (5, "ABC"), (5, "abd"), (None, "abc"), (None, "only here"), (None, "only here")]


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("bits", [256, 8])
def test_against_brute_force(spark, keep, bits):
    """With 8-bit digests most texts collide, so the bytes have to tell them apart."""
    rows = rows_of(1)
    df = spark.createDataFrame([(d, t, "k") for d, t in rows], "doc_id long, text string, digest string").repartition(5)
    got = xd.exact_dedup(df, keep, bits=bits).collect()
    assert sorted(((x.doc_id, x.keep_id, x.group_size) for x in got), key=str) == brute(rows, keep)
    kept = sum(x.kept for x in got)
    assert kept == len({(t or "").translate(LOWER) for _, t in rows})
    assert all(x.doc_id == x.keep_id for x in got if x.kept)


def test_runs_merge(spark):
    """Batches flushed one after another give the index of all rows at once."""
    log = xd.DigestLog(spark, "smallest")
    a = spark.createDataFrame([(3, "a"), (4, "b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "A"), (5, "c")], "doc_id long, text string")
    log.flush(a)
    log.flush(b)
    index = {bytes(x.digest): (x.keep_id, x.keep_run, x.n) for x in log.compact().collect()}
    digest = lambda t: hashlib.sha256(t.encode()).digest()
    assert index == {digest("a"): (1, 1, 2), digest("b"): (4, 0, 1), digest("c"): (5, 1, 1)}
    assert log.collisions(a.unionByName(b)) is None


def test_lookups_and_merges_by_size(spark):
    """Runs of one size class are merged four at a time; a batch meets what any run holds."""
    log = xd.DigestLog(spark, "smallest", smallest=2)
    held = {}
    for k in range(9):
        rows = [(10 * k + i, f"text {(7 * k + i) % 11}") for i in range(3 if k % 2 else 2)]
        log.flush(spark.createDataFrame(rows, "doc_id long, text string"))
        for d, t in rows:
            held.setdefault(t, []).append(d)
    assert len(log.runs) == 9 and len(log.segments) < 9
    batch = [(1000 + i, f"TEXT {i}") for i in range(14)] + [(None, "text 3")]
    got = {(x.doc_id, x.keep_id, x.n) for x in log.lookup(spark.createDataFrame(batch, "doc_id long, text string")).collect()}
    assert got == {(d, min(held[t.lower()]), len(held[t.lower()])) for d, t in batch if t.lower() in held}
    index = log.compact()
    assert {(x.keep_id, x.n) for x in index.collect()} == {(min(v), len(v)) for v in held.values()} and len(log.segments) == 1


def test_filters_never_deny_and_seldom_pass(spark):
    log = xd.DigestLog(spark)
    rows = spark.range(4000).select(F.unhex(F.sha2(F.col("id").cast("string").cast("binary"), 256)).alias("digest"), "id")
    own = xd.Filter(log.scratch, rows.where("id < 1000"), 1000, "own")
    passed = {x.id for x in own.passed(rows).collect()}
    assert set(range(1000)) <= passed and len(passed) < 1000 + 0.1 * 3000
    full = xd.Filter(log.scratch, rows, 4000, "full", most=xd.BLOCK)
    assert full.bits == xd.BLOCK and full.passed(rows).count() == 4000


def test_a_full_filter_changes_nothing(spark):
    """More hits than the filter has room for: more texts are sent, the result is the same."""
    rows = [(i, f"text {i % 700}") for i in range(1400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    big = xd.exact_dedup(df).select("doc_id", "keep_id", "group_size", "kept")
    small = xd.exact_dedup(df, most=xd.BLOCK).select("doc_id", "keep_id", "group_size", "kept")
    assert sorted(big.collect()) == sorted(small.collect()) and small.where("kept").count() == 700


def test_clashing_and_dotted_columns(spark):
    df = spark.createDataFrame([(1, "a", 1, 2, 3, 4), (2, "A", 5, 6, 7, 8), (2, "a", 9, 9, 9, 9)], "doc_id long, text string, id int, `key` int, digest int, `a.b` int")
    out = xd.keep_one(df, "smallest")
    assert out.columns == df.columns and [tuple(x) for x in out.collect()] == [(1, "a", 1, 2, 3, 4)]
    assert xd.exact_dedup(df).count() == 3


@pytest.mark.parametrize("keep", ["largest", "smallest"])
def test_keep_one(spark, keep):
    rows = rows_of(2)
    df = spark.createDataFrame([(d, t, i % 3) for i, (d, t) in enumerate(rows)], "doc_id long, text string, id int")
    out = xd.keep_one(df, keep).collect()
    assert len(out) == len({(t or "").translate(LOWER) for _, t in rows})
    best = {}
    for d, t in rows:
        k = (t or "").translate(LOWER)
        if d is not None:
            best[k] = (max if keep == "largest" else min)(best.get(k, d), d)
    assert {((x.text or "").translate(LOWER), x.doc_id) for x in out} == {(k, best.get(k)) for k in {(t or "").translate(LOWER) for _, t in rows}}


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert xd.exact_dedup(df).count() == 0 and xd.keep_one(df).count() == 0
