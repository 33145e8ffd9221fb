import contextlib
import hashlib
import random
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidemark.llm import common
from tidemark.llm import substring_dedup as module
from tidemark.llm.substring_dedup import levels_of, substring_dedup


def brute(rows, window):
    first = {}
    split = [(d, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for d, t in rows]
    for d, w in split:
        if d is not None:
            for i in range(len(w) - window + 1):
                k = tuple(w[i : i + window])
                first[k] = min(first.get(k, d), d)
    out = []
    for d, w in split:
        gone = set()
        if d is not None:
            for i in range(len(w) - window + 1):
                if first[tuple(w[i : i + window])] < d:
                    gone.update(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, window):
    r = random.Random(seed)
    word = lambda: r.choice("abcdefghij") + r.choice(["", "x", "é", "\x1c"])
    shared = [[word() for _ in range(r.randint(window, 3 * window))] for _ in range(4)]
    rows = []
    for d in range(120):
        w = []
        for _ in range(r.randint(0, 4)):
            p = r.choice(shared)
            s = r.randint(0, len(p) // 2)
            w += p[s : s + r.randint(1, len(p))] if r.random() < 0.6 else [word() for _ in range(r.randint(1, 2 * window))]
        rows.append((d, r.choice([" ", "\n", "  \t"]).join(w)))
    rows += [(200, rows[5][1]), (201, rows[5][1]), (5, rows[5][1]), (202, None), (203, ""), (204, "a " * 40), (205, "a " * 40), (None, rows[7][1]), (7, rows[9][1])]
    r.shuffle(rows)
    return rows


def test_levels():
    assert levels_of(50) == [13, 25, 50] and levels_of(50, 10) == [7, 13, 25, 50]
    assert levels_of(50, 25) == levels_of(50, 50) == [25, 50] and levels_of(1) == [1] and levels_of(7) == [4, 7]


def test_against_brute_force(spark):
    for seed, window, first in ((1, 12, 7), (2, 12, 4), (3, 9, 2), (4, 16, 2)):
        rows = corpus(seed, window)
        df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, pos string")
        got = substring_dedup(df, window, first)
        assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
        assert sorted((tuple(x) for x in got.collect()), key=str) == brute(rows, window)


def test_kept_texts(spark):
    passage = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([(1, f"one {passage} two"), (2, f"three\n{passage} four")], "doc_id long, text string")
    got = {x.doc_id: x.kept_text for x in substring_dedup(df, texts=True).collect()}
    assert got == {1: None, 2: "three four"}


def test_empty(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_candidates_shrink_level_by_level(spark):
    """Passages of 20, 40 and 60 shared words: the short ones drop out before the last length."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(4))
    shared = {n: [[word() for _ in range(n)] for _ in range(12)] for n in (10, 20, 40, 60)}
    rows = []
    for d in range(200):
        w = [word() for _ in range(30)]
        for n in shared:
            w += r.choice(shared[n]) + [word() for _ in range(5)]
        rows.append((d, " ".join(w)))
    seen = {}
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string"), first=7, seen=seen).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(rows, 50)
    assert list(seen) == [13, 25, 50] and seen[13] > 1.5 * seen[25] > 2 * seen[50] > 0
    assert substring_dedup(spark.createDataFrame(rows[:1], "doc_id long, text string"), seen=(alone := {})).collect()[0].n_removed == 0 and alone == {}


def test_a_long_passage_is_one_run_at_each_level(spark, monkeypatch):
    """Positions one by one soon passed what may be broadcast, and all texts were sent instead."""
    r, sent, extended = random.Random(5), {}, module.extended
    passage = [r.choice("abcdefghij") * r.randint(1, 9) + str(i) for i in range(3000)]
    rows = [(1, " ".join(passage)), (2, " ".join(["x", *passage[:2000], "y", *passage[2000:]])), (3, " ".join(passage[100:160]))]

    def seen(docs, short, long, over_anchors, last):
        sent[long] = docs.agg(F.sum(F.size("hits"))).first()[0]
        return extended(docs, short, long, over_anchors, last)

    monkeypatch.setattr(module, "extended", seen)
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute(rows, 50)
    assert sent[50] == 5


def test_shuffles_go_with_their_step(spark, monkeypatch):
    """Each table that the operator writes is written leanly, and a lean write leaves no shuffle files."""
    written, freed, write = [], [], common.Scratch.write

    def seen(self, df, name, **options):
        written.append(name)
        return write(self, df, name, **options)

    @contextlib.contextmanager
    def noted(session, inner=common.freed_shuffles):
        with inner(session):
            freed.append(session.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled"))
            yield

    def left() -> int:
        n, at = 0, spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().iterator()
        while at.hasNext():
            f = at.next()
            n += f.length() if f.getName().startswith("shuffle_") else 0
        return n

    monkeypatch.setattr(common.Scratch, "write", seen)
    monkeypatch.setattr(common, "freed_shuffles", noted)
    passage = " ".join(f"w{i}" for i in range(60))
    substring_dedup(spark.createDataFrame([(1, passage), (2, f"x {passage}")], "doc_id long, text string"))
    assert {"repeated", "windows25", "windows50", "ranges"} <= set(written) and freed == ["true"] * len(written)
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    before, scratch = left(), common.Scratch(spark, "lean", lean=True)
    assert scratch.write(spark.range(200_000).groupBy(F.xxhash64("id").alias("h")).agg(F.count("*").alias("n")), "t").count() == 200_000
    for _ in range(50):
        if (more := left() - before) < 20_000:
            break
        time.sleep(0.1)
    scratch.close()
    assert more < 20_000


def test_tables_start_no_processes(spark):
    """A process that the JVM starts has the JVM's memory as its own for a moment: executors were stopped at twice their size."""

    def reaped() -> int:
        pid = spark._jvm.java.io.File("/proc/self").getCanonicalFile().getName()
        return int(Path(f"/proc/{pid}/stat").read_text().rpartition(")")[2].split()[8])  # page faults of children that ended

    scratch = common.Scratch(spark, "quiet", lean=True)
    made = common.map_arrow(spark.range(2000), lambda b: b, "id long")
    scratch.write(made, "warm")
    before = reaped()
    tables = [scratch.write(made, "made"), scratch.write(spark.range(2000).groupBy("id").count().select("id"), "grouped")]
    started = reaped() - before
    assert [sorted(x.id for x in t.collect()) for t in tables] == [list(range(2000))] * 2
    scratch.close()
    assert started == 0


def test_tables_keep_their_rows(spark, monkeypatch):
    """Written by the workers or by Spark: the same rows, types and names; tables without rows too."""
    values = [(1, b"\x00\xff", "é\U0001f600", [1, None, -(2**63)], True, 0.5), (None, None, None, None, None, None), (2, b"", "", [], False, float("inf"))] * 700
    df = spark.createDataFrame(values, "`a b` long, x binary, t string, l array<long>, f boolean, d double").repartition(5)
    scratch = common.Scratch(spark, "rows", lean=True)
    here = [scratch.write(df, "all"), scratch.write(df.where("d < 0"), "none")]
    assert sorted(map(tuple, here[0].collect()), key=str) == sorted(values, key=str) and here[1].count() == 0
    assert here[0].schema == here[1].schema == df.schema
    monkeypatch.setattr(common.Scratch, "_local", lambda self, path: None)
    assert sorted(map(tuple, scratch.write(df, "spark").collect()), key=str) == sorted(values, key=str)
    scratch.close()


def test_a_task_that_failed_leaves_no_rows(spark, tmp_path):
    """Rows of an attempt that broke off are in no file that is read."""

    def breaks(b):
        if b.column("id")[0].as_py() >= 1500:
            raise ValueError("broken")
        return b

    folder = str(tmp_path / "t")
    with common.small_batches(spark), pytest.raises(Exception, match="broken"):
        common.stored(common.map_arrow(spark.range(0, 3000, 1, 1), breaks, "id long"), folder, most=1)
    assert [x.name for x in Path(folder).iterdir() if x.name[0] != "."] == []
