import random
import re

import numpy as np

from tidemark.llm import chosen_path as cp


def shingles(text, words):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set()), tuple(w)


def brute(rows, words, threshold):
    s = [shingles(t, words) for _, t in rows]
    n = len(rows)
    up = list(range(n))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    links = [0] * n
    for i in range(n):
        for j in range(n):
            if i != j and (s[i][1] == s[j][1] or s[i][0] and len(s[i][0] & s[j][0]) >= threshold * len(s[i][0] | s[j][0]) - 1e-9):
                links[i] += 1
                up[max(root(i), root(j))] = min(root(i), root(j))
    groups = {}
    for i in range(n):
        groups.setdefault(root(i), []).append(i)
    out = []
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        out += [(rows[i][0], min(ids) if ids else None, links[i]) for i in g]
    return sorted(out, key=str)


def corpus(seed, families, members, unique):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(15)]
    rows, d = [], 0
    for f in range(families):
        base = [word() for _ in range(r.randint(20, 120))]
        if f % 2:
            base[:15] = passage
        for _ in range(members):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 25))):
                w[r.randrange(len(w))] = word()
            rows.append((d, r.choice([" ", "\n"]).join(w)))
            d += 1
    for _ in range(unique):
        rows.append((d, " ".join(passage + [word() for _ in range(r.randint(0, 60))])))
        d += 1
    rows += [(d, None), (d + 1, ""), (d + 2, "one two"), (d + 3, "one  two"), (d + 4, "one three"), (None, rows[0][1]), (None, "lone row without a name at all")]
    r.shuffle(rows)
    return rows


def check(spark, rows, **kw):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, row int")
    got = cp.similar_texts(df, **kw)
    rows_ = got.collect()
    assert sorted(((x.doc_id, x.class_id, x.n_links) for x in rows_), key=str) == brute(rows, 5, 0.8)
    classes = {}
    for x in rows_:
        if x.class_id is not None:
            classes[x.class_id] = classes.get(x.class_id, 0) + x.kept
    assert set(classes.values()) == {1}


def test_against_brute_force(spark):
    check(spark, corpus(1, 30, 6, 60), recall=0.99999)


def test_large_buckets_and_blocks(spark):
    # buckets over 8 members are split, what is left at full depth and families over 16 go in blocks
    check(spark, corpus(2, 4, 45, 120), recall=0.99999, small=8, block=16)


def test_families_are_peeled(spark, monkeypatch):
    """Tight and wide families around their pivots: counts by distance, open pairs by comparison."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(3))
    rows, d = [], 0
    for size, edits in ((70, 1), (70, 4), (60, 9)):
        base = [word() for _ in range(110)]
        for _ in range(size):
            w = list(base)
            for _ in range(r.randint(0, edits)):
                w[r.randrange(len(w))] = word()
            rows.append((d, " ".join(w)))
            d += 1
        rows += [(d + k, rows[-1 - k][1]) for k in range(3)]
        d += 3
    # a chain: each text half of the allowed distance from the one before
    chain = [word() for _ in range(100)]
    for k in range(40):
        chain[(3 * k) % 100] = word()
        rows.append((d, " ".join(chain)))
        d += 1
    opened = []
    real = cp.peeled

    def watched(scratch, rows, threshold, block):
        sure, open_, places, families = real(scratch, rows, threshold, block)
        opened.append((rows.count(), open_.count(), places.where("kind >= 2").count()))
        return sure, open_, places, families

    monkeypatch.setattr(cp, "peeled", watched)
    check(spark, rows, recall=0.99999, block=12, peel=1)
    assert len(opened) == cp.PEELS and opened[0][2] < 0.8 * opened[0][0]
    opened.clear()
    check(spark, rows[:73], recall=0.99999, block=12, peel=1)  # all near one page: nothing is compared
    assert opened[0][1] == opened[0][2] == 0


def test_recall_with_default_settings(spark):
    """Links of the rows whose identifier is divisible by 20, against all rows."""
    import duckdb

    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    got = {x.doc_id: x.n_links for x in cp.similar_texts(docs).collect()}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
    want = con.execute(r"""
      WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
      sh AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS s FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM d WHERE len(w) > 0)),
      n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
      pr AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id WHERE a.doc_id % 20 = 0 GROUP BY 1, 2)
      SELECT x, count(*) AS k FROM pr JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y WHERE c * 9 >= 4 * (p.n + q.n) GROUP BY 1""").fetchall()
    assert len(want) > 50 and sum(got[x] for x, _ in want) >= 0.999 * sum(k for _, k in want)
    assert all(got[x] <= k for x, k in want)


def test_clashing_and_dotted_columns(spark):
    df = spark.createDataFrame([(1, "a b c d e f g h", 1, 2, 3), (2, "a b c d e f g h", 4, 5, 6), (None, None, 7, 8, 9)], "doc_id long, text string, kid int, th int, `a.b` int")
    out = cp.keep_one(df)
    assert out.columns == df.columns and sorted(x["a.b"] for x in out.collect()) == [3, 9]


def test_runs():
    assert cp.runs_for(0.999, 1) == 7 and cp.runs_for(0.999, 3) == 15


def test_exact_links():
    r = np.random.default_rng(0)
    sets = [np.unique(r.integers(0, 50, 40).astype(np.uint64)) for _ in range(30)]
    ok = cp.exact_links(sets, np.arange(30), np.arange(30), 0.5)
    for i in range(30):
        for j in range(30):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            assert ok[i, j] == (len(a & b) * 2 >= len(a | b))


def test_repeated_identifiers_and_empty(spark):
    rows = [(1, "a b c d e f g h"), (1, "a b c d e f g h"), (1, "p q r s t u v w"), (2, "p q r s t u v w"), (3, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = cp.similar_texts(df).collect()
    assert len(got) == 5 and sum(x.kept for x in got) == 3
    assert cp.similar_texts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
