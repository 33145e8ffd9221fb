import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from tests.llm.test_chosen_path import shingles

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Each stage's result, written and read again."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    out = [docs]
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stages") / str(k))
        f(spark, docs, FOLDER).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "exact dedup", "n-gram Jaccard join", "mixing to target weights", "packing"]


def test_columns(stages):
    for df in stages[:-1]:
        assert df.columns == stages[0].columns
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(stages[-1].columns)


def test_quality_stage(spark, stages):
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    kept = {x.doc_id for x in stages[1].select("doc_id").collect()}
    right = [(d in kept) == bool(q) for d, q in labels.items()]
    assert sum(right) / len(right) > 0.97
    rows = {x.doc_id: x for x in stages[0].collect()}
    assert all(x == rows[x.doc_id] for x in stages[1].collect())


def test_exact_stage(stages):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    best = {}
    for x in stages[1].collect():
        k = (x.text or "").translate(lower)
        best[k] = max(best.get(k, -1), x.doc_id)
    assert sorted(x.doc_id for x in stages[2].collect()) == sorted(best.values())


def test_near_stage(stages):
    rows = sorted((x.doc_id, x.text) for x in stages[2].collect())
    sets = [shingles(t, 5)[0] for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9:
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    assert sorted(x.doc_id for x in stages[3].collect()) == [d for i, (d, _) in enumerate(rows) if root(i) == i]


def test_mix_stage(spark, stages):
    """Documents of the anchored domain once; the others as often as their copies say, and nothing else."""
    from collections import Counter

    from tidemark.llm import mixing

    labels = {x.doc_id: (x.quality, x.toxic) for x in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    before, after = [x.doc_id for x in stages[3].collect()], Counter(x.doc_id for x in stages[4].collect())
    clean = [d for d in before if labels.get(d) == (1, 0)]
    assert sum(after[d] == 1 for d in clean) > 0.99 * len(clean)
    domain = mixing.domain_of(F.col("quality"), F.col("toxic")).alias("domain")
    labelled = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", domain)
    rates = mixing.rated(stages[3], labelled, corpus_pipeline.TARGETS, corpus_pipeline._vocabulary(), anchor="good")
    assert {x.doc_id: x.copies for x in rates.collect() if x.copies} == dict(after)
    for x in mixing.achieved(rates, rates.domains).collect():
        assert abs(x.by_rates - corpus_pipeline.TARGETS.get(x.domain, 0.0)) < 0.01


def test_pack_stage(stages):
    pieces = sorted((x.sequence_id, x.offset, x.length) for x in stages[5].collect())
    at = (0, 0)
    for s, o, n in pieces:
        assert (s, o) == at and o + n <= 2048
        at = (s, o + n) if o + n < 2048 else (s + 1, 0)
    assert {x.doc_id for x in stages[5].collect()} == {x.doc_id for x in stages[4].collect()}


def test_odd_rows(spark, tmp_path):
    """Nulls in any column, repeated rows, very long and empty texts, another column."""
    r = random.Random(1)
    text = " ".join("".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(200))
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(20)
    odd = spark.createDataFrame([(None, text, None, None, None), (900, text, None, None, None), (900, text, None, None, None), (901, None, "en", None, 0), (902, "", None, "s", None), (903, text * 300, "en", None, None), (None, None, None, None, None)], docs.schema)
    docs = docs.unionByName(odd)
    clashing = {c: F.lit(c) for c in ("row", "a.b", "score", "_score", "id", "kid", "th", "copies", "digest", "c0", "month")}
    docs = docs.withColumns(clashing)
    for k, (_, f) in enumerate(corpus_pipeline.STAGES):
        f(spark, docs, FOLDER).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert all([x[c] for x in docs.collect()] == [c] * docs.count() for c in clashing)
    assert docs.count() > 0


def test_run_leaves_its_result_alone(spark):
    """run() deletes what its stages wrote on the way, and its result can be read."""
    import os

    from tidemark.llm.common import Scratch, shared_dir

    for s in list(Scratch._all):
        s.close()
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.count() > 0 and len(Scratch._all) == 1
    left = [f for f in os.listdir(Scratch._all[0].base.removeprefix("file://"))]
    assert len(left) == 1 and os.path.isdir(shared_dir(spark).removeprefix("file://"))
