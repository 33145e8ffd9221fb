import zlib
from collections import Counter

import numpy as np
import public_tokenizers as public

from tidemark.llm import language as lg
from tidemark.llm import quality as ql
from tidemark.llm.registry import QUERIES

PIECES = public.path("piece_bpe_32k.model")
FOLDER = "/root/testdata/sf0.01"
TEXTS = {"en": "the cat and the dog went with her to the house of that old man", "de": "der hund und die katze gingen mit ihr in das haus des alten mannes", "fr": "le chien et le chat sont partis avec elle dans la maison du vieux"}


def test_forward_sums_all_segmentations():
    model = lg.learn({k: Counter(lg.words_of(t)) for k, t in TEXTS.items()}, lg.vocabulary_pieces(PIECES))
    number = {p: i for i, p in enumerate(model.lattice.pieces)}

    def brute(word, k):
        """Sum over all segmentations, by recursion on the first piece."""
        if not word:
            return 1.0
        total = lg.UNKNOWN * brute(word[1:], k)
        for n in range(1, min(len(word), model.lattice.longest) + 1):
            if word[:n] in number:
                total += model.p[number[word[:n]], k] * brute(word[n:], k)
        return total

    for word in ("cat", "katze", "straße", "日本", "houses", "x" * 9):
        want = [np.log(brute(lg.MARK + word, k)) for k in range(3)]
        assert np.allclose(model.word_scores([word])[0], want, rtol=1e-10)
        assert np.allclose(model.long_score(word), want, rtol=1e-10)
    assert np.allclose(model.p[:-1].sum(0), 1, atol=1e-3)


def test_long_runs_are_scored_whole():
    """Sums in logarithms over all segmentations, also those that a cut every 32 letters would leave out."""
    model = lg.learn({k: Counter(lg.words_of(t)) for k, t in TEXTS.items()}, lg.vocabulary_pieces(PIECES))
    number = {p: i for i, p in enumerate(model.lattice.pieces)}
    assert model.lattice.longest == max(map(len, number))
    for word in ("international" * 7, "日本語" * 40, "derhundunddiekatze" * 30):
        text, want = lg.MARK + word, [np.zeros(3)]
        for j in range(1, len(text) + 1):
            terms = [want[j - 1] + np.log(lg.UNKNOWN)]
            terms += [want[j - k] + np.log(model.p[number[text[j - k : j]]]) for k in range(1, j + 1) if text[j - k : j] in number]
            want.append(np.logaddexp.reduce(terms))
        assert np.allclose(model.word_scores([word])[0], want[-1], rtol=1e-10)
    assert lg.words_of("½ ² ① Ⅷ a½b É_x") == ["a", "b", "é", "x"]


def test_language_cases(spark):
    rows = [(i, t, k) for k, t in TEXTS.items() for i in range(0, 30)]
    df = spark.createDataFrame([*rows, (100, None, "en"), (101, "123 !!", "en"), (102, "", None), (103, "the man with the dog", None), (104, "a" * 100_000, None), (None, "die katze", None), (103, "the man with the dog", None), (105, "½ ²", "de")], "doc_id long, text string, lang string")
    got = lg.identify(df, lg.sample_counts(df), PIECES).collect()
    assert len(got) == df.count()
    by = {x.doc_id: x for x in got}
    assert by[100].lang_pred == by[101].lang_pred == by[102].lang_pred == by[105].lang_pred == "und" and by[100].score == by[105].score == 0
    assert by[103].lang_pred == "en" and by[None].lang_pred == "de" and by[104].lang_pred in TEXTS
    assert all(0 <= x.score <= 1 for x in got)
    nothing = lg.identify(df, {}, PIECES).collect()
    assert {x.lang_pred for x in nothing} == {"und"}
    assert lg.identify(df.limit(0), lg.sample_counts(df.limit(0)), PIECES).count() == 0


def test_held_out_accuracy(spark):
    docs = {x.doc_id: x for x in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    lang = QUERIES["op5_language"](spark, FOLDER).collect()
    assert all(x.held_out == (zlib.crc32(str(x.doc_id).encode()) % 3 == 1) for x in lang)
    held = [x.lang_pred == docs[x.doc_id].lang for x in lang if x.held_out]
    assert len(lang) == len(docs) and sum(held) / len(held) > 0.97
    labels = {x.doc_id: x.quality for x in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    quality = QUERIES["op7_quality"](spark, FOLDER).collect()
    held = [x.predicted == labels[x.doc_id] for x in quality if x.held_out and x.doc_id in labels]
    assert len(quality) == len(docs) and sum(held) / len(held) > 0.97
    assert all(x.predicted == int(x.score >= 0.5) for x in quality)


def test_labels_of_held_out_rows_teach_nothing(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").select("doc_id", "quality")
    from pyspark.sql import functions as F

    lies = labels.withColumn("quality", F.when(ql.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ql.fit(docs, labels), ql.fit(docs, lies)
    assert (a.feature == b.feature).all() and (a.leaf == b.leaf).all()


def test_flat_trees_equal_walking():
    r = np.random.default_rng(0)
    x = r.normal(size=(500, len(ql.STATS)))
    y = (x[:, 0] + x[:, 3] * x[:, 5] > 0).astype(float)
    t = ql.Trees.fit(x, y, trees=20)

    def walk(row):
        s = t.base
        for k in range(len(t.feature)):
            node = 0
            while node < t.feature.shape[1]:
                node = 2 * node + 1 + (row[t.feature[k, node]] > t.threshold[k, node])
            s += t.leaf[k, node - t.feature.shape[1]]
        return 1 / (1 + np.exp(-s))

    p = t.predict(x)
    assert np.allclose(p, [walk(v) for v in x])
    assert ((p > 0.5) == y).mean() > 0.9


def test_quality_cases(spark):
    odd = spark.createDataFrame([(1, None, "s"), (2, "", "s"), (None, "text", "s"), (3, "word " * 100_000, "s"), (3, "x", "s")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    trees = ql.fit(odd, none)
    assert {x.q for x in ql.score(odd, trees, "q").collect()} == {0.5}
    one = spark.createDataFrame([(3, 1), (3, None), (5, 7), (None, 0)], "doc_id long, quality int")
    assert all(0 <= x.q <= 1 for x in ql.score(odd, ql.fit(odd, one), "q").collect())
    out = ql.score(odd, trees, "q")
    assert out.columns == ["doc_id", "text", "score", "q"] and ql.score(odd.limit(0), trees, "q").count() == 0
    from pyspark.sql import functions as F

    dotted = odd.withColumns({"a.b": F.lit(1), "nested": F.struct(F.lit(1).alias("x.y"))})
    assert ql.score(dotted, trees, "q").columns == ["doc_id", "text", "score", "a.b", "nested", "q"] and len(ql.score(dotted, trees, "q").collect()) == 5
    try:
        ql.score(odd, trees)
    except ValueError as e:
        assert "name another" in str(e)
    else:
        raise AssertionError("a column of the user's was replaced")
