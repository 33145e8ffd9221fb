import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tidemark.llm import mixing

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def frame(spark, n=300):
    rows, labels = [], []
    r = np.random.default_rng(3)
    for i in range(n):
        kind = i % 3
        words = [["apple", "pear", "plum"], ["steel", "iron", "zinc"], ["river", "lake", "sea"]][kind]
        rows.append((i, " ".join(r.choice(words + ["the", "of"], int(r.integers(5, 40)))), "x"))
        if i % 2:
            labels.append((i, ["fruit", "metal", "water"][kind]))
    return spark.createDataFrame(rows, "doc_id long, text string, row string"), spark.createDataFrame(labels, "doc_id long, domain string")


def test_targets_are_met(spark):
    docs, labelled = frame(spark)
    targets = {"fruit": 0.6, "metal": 0.3, "water": 0.1}
    model = mixing.fit_domains(docs, labelled, VOCABULARY)
    assert model.domains == ["fruit", "metal", "water"]
    rows = mixing.exposed(docs, model, VOCABULARY).cache()
    want = np.array([0.6, 0.3, 0.1])
    steps = mixing.fit_rates(rows, want)
    t = rows.toPandas()
    p, tokens = np.stack(t.p), t.tokens.to_numpy()
    rate, _ = steps.rates(p)
    assert (rate >= 0).all()
    assert np.abs((tokens * rate) @ p / tokens.sum() - want).max() < 1e-3
    got = mixing.rated(docs, labelled, targets, VOCABULARY).toPandas()
    truth = np.array(["fruit", "metal", "water"])[got.doc_id % 3]
    assert (got.domain == truth).mean() > 0.99
    assert abs((got.tokens * got.rate)[got.domain == "water"].sum() / got.tokens.sum() - 0.1) < 0.03


def test_rates_agree_with_a_plain_solver():
    # brute force: many plain projected-gradient steps on the whole objective
    r = np.random.default_rng(1)
    p = r.dirichlet([0.4, 0.4, 0.4], 200)
    tokens = r.integers(1, 100, 200)
    a = tokens / tokens.sum()
    want = np.array([0.7, 0.2, 0.1])
    mu = 1e-2
    steps = mixing.Steps((p * a[:, None]).T @ p, mu)
    for _ in range(400):
        _, y = steps.rates(p)
        steps.residuals.append((a * y) @ p - want)
    rate, _ = steps.rates(p)
    x = np.ones(200)
    for _ in range(60_000):
        x = np.maximum(0, x - 0.9 * (p @ ((a * x) @ p - want) + mu * (x - 1)))
    assert np.abs(rate - x).max() < 1e-3


def test_an_anchor_is_taken_once_and_the_others_meet_their_targets(spark):
    """Thinned or repeated, in proportion to the anchored domain."""
    docs, labelled = frame(spark, 900)
    want = {"fruit": 0.3, "metal": 0.65, "water": 0.05}
    rates = mixing.rated(docs, labelled, want, VOCABULARY, anchor="fruit")
    got = rates.toPandas()
    assert (got.rate[got.domain == "fruit"] == 1).all() and (got.copies[got.domain == "fruit"] == 1).all()
    assert got.rate[got.domain == "metal"].mean() > 1.5 and (got.copies[got.domain == "water"] == 0).mean() > 0.5
    for x in mixing.achieved(rates, rates.domains).collect():
        assert abs(x.by_rates - want[x.domain]) < 1e-3 and abs(x.by_copies - want[x.domain]) < 0.03 and abs(x.as_it_was - 1 / 3) < 0.05


def test_the_query_meets_its_targets(spark):
    """op4 on the 0.01 tables: shares by rates within the stop's tolerance, by copies within what dice leave."""
    import os

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(os.path.join(folder, "documents.parquet")).select("doc_id", "text")
    labels = spark.read.parquet(os.path.join(folder, "labels.parquet"))
    labelled = labels.select("doc_id", mixing.domain_of(F.col("quality"), F.col("toxic")).alias("domain"))
    rates = mixing.rated(docs, labelled, mixing.TARGETS, VOCABULARY)
    assert rates.count() == docs.count()
    total = rates.agg(F.sum("tokens").alias("t"), F.sum(F.col("tokens") * F.col("rate")).alias("r")).first()
    assert abs(total.r / total.t - 1) < 5e-4
    # the dice of one document move its domain by its own tokens: three standard deviations
    spread = {x.domain: 3 * x.v**0.5 / total.t for x in rates.withColumn("f", F.col("rate") - F.floor("rate")).groupBy("domain").agg(F.sum(F.col("tokens") ** 2 * F.col("f") * (1 - F.col("f"))).alias("v")).collect()}
    for x in mixing.achieved(rates, rates.domains).collect():
        assert abs(x.by_rates - mixing.TARGETS[x.domain]) < 3e-4
        assert abs(x.by_copies - mixing.TARGETS[x.domain]) < 1e-3 + 2 * sum(spread.values())


def test_equal_identifiers_are_told_apart_by_text(spark):
    docs, labelled = frame(spark, 300)
    odd = docs.unionByName(spark.createDataFrame([(0, "river lake sea the river", "odd"), (0, "apple pear", "even"), (None, "river lake", "none"), (None, "plum pear", "none")], docs.schema))
    out = mixing.mixed(odd, labelled, {"fruit": 1.0, "metal": 1.0}, VOCABULARY, anchor="fruit").collect()
    rows = [x.row for x in out]
    assert "even" in rows and "odd" not in rows and rows.count("none") == 1


def test_clashing_and_dotted_columns(spark):
    docs, labelled = frame(spark, 60)
    docs = docs.withColumns({c: F.lit(c) for c in ("id", "th", "_th", "copies", "turn", "a.b", "tokens", "domain")})
    out = mixing.mixed(docs, labelled, {"fruit": 1.0, "metal": 1.0}, VOCABULARY)
    assert out.columns == docs.columns and {x["a.b"] for x in out.collect()} == {"a.b"}


def test_mixed_keeps_columns(spark):
    docs, labelled = frame(spark)
    out = mixing.mixed(docs, labelled, {"fruit": 0.9, "metal": 0.1}, VOCABULARY)
    assert out.columns == docs.columns
    n = out.groupBy((F.col("doc_id") % 3).alias("k")).count().toPandas().set_index("k")["count"]
    assert n.get(2, 0) < 10 and n[0] > 100


def test_defined_cases(spark):
    docs, labelled = frame(spark, 9)
    odd = spark.createDataFrame([(None, "apple"), (3, None), (3, None), (4, ""), (5, "日本 " * 5000)], "doc_id long, text string")
    got = mixing.rated(odd, labelled, {"fruit": 1.0}, VOCABULARY).collect()
    assert len(got) == 5 and all(x.rate >= 0 for x in got)
    none = spark.createDataFrame([], labelled.schema)
    assert {x.rate for x in mixing.rated(docs, none, {"fruit": 1.0}, VOCABULARY).collect()} == {1.0}
    assert mixing.rated(docs.limit(0), labelled, {"fruit": 1.0}, VOCABULARY).count() == 0


def soft(spark, n=600):
    """Rows of fit_rates: three domains, nearly certain."""
    r = np.random.default_rng(5)
    p = np.full((n, 3), 1e-6)
    p[np.arange(n), r.choice(3, n, p=[0.6, 0.3, 0.1])] = 1 - 2e-6
    tokens = r.integers(50, 150, n)
    return p, tokens, spark.createDataFrame([(int(t), [float(v) for v in x]) for t, x in zip(tokens, p, strict=True)], "tokens long, p array<double>")


def test_small_targets_are_met(spark):
    p, tokens, rows = soft(spark)
    for small in (0.01, 3e-4):
        want = np.array([0.7 - small, 0.3, small])
        steps = mixing.fit_rates(rows, want)
        got = (tokens * steps.rates(p)[0]) @ p / tokens.sum()
        assert (np.abs(got - want) <= np.minimum(1e-4, 0.005 * want)).all() and not steps.missed.any()


def test_missed_targets_are_reported(spark):
    p, tokens, rows = soft(spark)
    want = np.array([0.5, 0.2, 0.3])
    steps = mixing.fit_rates(rows, want, rounds=2)
    got = (tokens * steps.rates(p)[0]) @ p / tokens.sum()
    assert len(steps.residuals) == 2 and np.abs(steps.missed - (got - want)).max() < 1e-4
    docs, _ = frame(spark, 30)
    docs = docs.withColumn("text", F.lit("apple pear"))
    labelled = docs.select("doc_id", F.when(F.col("doc_id") % 2 == 0, "a").otherwise("b").alias("domain"))
    with pytest.warns(RuntimeWarning, match="targets not met"):
        mixing.rated(docs, labelled, {"a": 0.9, "b": 0.1}, VOCABULARY)


def test_copies_meet_the_targets(spark):
    r = np.random.default_rng(7)
    kinds = r.choice(3, 4000, p=[0.88, 0.07, 0.05])
    words = [["apple", "pear", "plum"], ["steel", "iron", "zinc"], ["river", "lake", "sea"]]
    names = ["fruit", "metal", "water"]
    docs = spark.createDataFrame([(i, " ".join(r.choice(words[k], 8))) for i, k in enumerate(kinds)], "doc_id long, text string")
    labelled = spark.createDataFrame([(i, names[k]) for i, k in enumerate(kinds)], "doc_id long, domain string")
    want = {"fruit": 0.9, "metal": 0.06, "water": 0.04}
    got = mixing.rated(docs, labelled, want, VOCABULARY).toPandas()
    total = (got.tokens * got.copies).groupby(got.domain).sum() / got.tokens.sum()
    assert all(abs(total[d] - w) < 0.01 for d, w in want.items())
