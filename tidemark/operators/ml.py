"""Models on the feature table with Spark ML: a stacked ensemble, a weighted baseline, walk-forward runs, importances."""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml.classification import (
    GBTClassificationModel,
    GBTClassifier,
    LogisticRegression,
    LogisticRegressionModel,
    MultilayerPerceptronClassifier,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import dataset as ds
from tidemark.operators.rolling import Series


def assembled(df: DataFrame, features: Iterable[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="skip").transform(df)


def with_class_weights(df: DataFrame, label: str, scale: float | None = None, out: str = "class_weight") -> DataFrame:
    """Weight of positives: negatives over positives, unless given."""
    if scale is None:
        n = df.agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("n")).first()
        scale = (n["n"] or 0) / n["p"] if n["p"] else 1.0
    return df.withColumn(out, F.when(F.col(label) == 1, float(scale)).otherwise(1.0))


def probability(column: str = "probability") -> Column:
    return vector_to_array(F.col(column))[1]


class Baseline:
    """Gradient-boosted trees with positives weighted up."""

    def __init__(self, iterations: int = 50, depth: int = 5, rate: float = 0.1, seed: int = 42):
        self.make = lambda: GBTClassifier(featuresCol="features", labelCol="y", weightCol="class_weight", maxIter=iterations, maxDepth=depth, stepSize=rate, seed=seed, subsamplingRate=0.8)
        self.model = None

    def fit(self, df: DataFrame, features: list[str], label: str) -> Baseline:
        self.features = list(features)
        rows = with_class_weights(assembled(df, features), label).withColumn("y", F.col(label).cast("double"))
        self.model = self.make().fit(rows)
        return self

    def predict(self, df: DataFrame, out: str = "score") -> DataFrame:
        made = self.model.transform(assembled(df, self.features))
        return made.withColumn(out, probability()).drop("features", "rawPrediction", "probability", "prediction")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(f"{path}/gbt")
        ds.write_json(SparkSession.active(), f"{path}/features.json", self.features)

    @classmethod
    def load(cls, path: str) -> Baseline:
        out = cls()
        out.model, out.features = GBTClassificationModel.load(f"{path}/gbt"), ds.read_json(SparkSession.active(), f"{path}/features.json")
        return out

    def importances(self) -> list[tuple[str, str, float]]:
        return [("gbt", f, float(v)) for f, v in zip(self.features, self.model.featureImportances.toArray(), strict=True)]


class Stack:
    """Three learners on nine tenths of the rows; a logistic model on their logits over the tenth left out.

    The tenth is every tenth row by hash of its key, so that no order of rows matters.
    """

    def __init__(self, iterations: int = 30, trees: int = 40, seed: int = 42):
        self.seed, self.iterations, self.trees = seed, iterations, trees

    def _learners(self):
        base = {"featuresCol": "features", "labelCol": "y", "weightCol": "class_weight"}
        yield "gbt", GBTClassifier(**base, maxIter=self.iterations, maxDepth=5, seed=self.seed)
        yield "forest", RandomForestClassifier(**base, numTrees=self.trees, maxDepth=8, seed=self.seed)
        yield "linear", LogisticRegression(**base, regParam=0.01, maxIter=100)

    def fit(self, df: DataFrame, features: list[str], label: str, keys: tuple[str, ...] = ("stock_id", "date")) -> Stack:
        self.features = list(features)
        rows = with_class_weights(assembled(df, features), label).withColumn("y", F.col(label).cast("double"))
        tenth = F.pmod(F.xxhash64(*keys), F.lit(10)) == 0
        self.models = [(n, m.fit(rows.where(~tenth))) for n, m in self._learners()]
        meta = self._meta(rows.where(tenth))
        self.meta = LogisticRegression(featuresCol="meta", labelCol="y", regParam=0.1, maxIter=300).fit(meta)
        return self

    def _meta(self, rows: DataFrame) -> DataFrame:
        """Logits of the learners, their extremes, spread, squares and products, as a vector."""
        for n, m in self.models:
            p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), probability()))
            rows = m.transform(rows).withColumn(f"__{n}", F.log(p / (1 - p))).drop("rawPrediction", "probability", "prediction")
        a, b, c = (F.col(f"__{n}") for n, _ in self.models)
        mean = (a + b + c) / 3
        terms = [a, b, c, F.least(a, b, c), F.greatest(a, b, c), F.sqrt(((a - mean) ** 2 + (b - mean) ** 2 + (c - mean) ** 2) / 3), a * b, a * c, b * c, a * a, b * b, c * c, a * b * c]
        names = [f"__t{i}" for i in range(len(terms))]
        rows = rows.withColumns(dict(zip(names, terms, strict=True)))
        return assembled(rows, names, "meta").drop(*names, *[f"__{n}" for n, _ in self.models])

    def predict(self, df: DataFrame, out: str = "score") -> DataFrame:
        made = self.meta.transform(self._meta(assembled(df, self.features)))
        return made.withColumn(out, probability()).drop("features", "meta", "rawPrediction", "probability", "prediction")

    def save(self, path: str) -> None:
        for n, m in [*self.models, ("meta", self.meta)]:
            m.write().overwrite().save(f"{path}/{n}")
        ds.write_json(SparkSession.active(), f"{path}/features.json", self.features)

    @classmethod
    def load(cls, path: str) -> Stack:
        out, kinds = cls(), (("gbt", GBTClassificationModel), ("forest", RandomForestClassificationModel), ("linear", LogisticRegressionModel))
        out.models = [(n, kind.load(f"{path}/{n}")) for n, kind in kinds]
        out.meta, out.features = LogisticRegressionModel.load(f"{path}/meta"), ds.read_json(SparkSession.active(), f"{path}/features.json")
        return out

    def importances(self) -> list[tuple[str, str, float]]:
        out = []
        for n, m in self.models:
            values = m.featureImportances.toArray() if hasattr(m, "featureImportances") else abs(m.coefficients.toArray())
            out += [(n, f, float(v)) for f, v in zip(self.features, values, strict=True)]
        return out


def perceptron(hidden: tuple[int, ...] = (32,), iterations: int = 100, seed: int = 42):
    """A feed-forward classifier for assembled rows; the input width is taken from the data when it is fitted."""

    def fit(df: DataFrame, features: list[str], label: str):
        rows = assembled(df, features).withColumn("y", F.col(label).cast("double"))
        return MultilayerPerceptronClassifier(featuresCol="features", labelCol="y", layers=[len(features), *hidden, 2], maxIter=iterations, seed=seed).fit(rows)

    return fit


def sequences(df: DataFrame, features: Iterable[str], window: int = 10, out: str = "sequence") -> DataFrame:
    """The ``window`` rows before each row of its series, oldest first, as an array of arrays; NULL where fewer stand there."""
    s = Series()
    rows = F.collect_list(F.array(*[F.col(f).cast("double") for f in features])).over(s.w.rowsBetween(-window, -1))
    return df.withColumn("__s", rows).withColumn(out, F.when(F.size("__s") == window, F.col("__s"))).drop("__s")


def correlated(df: DataFrame, features: list[str], most: float = 0.95) -> list[str]:
    """Features to drop: of each pair correlated over ``most``, the later one."""
    if len(features) < 2:
        return []
    m = Correlation.corr(assembled(df, features), "features").head()[0].toArray()
    return [f for j, f in enumerate(features) if any(abs(m[i, j]) > most for i in range(j))]


def run_folds(df: DataFrame, features: list[str], label: str, folds: Iterable[tuple[str, object, object]], model=Baseline, embargo: int = 14, at_once: int = 1) -> tuple[DataFrame, list[tuple]]:
    """(validation rows of all folds with fold and score, importances by fold). Scaling is fitted on each fold's train.

    A fold without train or validation rows gives none. ``at_once`` folds run side by side, which is faster (most jobs
    of a tree are too small to fill a cluster) and takes more of the driver's memory.
    """

    def run(fold: tuple[str, object, object]) -> tuple[DataFrame, list[tuple]] | None:
        name, train_end, val_end = fold
        split = ds.temporal_split(df, train_end, val_end, embargo, include_test=False)
        if split.select("split").distinct().count() < 2:
            return None
        split = ds.scale(split, features)
        fitted = model().fit(split.where("split = 'train'"), features, label)
        return fitted.predict(split.where("split = 'val'")).withColumn("fold", F.lit(name)), [(name, m, f, v) for m, f, v in fitted.importances()]

    with ThreadPoolExecutor(at_once) as pool:
        runs = [pool.submit(inheritable_thread_target(df.sparkSession)(run), fold) for fold in folds]
    out, found = None, []
    for one, values in (r.result() for r in runs if r.result() is not None):
        out = one if out is None else out.unionByName(one)
        found += values
    if out is None:
        out = df.where(F.lit(False)).withColumns({"split": F.lit(""), "score": F.lit(0.0), "fold": F.lit("")})
    return out, found


def write_tsv(df: DataFrame, path: str) -> None:
    """One folder of tab-separated files with a header; df is small (fold and importance tables)."""
    df.coalesce(1).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def read_tsv(spark, path: str) -> DataFrame:
    return spark.read.option("sep", "\t").option("header", True).option("inferSchema", True).csv(path)
