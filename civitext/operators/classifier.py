"""Linear text classifiers: TF-IDF with logistic regression, for two and for K classes.

A fitted classifier is tables and a few numbers: terms with their idf, coefficients by
term (and class), and intercepts. Scoring is one aggregation over the terms of a text
and builds no vectors; several classifiers can score texts that are cut into terms once.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import ceil

import pandas as pd
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from civitext.functions.scores import argmax, softmax
from civitext.operators.labels import class_weights
from civitext.operators.tfidf import MAX_TERMS, counted_terms, known_counts, term_sums, weigh, with_idf
from civitext.session import stage, stage_path

MAX_ITER = 1000
# Least relative progress of the fit: the gradient at the end is small beside the loss.
TOLERANCE = 1e-8
# Entries (12 bytes each) of the vectors that one task keeps through the iterations: every task of an
# iteration sends a gradient, a number per term and class, so there are as few tasks as memory allows.
ENTRIES_PER_TASK = 32_000_000
# Counted terms that one task sorts into vectors.
ENTRIES_PER_SORT = 1_000_000


def training_vectors(weights: DataFrame, rows: DataFrame, size: int, key: str = "row_id") -> DataFrame:
    """The columns of `rows` but the key, and `features`: one sparse vector for each row, staged.

    Numbers and weights of terms are written as typed arrays in the form in which Spark ML
    stores a vector, and read back as vectors. A text without known terms has an empty one.
    """
    items = F.array_sort(F.collect_list(F.struct("idx", "weight")))
    lists = weights.groupBy(key).agg(items.alias("_items"))
    joined = rows.join(lists, key, "left").withColumn("_items", F.coalesce("_items", F.array().cast("array<struct<idx:int,weight:double>>")))
    stored = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.col("_items.idx").alias("indices"),
        F.col("_items.weight").alias("values"),
    )
    keep = [c for c in rows.columns if c != key]
    path = stage_path(rows.sparkSession, "train_vectors")
    joined.select(*keep, stored.alias("features")).write.parquet(path)
    schema = T.StructType([rows.schema[c] for c in keep]).add("features", VectorUDT())
    return rows.sparkSession.read.schema(schema).parquet(path)


def _bounded_by_key(counts: DataFrame, entries: int, key: str) -> DataFrame:
    """Counts of many texts dealt by key, so that what a task sorts does not grow with the input.

    Left to the size of the shuffle, more input makes larger tasks, and from some size on these spill.
    """
    tasks = ceil(entries / ENTRIES_PER_SORT)
    return counts.repartition(tasks, F.col(key)) if tasks > counts.sparkSession.sparkContext.defaultParallelism else counts


def _few_partitions(vectors: DataFrame, entries: int) -> DataFrame:
    """Every iteration visits all partitions: entries for a few tasks go into a few of them."""
    wanted = max(1, ceil(entries / ENTRIES_PER_TASK))
    return vectors.repartition(wanted) if wanted < vectors.rdd.getNumPartitions() else vectors


def _write_numbers(spark: SparkSession, path: str, **numbers) -> None:
    spark.createDataFrame([tuple(numbers.values())], list(numbers)).coalesce(1).write.mode("overwrite").json(path)


@dataclass
class TextClassifier:
    """Fitted term table (idx, term, idf, coef) and intercept; it saves and loads through Spark."""

    terms: DataFrame
    intercept: float
    key: str = "row_id"
    threshold: float = 0.5

    def score(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """The columns of `docs` but the text, with `prob` of class 1 and `prediction` (int)."""
        return score_together({"": self}, docs, self.key, text).drop("model")

    def save(self, path: str) -> None:
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        _write_numbers(self.terms.sparkSession, f"{path}/model", intercept=self.intercept, threshold=self.threshold)

    @classmethod
    def load(cls, spark: SparkSession, path: str, key: str = "row_id") -> "TextClassifier":
        model = spark.read.schema("intercept double, threshold double").json(f"{path}/model").first()
        return cls(spark.read.parquet(f"{path}/terms"), model.intercept, key, model.threshold)


def score_together(
    models: dict[str, TextClassifier], docs: DataFrame, key: str = "row_id", text: str = "text", digits: int | None = None
) -> DataFrame:
    """(model, ...docs without text, prob, prediction): all texts by all models.

    Texts are cut into terms once. The models' term tables are one table with a row for
    each different term, and beside it each model's idf and coefficient, null where a model
    does not know the term. A text's sums come back as one row per key. `key` names a row.
    With `digits` scores are rounded before the prediction, so that equal texts tie
    whatever the order of their sums.
    """
    tables = [m.terms.select(F.lit(no).alias("_no"), "term", "idf", "coef") for no, m in enumerate(models.values())]
    if len(models) > 1:
        # Models times terms: the vocabularies are bounded, the broadcast is checked by its rows.
        own = [F.max(F.when(F.col("_no") == no, F.col(c))).alias(f"_{c}{no}") for no in range(len(models)) for c in ("idf", "coef")]
        joint = reduce(DataFrame.unionByName, tables).groupBy("term").agg(*own)
        terms = stage(joint.withColumn("idx", F.monotonically_increasing_id()), "model_terms")
    else:
        terms = next(iter(models.values())).terms.select("idx", "term", F.col("idf").alias("_idf0"), F.col("coef").alias("_coef0"))
    sums = term_sums(docs, terms, key, [(f"_idf{no}", [F.col(f"_coef{no}")]) for no in range(len(models))], text)
    by_key = sums.select(key, F.col("sums").alias("_sums"))
    each = F.array(
        *[
            F.struct(F.lit(no).alias("no"), F.lit(name).alias("model"), F.lit(m.intercept).alias("intercept"), F.lit(m.threshold).alias("cut"))
            for no, (name, m) in enumerate(models.items())
        ]
    )
    rows = docs.drop(text).join(by_key, key, "left").withColumn("_model", F.explode(each))
    margin = F.coalesce(F.col("_sums")[F.col("_model.no")][0], F.lit(0.0)) + F.col("_model.intercept")
    prob = 1.0 / (1.0 + F.exp(-margin))
    rows = rows.withColumn("prob", prob if digits is None else F.round(prob, digits))
    rows = rows.withColumn("prediction", (F.col("prob") > F.col("_model.cut")).cast("int"))
    return rows.select(F.col("_model.model").alias("model"), *[c for c in rows.columns if c not in ("_sums", "_model")])


def coefficient_table(terms: DataFrame, coefs: pd.DataFrame) -> DataFrame:
    """Adds `coef`: as many numbers as there are terms, which the term table bounds."""
    table = terms.sparkSession.createDataFrame(coefs, "idx int, coef double")
    return terms.join(F.broadcast(table), "idx", "left").fillna(0.0, ["coef"])


def _prepared(
    train: DataFrame, key: str, label: str, max_terms: int, weights: DataFrame | None, totals: DataFrame | None = None
) -> tuple:
    """(terms, vectors with label and weight, sum of weights) of a training set."""
    counted, counts = counted_terms(train, key, max_terms=max_terms, totals=totals)
    terms = stage(with_idf(counted, train.count()), "terms")
    balance = stage(balance_of(train, label, weights), "class_weights").withColumnRenamed("label", "_label")
    rows = train.select(key, F.col(label).cast("int").alias("label"))
    rows = rows.join(F.broadcast(balance), F.col("label") == F.col("_label")).select(key, "label", "weight")
    entries = counts.count()
    weights = weigh(_bounded_by_key(counts, entries, key), terms, key)
    vectors = training_vectors(weights, rows, max(terms.count(), 1), key)
    total = vectors.agg(F.sum("weight")).first()[0] or 1.0
    return terms, _few_partitions(vectors, entries), total


def balance_of(train: DataFrame, label: str = "label", weights: DataFrame | None = None) -> DataFrame:
    """(label, weight): the given class weights or the balanced ones; one row for each class."""
    return weights if weights is not None else class_weights(train.select(F.col(label).alias("label")))


def fit_text_classifier(
    train: DataFrame,
    key: str = "row_id",
    c: float = 1.0,
    max_terms: int = MAX_TERMS,
    weights: DataFrame | None = None,
    totals: DataFrame | None = None,
) -> TextClassifier:
    """Fit on (key, text, label). `weights` (label, weight) replaces the balanced ones.

    `totals`, the `term_totals` of these rows if they are at hand, save cutting the texts once.

    The intercept is not penalized; the penalty on the rest matches a summed
    loss with inverse strength `c`.
    """
    terms, vectors, total = _prepared(train, key, "label", max_terms, weights, totals)
    lr = LogisticRegression(weightCol="weight", regParam=1.0 / (c * total), standardization=False, maxIter=MAX_ITER, tol=TOLERANCE)
    model: LogisticRegressionModel = lr.fit(vectors)
    found = model.coefficients.toArray()
    coefs = pd.DataFrame({"idx": range(len(found)), "coef": found})
    return TextClassifier(stage(coefficient_table(terms, coefs), "model_terms"), float(model.intercept), key, model.getThreshold())


@dataclass
class ClassScorer:
    """K-class text scorer: terms (idx, term, idf), coefficients (idx, class, coef), intercepts by class.

    Fit, scoring, saving and loading are apart: a scorer scores any texts, and where it
    comes from does not matter to what uses its probabilities.
    """

    terms: DataFrame
    coefs: DataFrame
    intercepts: list[float]
    key: str = "row_id"

    def margins(self, docs: DataFrame, text: str = "text") -> DataFrame:
        """(key, margins): the score of every class for each text that has a known term."""
        k = len(self.intercepts)
        # One row per term with its coefficients in class order, absent ones 0.
        by_class = F.map_from_entries(F.collect_list(F.struct("class", "coef")))
        lists = self.coefs.groupBy("idx").agg(by_class.alias("_by"))
        filled = F.array(*[F.coalesce(F.col("_by")[i], F.lit(0.0)) for i in range(k)])
        terms = stage(self.terms.join(lists, "idx", "left").select("idx", "term", "idf", filled.alias("_coefs")), "class_terms")
        sums = term_sums(docs, terms, self.key, [("idf", [F.col("_coefs")[i] for i in range(k)])], text)
        return sums.select(self.key, F.col("sums")[0].alias("sums"))

    def score(self, docs: DataFrame, text: str = "text", keep_text: bool = False) -> DataFrame:
        """The columns of `docs` (the text only with `keep_text`), `probs` of all classes, `prediction`.

        The prediction is the first class of the largest probability. A text without known
        terms has the probabilities of the intercepts.
        """
        constant = F.array(*[F.lit(float(b)) for b in self.intercepts])
        rows = (docs if keep_text else docs.drop(text)).join(self.margins(docs, text), self.key, "left")
        margins = F.when(F.col("sums").isNull(), constant).otherwise(F.zip_with("sums", constant, lambda s, b: s + b))
        rows = rows.withColumn("probs", softmax(margins)).drop("sums")
        return rows.withColumn("prediction", argmax(F.col("probs")).cast("int"))

    def save(self, path: str) -> None:
        self.terms.write.mode("overwrite").parquet(f"{path}/terms")
        self.coefs.write.mode("overwrite").parquet(f"{path}/coefs")
        _write_numbers(self.terms.sparkSession, f"{path}/model", intercepts=list(map(float, self.intercepts)))

    @classmethod
    def load(cls, spark: SparkSession, path: str, key: str = "row_id") -> "ClassScorer":
        model = spark.read.schema("intercepts array<double>").json(f"{path}/model").first()
        return cls(spark.read.parquet(f"{path}/terms"), spark.read.parquet(f"{path}/coefs"), model.intercepts, key)


def fit_class_scorer(
    train: DataFrame,
    key: str = "row_id",
    label: str = "class_idx",
    c: float = 1.0,
    max_terms: int = MAX_TERMS,
    weights: DataFrame | None = None,
) -> ClassScorer:
    """Multinomial fit on (key, text, label) with labels 0 to K - 1, weighted and penalized as for two classes."""
    terms, vectors, total = _prepared(train, key, label, max_terms, weights)
    lr = LogisticRegression(
        family="multinomial", weightCol="weight", regParam=1.0 / (c * total), standardization=False, maxIter=MAX_ITER, tol=TOLERANCE
    )
    model: LogisticRegressionModel = lr.fit(vectors)
    matrix = model.coefficientMatrix.toArray()
    long = pd.DataFrame(matrix.T).stack().rename("coef").rename_axis(["idx", "class"]).reset_index()
    coefs = train.sparkSession.createDataFrame(long[long["coef"] != 0], "idx int, class int, coef double")
    return ClassScorer(terms, stage(coefs, "class_coefs"), [float(b) for b in model.interceptVector], key)


def loss_gradient(
    scores: DataFrame, train: DataFrame, terms: DataFrame, coefs: DataFrame, key: str, balance: DataFrame, c: float = 1.0
) -> DataFrame:
    """(class, idx, gradient): of the weighted loss plus |coef|^2 / 2c, by coefficient; idx -1 is the intercept.

    `scores` is (key, label, class, prob): the probability of a class for every training
    row; `coefs` is (idx, class, coef). A row's residual meets the terms of its text, and
    one aggregation adds them up by class and term. At the optimum all of it is zero.
    """
    balance = F.broadcast(balance.select(F.col("label").alias("_label"), "weight"))  # one row per class
    share = (F.col("prob") - (F.col("label") == F.col("class")).cast("double")) * F.col("weight")
    residual = scores.join(balance, F.col("label") == F.col("_label")).select(key, "class", share.alias("_residual"))
    residual = stage(residual, "residuals")
    weights = weigh(known_counts(train, terms, key), terms, key).select(key, "idx", F.col("weight").alias("_x"))
    slopes = weights.join(residual, key).groupBy("class", "idx").agg(F.sum(F.col("_x") * F.col("_residual")).alias("_slope"))
    full = slopes.join(coefs.select("class", "idx", "coef"), ["class", "idx"], "left")
    by_term = full.select("class", "idx", (F.col("_slope") + F.coalesce("coef", F.lit(0.0)) / c).alias("gradient"))
    constant = residual.groupBy("class").agg(F.sum("_residual").alias("gradient"))
    return by_term.unionByName(constant.select("class", F.lit(-1).alias("idx"), "gradient"))


def binary_gradient(model: TextClassifier, train: DataFrame, weights: DataFrame | None = None, c: float = 1.0) -> DataFrame:
    """`loss_gradient` of a two-class model on its training set; its only class is 1."""
    scores = model.score(train.select(model.key, "text", "label")).select(model.key, "label", F.lit(1).alias("class"), "prob")
    coefs = model.terms.select(F.lit(1).alias("class"), "idx", "coef")
    return loss_gradient(scores, train, model.terms, coefs, model.key, balance_of(train, "label", weights), c)


def class_gradient(
    model: ClassScorer, train: DataFrame, label: str = "class_idx", weights: DataFrame | None = None, c: float = 1.0
) -> DataFrame:
    """`loss_gradient` of a K-class model on its training set."""
    scored = model.score(train.select(model.key, "text", F.col(label).alias("label")))
    scores = scored.select(model.key, "label", F.posexplode("probs").alias("class", "prob"))
    return loss_gradient(scores, train, model.terms, model.coefs, model.key, balance_of(train, label, weights), c)


def optimality(gradient: DataFrame) -> DataFrame:
    """(largest, intercepts): the largest slope by a coefficient and by an intercept, in absolute value."""
    size = F.abs("gradient")
    return gradient.agg(
        F.max(F.when(F.col("idx") >= 0, size)).alias("largest"), F.max(F.when(F.col("idx") < 0, size)).alias("intercepts")
    )


def fit_vectors(df: DataFrame, vector: str, label: str, c: float = 1.0) -> LogisticRegressionModel:
    """Multinomial model of dense vectors, an array column; it saves and loads as any Spark ML model."""
    rows = df.select(F.col(label).cast("int").alias("label"), array_to_vector(vector).alias("features"))
    data = stage(rows, "multiclass")
    lr = LogisticRegression(
        family="multinomial", regParam=1.0 / (c * max(data.count(), 1)), standardization=False, maxIter=MAX_ITER
    )
    return lr.fit(data)


def score_vectors(model: LogisticRegressionModel, df: DataFrame, vector: str) -> DataFrame:
    """The columns of `df` with `prediction`, `p0` and `probs` of a model of vectors."""
    scored = model.transform(df.withColumn("features", array_to_vector(vector)))
    probs: Column = vector_to_array("probability")
    scored = scored.select(*df.columns, F.col("prediction").cast("int").alias("prediction"), probs.alias("probs"))
    return scored.withColumn("p0", F.col("probs")[0])


def multiclass_scores(
    df: DataFrame, key: str, vector: str, label: str, c: float = 1.0
) -> DataFrame:
    """(key, label, prediction, p0, probs): model fitted on `df` and its scores of the same rows."""
    scored = score_vectors(fit_vectors(df, vector, label, c), df, vector)
    return scored.select(key, F.col(label).cast("int").alias("label"), "prediction", "p0", "probs")
